"""Approximate nearest neighbours by largest inner product, with robust-pruned directed graphs, one for each shard.

Vectors are dealt to shards by a hash. In each shard a graph is grown: a greedy search for every vector
proposes neighbours, and a proposal is kept only where it isn't much nearer (by the factor ALPHA) to a kept neighbour than to the
vector itself, so that edges stay few and point in all directions. A query walks each shard's graph with a beam, and the best of
all shards are its answer. Inner products become distances by one more coordinate that makes all vectors of a
shard equally long; a shard holds vectors of one order of length only, so that a very long one takes no precision from the others.

Graphs are walked in single precision on vectors scaled to the shard's longest; what a walk meets is scored in double precision on the
original vectors. Equal vectors are one node of the graph; its members are written out again in the result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.common import checkpointed

NEAREST = 20
#: Shards grow with the square root of the vectors, from FEW_ROWS up to MOST_ROWS and to MOST_BYTES of doubles, which is what a task can hold: with n vectors there are
#: sqrt(n / FEW_ROWS) of them, so a query walks few graphs, and the walks of all queries grow with n to the power of 1.5.
FEW_ROWS, MOST_ROWS, MOST_BYTES = 6_000, 200_000, 256 << 20
#: Queries of a block: one task holds a graph of a shard and a block.
BLOCK_ROWS = 20_000
DEGREE, BUILD_BEAM, ALPHA = 24, 40, 1.2
SEARCH_BEAM = 160
BATCH = 128


def _walk(points: np.ndarray, squares: np.ndarray, edges: np.ndarray, start: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Beam searches for many queries at once: (ids, distances) of the ``beam`` nearest nodes that each has met, nearest first; -1 where fewer."""
    n, q, width = len(points), len(queries), edges.shape[1]
    beam = min(beam, n)
    ids = np.full((q, beam), -1, np.int64)
    dist = np.full((q, beam), np.inf, points.dtype)
    done = np.ones((q, beam), bool)
    ids[:, 0], done[:, 0] = start, False
    dist[:, 0] = squares[start] - 2 * (queries @ points[start])
    seen = np.zeros((q, n), bool)
    seen[:, start] = True
    rows = np.arange(q)
    while len(rows):
        at = np.argmin(np.where(done[rows], np.inf, dist[rows]), axis=1)
        node = ids[rows, at]
        done[rows, at] = True
        near = edges[node]
        fresh = (near >= 0) & ~seen[rows[:, None], near]
        seen[rows[:, None], np.where(near >= 0, near, node[:, None])] = True
        d = np.where(fresh, squares[near] - 2 * np.einsum("qd,qkd->qk", queries[rows], points[near]), np.inf)
        all_d = np.concatenate([dist[rows], d], 1)
        keep = np.argpartition(all_d, beam - 1, axis=1)[:, :beam] if beam < all_d.shape[1] else np.tile(np.arange(all_d.shape[1]), (len(rows), 1))
        dist[rows] = np.take_along_axis(all_d, keep, 1)
        ids[rows] = np.where(np.isinf(dist[rows]), -1, np.take_along_axis(np.concatenate([ids[rows], near], 1), keep, 1))
        done[rows] = np.take_along_axis(np.concatenate([done[rows], ~fresh], 1), keep, 1) | np.isinf(dist[rows])
        rows = rows[~done[rows].all(1)]
    order = np.argsort(dist, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)


def _prune(points: np.ndarray, nodes: np.ndarray, proposed: np.ndarray, alpha: float) -> np.ndarray:
    """Neighbours of each node, at most DEGREE of the proposed (-1: none): from the nearest on, without those that a kept one is alpha times nearer to."""
    valid = (proposed >= 0) & (proposed != nodes[:, None])
    p = points[proposed]
    own = np.where(valid, ((p - points[nodes][:, None]) ** 2).sum(-1), np.inf)
    order = np.argsort(own, axis=1, kind="stable")
    proposed, own, p = np.take_along_axis(proposed, order, 1), np.take_along_axis(own, order, 1), np.take_along_axis(p, order[:, :, None], 1)
    again = np.zeros(proposed.shape, bool)  # a node may have been proposed twice; equal ids lie side by side but for ties
    sorted_ids = np.argsort(proposed, axis=1, kind="stable")
    s = np.take_along_axis(proposed, sorted_ids, 1)
    np.put_along_axis(again, sorted_ids[:, 1:], s[:, 1:] == s[:, :-1], 1)
    alive = np.isfinite(own) & ~again
    out = np.full((len(nodes), DEGREE), -1, np.int64)
    rows = np.arange(len(nodes))
    for k in range(DEGREE):
        if not alive.any():
            break
        at = np.argmax(alive, axis=1)
        have = alive[rows, at]
        out[have, k] = proposed[rows, at][have]
        to_kept = ((p - p[rows, at][:, None]) ** 2).sum(-1)
        alive &= ~((alpha * to_kept <= own) & have[:, None])
        alive[rows, at] = False
    return out


def build(points: np.ndarray, seed: int = 0) -> tuple[np.ndarray, int]:
    """(edges, start): the graph of one shard; row i has the neighbours of point i, -1 where it has fewer."""
    n = len(points)
    random = np.random.default_rng(seed)
    edges = np.full((n, DEGREE), -1, np.int64)
    if n == 1:
        return edges, 0
    width = min(DEGREE // 2, n - 1)
    edges[:, :width] = (np.arange(n)[:, None] + random.integers(1, n, (n, width))) % n
    start = int(((points - points.mean(0)) ** 2).sum(1).argmin())
    squares = (points**2).sum(1)
    for alpha in (1.0, ALPHA):
        order = random.permutation(n)
        for i in range(0, n, BATCH):
            batch = order[i : i + BATCH]
            met, _ = _walk(points, squares, edges, start, points[batch], BUILD_BEAM)
            edges[batch] = _prune(points, batch, np.concatenate([met, edges[batch]], 1), alpha)
            back: dict[int, list[int]] = {}
            for a, row in zip(batch.tolist(), edges[batch].tolist()):
                for b in row:
                    if b >= 0:
                        back.setdefault(b, []).append(a)
            full = []
            for b, sources in back.items():
                have = edges[b]
                free = np.flatnonzero(have < 0)
                new = [a for a in sources if a not in have]
                if len(new) <= len(free):
                    edges[b, free[: len(new)]] = new
                else:
                    full.append((b, new))
            for j in range(0, len(full), BATCH):
                part = full[j : j + BATCH]
                extra = np.full((len(part), max(len(new) for _, new in part)), -1, np.int64)
                for r, (_, new) in enumerate(part):
                    extra[r, : len(new)] = new
                nodes = np.array([b for b, _ in part])
                edges[nodes] = _prune(points, nodes, np.concatenate([edges[nodes], extra], 1), alpha)
    return edges, start


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one dimension as a matrix, without a Python object for each component."""
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(column), -1)


def _edges(column: pa.ChunkedArray) -> np.ndarray:
    """The neighbours of each node, -1 where it has fewer than DEGREE."""
    lists = column.combine_chunks()
    edges = np.full((len(lists), DEGREE), -1, np.int64)
    edges[np.arange(DEGREE) < lists.value_lengths().to_numpy(zero_copy_only=False)[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return edges


def _points(vectors: np.ndarray) -> np.ndarray:
    """A shard's vectors, scaled to the longest of them, with the coordinate that makes all equally long."""
    scaled = vectors / np.abs(vectors).max()
    scaled /= np.sqrt((scaled**2).sum(1).max())
    return np.c_[scaled, np.sqrt(np.maximum(1 - (scaled**2).sum(1), 0))].astype(np.float32)


def _directions(queries: np.ndarray) -> np.ndarray:
    """Queries at length one, which doesn't change what is nearest, with a zero for the added coordinate."""
    scaled = queries / np.abs(queries).max(1, keepdims=True)
    scaled /= np.sqrt((scaled**2).sum(1, keepdims=True))
    return np.c_[scaled, np.zeros(len(scaled))].astype(np.float32)


def _grow(group: pa.Table) -> pa.Table:
    group = group.sort_by("node")
    edges, start = build(_points(_matrix(group["embedding"])))
    flags = np.zeros(len(edges), bool)
    flags[start] = True
    lists = [row[row >= 0] for row in edges.astype(np.int32)]
    return group.append_column("edges", pa.array(lists, pa.list_(pa.int32()))).append_column("start", pa.array(flags))


def _answered(k: int, beam: int):
    def answer(shard: pa.Table, block: pa.Table) -> pa.Table:
        kind = pa.schema([("query_id", pa.int64()), ("node", pa.int64()), ("score", pa.float64())])
        if not shard.num_rows or not block.num_rows:
            return kind.empty_table()
        shard = shard.sort_by("node")  # the order in which the edges count
        vectors, queries = _matrix(shard["embedding"]), _matrix(block["embedding"])
        points, asked = _points(vectors), _directions(queries)
        edges = _edges(shard["edges"])
        start = int(np.argmax(shard["start"].to_numpy()))
        squares, nodes, ids = (points**2).sum(1), shard["node"].to_numpy(), block["query_id"].to_numpy()
        out = []
        for i in range(0, len(queries), BATCH):
            met, _ = _walk(points, squares, edges, start, asked[i : i + BATCH], max(beam, 2 * k))
            score = np.where(met >= 0, (queries[i : i + BATCH, None] * vectors[met]).sum(-1), -np.inf)
            best = np.argsort(-score, axis=1, kind="stable")[:, :k]  # in double precision
            met, score = np.take_along_axis(met, best, 1), np.take_along_axis(score, best, 1)
            good = met >= 0
            out.append((np.repeat(ids[i : i + BATCH], good.sum(1)), nodes[met[good]], score[good]))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*out)], schema=kind)

    return answer


def valid(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding): rows whose vector is not null, not empty, not zero and has only finite components, and whose id is not null.

    Of rows that share an id with different vectors the one with the smallest vector stays; repeated rows are one.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("embedding", lambda x: x != 0)
    return rows.where("vec_id IS NOT NULL AND embedding IS NOT NULL").where(good).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def _distinct(rows: DataFrame, members: int) -> DataFrame:
    """(node, embedding, members): each distinct vector once, named by its least id, with its ``members`` least ids.

    More can never be among the nearest: equal scores go by id. The least ids are first taken within parts of a group, so a vector that a large share of rows has is no burden on one task.
    """
    part = Window.partitionBy("embedding", F.pmod(F.col("vec_id"), F.lit(64))).orderBy("vec_id")
    few = rows.withColumn("r", F.row_number().over(part)).where(F.col("r") <= members).drop("r")
    return few.groupBy("embedding").agg(F.min("vec_id").alias("node"), F.slice(F.array_sort(F.collect_list("vec_id")), 1, members).alias("members"))


SHARD = ["dim", "band", "shard"]


def _band(embedding: Column) -> Column:
    """The order of a vector's length: those of one band differ by less than 256 times in their greatest component."""
    return F.floor(F.log2(F.array_max(F.transform(embedding, F.abs))) / 8).cast("int")


def shard_rows(n: int, dim: int) -> int:
    """How many of n vectors a shard gets."""
    return max(1, min(max(FEW_ROWS, math.isqrt(FEW_ROWS * n)), MOST_ROWS, MOST_BYTES // (8 * max(dim, 1))))


def index(vectors: DataFrame, k: int = NEAREST, rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(graph, members): the graph's rows (dim, band, shard, node, embedding, edges, start), and each node's members. rows: vectors of a shard, else ``shard_rows`` of all."""
    nodes = checkpointed(_distinct(vectors, k + 1).withColumn("dim", F.size("embedding")))
    n, dim = nodes.agg(F.count("*"), F.coalesce(F.max("dim"), F.lit(1))).first()
    shards = max(1, -(-n // (rows or shard_rows(n, dim))))
    dealt = nodes.select("dim", _band(F.col("embedding")).alias("band"), F.pmod(F.xxhash64("node"), F.lit(shards)).cast("int").alias("shard"), "node", "embedding")
    # a number of partitions that is given isn't coalesced: each shard is a task of its own, but for a few that meet by hash
    graph = dealt.repartition(4 * shards, *SHARD).groupBy(*SHARD).applyInArrow(_grow, "dim int, band int, shard int, node long, embedding array<double>, edges array<int>, start boolean")
    return checkpointed(graph), nodes.select("node", "members")


def search(graph: DataFrame, members: DataFrame, queries: DataFrame, k: int = NEAREST, beam: int = SEARCH_BEAM, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query (query_id, embedding) the k nearest vectors found, its own id left out.

    Queries go in blocks to every shard of their dimension, so a task holds one shard and one block.
    """
    n = queries.count()
    blocks = max(1, -(-n // block_rows))
    to = [f"to_{c}" for c in (*SHARD, "block")]
    shards = checkpointed(graph.select(*[F.col(c).alias(f"to_{c}") for c in SHARD]).distinct())
    tasks = max(1, 4 * blocks * shards.count())
    asked = queries.withColumn("to_block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("to_dim", F.size("embedding"))
    asked = asked.join(F.broadcast(shards), "to_dim").repartition(tasks, *to)  # one row for each shard: some thousands for 10^9 vectors
    held = graph.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).repartition(tasks, *SHARD, "block")
    found = held.groupBy(*SHARD, "block").cogroup(asked.groupBy(*to)).applyInArrow(_answered(k + 1, beam), "query_id long, node long, score double")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "node")
    top = found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).drop("r")
    each = top.join(members, "node").select("query_id", "score", F.explode("members").alias("vec_id")).where("vec_id != query_id")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return each.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, every: int = 20, k: int = NEAREST) -> DataFrame:
    """The k nearest of every row whose vec_id is divisible by ``every``, among all other rows; see ``valid`` for rows that take no part. No rows: no rows."""
    rows = checkpointed(valid(vectors))
    graph, members = index(rows, k)
    return search(graph, members, rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "embedding"), k)
