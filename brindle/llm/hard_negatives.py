"""Hard negatives: for an anchor and one of its nearest rows of the same label, the rows of other labels that score nearly as high.

A score is the inner product of two vectors of integers. The anchors of a block, and the origin, are joined by a least spanning tree. Along an
edge of length d a candidate's score changes by at most d times the candidate's norm, so what is known of the score at the parent (exactly,
or between bounds) bounds the score at the child; the origin scores 0 with everything. An anchor scores those candidates alone whose bounds
overlap its window: for positives, from the k-th best so far upwards; for negatives, the ranges below its positives. Results are those of
scoring everything.

Rows whose id, label or vector is null, or whose vector has a component that is null, not finite, or not finite when scaled, take no
part. Repeated rows are one; of rows that share an id and differ the smallest (vector, label) stays. Vectors of different dimensions don't
meet. A score beyond 64 bits counts as the largest (smallest) of them. No rows: no rows. An anchor without positives has no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.common import checkpointed

SCALE, POSITIVES, NEGATIVES = 256, 5, 5
#: A negative scores from LEAST_SHARE hundredths of its positive's score up to that score.
LEAST_SHARE = 80
#: Anchors of a block; a task holds one block and one shard of candidates.
BLOCK_ROWS = 1_024
#: Candidates of a shard grow with the square root of all, from FEW_ROWS up to SHARD_BYTES of doubles.
FEW_ROWS, SHARD_BYTES = 2_000, 64 << 20
#: Candidates that are bounded at once: the bounds of a block take 16 bytes for each anchor and candidate.
CHUNK_ROWS = 2_048
LONG = 2**63 - 1


def tree(anchors: np.ndarray) -> list[tuple[int, int, float]]:
    """(anchor, parent, length) of each edge of a least spanning tree over the anchors and the origin (-1), parents first."""
    with np.errstate(over="ignore", invalid="ignore"):
        near = np.sqrt((anchors**2).sum(1))
        parent, open_, out = np.full(len(anchors), -1), np.ones(len(anchors), bool), []
        for _ in range(len(anchors)):
            i = int(np.flatnonzero(open_)[np.argmin(near[open_])])
            out.append((i, int(parent[i]), float(near[i])))
            open_[i] = False
            d = np.nan_to_num(np.sqrt(((anchors - anchors[i]) ** 2).sum(1)), nan=np.inf)
            closer = open_ & (d < near)
            near[closer], parent[closer] = d[closer], i
    return out


class Candidates:
    """Vectors of integers, held as doubles, and their scores."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        self.ids, self.labels, self.vectors = ids, labels, vectors
        with np.errstate(over="ignore"):
            self.norms = np.sqrt((vectors**2).sum(1))
        self.most = np.abs(vectors).max(1, initial=0)

    def take(self, at) -> Candidates:
        return Candidates(self.ids[at], self.labels[at], self.vectors[at])

    def scores(self, anchor: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Exact scores as 64-bit integers. Where all partial sums are below 2^53 doubles are exact; other pairs are summed as Python's integers."""
        most = np.abs(anchor).max(initial=0)
        with np.errstate(over="ignore", invalid="ignore"):
            exact = self.most[at] * most * max(len(anchor), 1) < 2**53
            # beyond a half, taking rows out costs more than the products that it saves
            s = self.vectors @ anchor if 2 * len(at) > len(self.ids) else self.vectors[at] @ anchor
            s = s[at] if len(s) != len(at) else s
        out = np.where(exact, s, 0).astype(np.int64)
        for j in np.flatnonzero(~exact):
            total = sum(int(x) * int(y) for x, y in zip(self.vectors[at[j]].tolist(), anchor.tolist()))
            out[j] = min(max(total, -LONG), LONG)
        return out


def rescored(candidates: Candidates, anchors: np.ndarray, edges: list[tuple[int, int, float]], window: Callable[[int], tuple[float, float]]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(anchor, places, exact scores): of each anchor all candidates whose bounds overlap its window, and perhaps others."""
    parents = {p for _, p, _ in edges}
    bounds = {-1: (np.zeros(len(candidates.ids)), np.zeros(len(candidates.ids)))}
    lengths = np.sqrt((anchors**2).sum(1))
    for i, parent, length in edges:
        below, above = bounds[parent]
        with np.errstate(over="ignore", invalid="ignore"):
            change = length * candidates.norms * (1 + 1e-9) + lengths[i] * candidates.norms * 1e-12 + 1  # what doubles round is far below what is added here
            change = np.nan_to_num(change, nan=np.inf, posinf=np.inf)
        below, above = below - change, above + change
        least, most = window(i)
        at = np.flatnonzero((above >= least) & (below <= most))
        s = candidates.scores(anchors[i], at)
        below[at] = above[at] = s
        if i in parents:
            bounds[i] = below, above
        yield i, at, s


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first k by falling score, then by id."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        scores, ids = scores[(keep := scores >= least)], ids[keep]
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


def _matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    """Scaled and floored vectors, without a Python object for each component."""
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(SCALE * flat).reshape(rows, -1 if rows and len(flat) else 0)


def _candidates(shard: pa.Table) -> Candidates:
    return Candidates(shard["vec_id"].to_numpy(), shard["label"].to_numpy(), _matrix(shard["embedding"], shard.num_rows))


def _chunks(c: Candidates) -> Iterator[Candidates]:
    for i in range(0, len(c.ids), CHUNK_ROWS):
        yield c.take(slice(i, i + CHUNK_ROWS))


class Ranges:
    """For each anchor, ranges of scores and the best k that were met in each."""

    def __init__(self, ranges: list[list[tuple[int, int]]], k: int):
        self.ranges, self.k = ranges, k
        self.found = [[(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in r] for r in ranges]

    def _least(self, i: int, j: int) -> int:
        """A candidate below this is of no use: k are known to be better."""
        s = self.found[i][j][0]
        return max(self.ranges[i][j][0], int(s[-1])) if len(s) == self.k else self.ranges[i][j][0]

    def window(self, i: int) -> tuple[float, float]:
        r = range(len(self.ranges[i]))
        return min((self._least(i, j) for j in r), default=math.inf), max((self.ranges[i][j][1] for j in r), default=-math.inf)

    def add(self, i: int, scores: np.ndarray, ids: np.ndarray) -> None:
        for j, (_, most) in enumerate(self.ranges[i]):
            of = np.flatnonzero((scores >= self._least(i, j)) & (scores <= most))
            if len(of):
                s, v = self.found[i][j]
                self.found[i][j] = _best(np.concatenate([s, scores[of]]), np.concatenate([v, ids[of]]), self.k)


_POSITIVE = pa.schema([("anchor_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
_NEGATIVE = pa.schema([("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("positive_score", pa.int64()), ("negative_id", pa.int64()), ("negative_score", pa.int64())])


def _positives(k: int):
    def best(block: pa.Table, shard: pa.Table) -> pa.Table:
        if not block.num_rows or not shard.num_rows:
            return _POSITIVE.empty_table()
        anchors, rows, parts = _candidates(block), _candidates(shard), []
        for label in np.unique(anchors.labels):
            own, same = anchors.take(anchors.labels == label), rows.take(rows.labels == label)
            kept, edges = Ranges([[(-LONG, LONG)]] * len(own.ids), k), tree(own.vectors)
            for chunk in _chunks(same):
                for i, at, s in rescored(chunk, own.vectors, edges, kept.window):
                    other = chunk.ids[at] != own.ids[i]
                    kept.add(i, s[other], chunk.ids[at][other])
            for i, [(s, ids)] in enumerate(kept.found):
                parts.append((np.repeat(own.ids[i], len(s)), ids, s))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*parts)], schema=_POSITIVE)

    return best


def _negatives(k: int, share: int):
    def best(block: pa.Table, shard: pa.Table) -> pa.Table:
        if not block.num_rows or not shard.num_rows:
            return _NEGATIVE.empty_table()
        anchors, rows = _candidates(block), _candidates(shard)
        positives = [[(p["id"], p["score"]) for p in ps] for ps in block["positives"].to_pylist()]
        kept = Ranges([[(-(-share * p // 100), p) for _, p in ps] for ps in positives], k)
        edges = tree(anchors.vectors)
        for chunk in _chunks(rows):
            for i, at, s in rescored(chunk, anchors.vectors, edges, kept.window):
                other = chunk.labels[at] != anchors.labels[i]
                kept.add(i, s[other], chunk.ids[at][other])
        parts = [(np.repeat([[anchors.ids[i]], [p], [score]], len(s), 1), ids, s) for i, ps in enumerate(positives) for (p, score), (s, ids) in zip(ps, kept.found[i])]
        named = np.concatenate([p[0] for p in parts], 1)
        return pa.table([*map(pa.array, named), *(pa.array(np.concatenate([p[c] for p in parts])) for c in (1, 2))], schema=_NEGATIVE)

    return best


def valid(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, embedding): the rows that take part."""
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * SCALE) < F.lit(float("inf"))))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
    rows = rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").where(good)
    return rows.groupBy("vec_id").agg(F.min(F.struct("embedding", "label")).alias("__row")).select("vec_id", "__row.label", "__row.embedding")


def _met(blocks: DataFrame, shards: DataFrame, n_blocks: int, n_shards: int, function: Callable, kind: str) -> DataFrame:
    """Every block of anchors with every shard of candidates of its dimension, each pair in one task. A block or shard is named by a number and the dimension."""
    key = ["dim", "block", "shard"]
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    tasks = 2 * n_blocks * n_shards
    left = blocks.withColumn("shard", numbers(n_shards)).repartition(tasks, *key).groupBy(*key)
    right = shards.withColumn("block", numbers(n_blocks)).repartition(tasks, *key).groupBy(*key)
    return left.cogroup(right).applyInArrow(function, kind)


def mined(vectors: DataFrame, every: int = 100, positives: int = POSITIVES, negatives: int = NEGATIVES, share: int = LEAST_SHARE, block_rows: int = BLOCK_ROWS, shard_rows: int | None = None) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of vectors (vec_id, label, embedding).

    Anchors are the rows whose id is divisible by ``every``; an anchor's positives are the first of its label. Blocks and shards are dealt by
    a hash of the id, so no label or group of near vectors is a burden on one task. A shard is read once for each block of anchors.
    """
    rows = checkpointed(valid(vectors).withColumn("dim", F.size("embedding")))
    anchors = rows.where(F.col("vec_id") % every == 0)
    n, n_anchors, dim = rows.agg(F.count("*"), F.coalesce(F.sum((F.col("vec_id") % every == 0).cast("long")), F.lit(0)), F.coalesce(F.max("dim"), F.lit(1))).first()
    held = shard_rows or min(max(FEW_ROWS, math.isqrt(FEW_ROWS * n)), max(SHARD_BYTES // (8 * max(dim, 1)), 1))
    n_blocks, n_shards = max(1, -(-n_anchors // block_rows)), max(1, -(-n // held))
    blocks = anchors.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).cast("int"))
    shards = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(n_shards)).cast("int"))
    met = _met(blocks, shards, n_blocks, n_shards, _positives(positives), "anchor_id long, vec_id long, score long")
    order = Window.partitionBy("anchor_id").orderBy(F.col("score").desc(), "vec_id")
    first = met.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= positives)
    of = first.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct(F.col("vec_id").alias("id"), "score"))).alias("positives"))
    asked = checkpointed(blocks.join(of, F.col("vec_id") == F.col("anchor_id")).drop("anchor_id"))
    found = _met(asked, shards, n_blocks, n_shards, _negatives(negatives, share), "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.col("negative_score").desc(), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
