"""Vector codes: each vector is cut into parts, and each part is written as the number of its nearest entry in that part's codebook.

Codebooks are found by rounds of assigning and averaging, in whole numbers throughout. After a round only some entries have
moved. A part whose own entry didn't move knows its exact distance to it from the round before, and no other entry that stayed can have come nearer:
it is compared with the moved entries alone. A part whose entry moved is compared with all. Equal distances go to
the lower index, in both cases. Each round reads what the one before wrote, and the rows' sums for the next codebook are written beside them.

Rows whose vector is null, or has a component that is null or not finite, are left out. So are vectors of another
dimension than that of the smallest id. A dimension that the number of parts doesn't divide gives the first parts one component more. Rows with a null id
count and come last. Repeated rows are coded each, and each counts. Scaled components beyond 2^62 and errors beyond 64 bits count as the largest. No rows: no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import arrow_function, without
from brindle.session import kept

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Vectors compared at once: with 256 entries their distances take 8 MB.
CHUNK_ROWS = 4_096
#: Labels' sums are joined to the rows in so many parts, so that no label is one task's burden.
SALTS = 32
LONG, MOST, EXACT = 2**63 - 1, 2**62, 2**53


def cuts(dim: int, parts: int = PARTS) -> list[slice]:
    at = np.cumsum([0] + [dim // parts + (i < dim % parts) for i in range(parts)]).tolist()
    return [slice(a, b) for a, b in zip(at, at[1:])]


def distances(rows: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of each row to each entry. In doubles where all sums stay below 2^53, otherwise as Python's integers."""
    width = max(rows.shape[1], 1)
    small = [width * 4 * np.abs(x).max(1, initial=0).astype(np.float64) ** 2 < EXACT for x in (rows, entries)]
    if small[0].all() and small[1].all():
        a, b = rows.astype(np.float64), entries.astype(np.float64)
        return (a**2).sum(1)[:, None] - 2 * (a @ b.T) + (b**2).sum(1)
    out = np.empty((len(rows), len(entries)), object)
    r, e = np.flatnonzero(small[0]), np.flatnonzero(small[1])
    if len(r) and len(e):
        out[np.ix_(r, e)] = distances(rows[r], entries[e]).astype(np.int64).astype(object)
    for i in range(len(rows)):
        for j in range(len(entries)):
            if not (small[0][i] and small[1][j]):
                out[i, j] = sum((x - y) ** 2 for x, y in zip(rows[i].tolist(), entries[j].tolist()))
    return out


def assigned(part: np.ndarray, book: np.ndarray, code: np.ndarray, known: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest entry, its exact distance) of each row of one part.

    code, known: the entries of the round before and the distances to them, -1 where not known; moved: which entries have changed since.
    """
    code, least = code.copy(), known.astype(object) if (known >= 2**52).any() else known.astype(np.float64)
    fixed = (known >= 0) & ~moved[code]
    again = np.flatnonzero(~fixed)
    if len(again):
        d = distances(part[again], book)
        at = d.argmin(1)
        code[again] = at
        if d.dtype == object:
            least = least.astype(object)
        least[again] = d[np.arange(len(again)), at]
    active, stay = np.flatnonzero(moved), np.flatnonzero(fixed)
    if len(active) and len(stay):
        d = distances(part[stay], book[active])
        at = d.argmin(1)
        d, entry = d[np.arange(len(stay)), at], active[at]
        nearer = (d < least[stay]) | ((d == least[stay]) & (entry < code[stay]))
        if d.dtype == object:
            least = least.astype(object)
        code[stay[nearer]], least[stay[nearer]] = entry[nearer], d[nearer]
    return code, least


_ROUND = pa.schema([("vec_id", pa.int64()), ("label", pa.int64()), ("vector", pa.list_(pa.int64())), ("code", pa.list_(pa.int32())), ("known", pa.list_(pa.int64())), ("error", pa.int64())]
                   + [("part", pa.int32()), ("entry", pa.int32()), ("count", pa.int64()), ("total", pa.list_(pa.decimal128(38, 0)))])
_DDL = "vec_id long, label long, vector array<long>, code array<int>, known array<long>, error long, part int, entry int, count long, total array<decimal(38,0)>"


def _whole(d: np.ndarray, limit: int, beyond: int) -> np.ndarray:
    """Distances as 64-bit integers; ``beyond`` for those over the limit."""
    return np.array([x if x <= limit else beyond for x in d.tolist()], np.int64) if d.dtype == object else d.astype(np.int64)


def _round(books: list[np.ndarray], moved: list[np.ndarray], dim: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Codes for all rows of a partition, and then the sums of the parts of each entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = cuts(dim)
        counts = [np.zeros(len(b), np.int64) for b in books]
        high, low = ([np.zeros(b.shape, np.int64) for b in books] for _ in range(2))  # of sums, in units of 2^31 and below: neither overflows before 2^32 rows
        for batch in batches:
            for i in range(0, batch.num_rows, CHUNK_ROWS):
                rows = batch.slice(i, CHUNK_ROWS)
                n = rows.num_rows
                x = rows["vector"].flatten().to_numpy(zero_copy_only=False).reshape(n, dim)
                code, known = (rows[c].flatten().to_numpy(zero_copy_only=False).reshape(n, len(books)) for c in ("code", "known"))
                codes, dist, error = [], [], np.zeros(n, np.int64)
                for p, (book, cut) in enumerate(zip(books, places)):
                    c, d = assigned(x[:, cut], book, code[:, p].astype(np.int64), known[:, p], moved[p])
                    codes.append(c)
                    dist.append(_whole(d, LONG, -1))
                    error = np.where(error > LONG - (e := _whole(d, LONG, LONG)), LONG, error + np.minimum(e, LONG - error))
                    counts[p] += np.bincount(c, minlength=len(book))
                    np.add.at(high[p], c, x[:, cut] >> 31)
                    np.add.at(low[p], c, x[:, cut] & (2**31 - 1))
                at = pa.array(np.arange(0, (n + 1) * len(books), len(books), dtype=np.int32))
                lists = [pa.ListArray.from_arrays(at, pa.array(np.stack(v, 1).ravel().astype(t))) for v, t in ((codes, np.int32), (dist, np.int64))]
                yield _batch(n, vec_id=rows["vec_id"], label=rows["label"], vector=rows["vector"], code=lists[0], known=lists[1], error=pa.array(error))
        used = [(p, int(e)) for p in range(len(books)) for e in np.flatnonzero(counts[p])]
        if used:
            totals = [[(int(h) << 31) + int(w) for h, w in zip(high[p][e], low[p][e])] for p, e in used]
            yield _batch(len(used), part=pa.array([p for p, _ in used], pa.int32()), entry=pa.array([e for _, e in used], pa.int32()), count=pa.array([int(counts[p][e]) for p, e in used], pa.int64()), total=pa.array(totals, pa.list_(pa.decimal128(38, 0))))

    return run


def _batch(n: int, **columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in _ROUND], schema=_ROUND)


def _moved(written: DataFrame, books: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(next codebooks, which entries differ from before), from the sums that a round has written: one row for each entry comes to the driver."""
    width = max(b.shape[1] for b in books)
    sums = [F.sum(F.get("total", F.lit(i))).alias(f"s{i}") for i in range(width)]
    after, moved = [b.copy() for b in books], [np.zeros(len(b), bool) for b in books]
    for r in written.where("part IS NOT NULL").groupBy("part", "entry").agg(F.sum("count").alias("n"), *sums).collect():
        book = after[r["part"]]
        for i in range(book.shape[1]):
            book[r["entry"], i] = int(r[f"s{i}"]) // r["n"]
        moved[r["part"]][r["entry"]] = (book[r["entry"]] != books[r["part"]][r["entry"]]).any()
    return after, moved


def codebooks_digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for row in b.tolist() for x in row).encode()).hexdigest()


@arrow_function(pa.list_(pa.int64()))
def _floors(vectors: pa.Array) -> pa.Array:
    lengths = pa.compute.list_value_length(vectors).to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore"):
        x = np.clip(np.floor(SCALE * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)), -MOST, MOST).astype(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(x))


def coded(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """((vec_id, label, code, error) of vectors (vec_id, label, embedding), the codebooks): code has each part's entry, error the sum of the squared distances."""
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding").where("embedding IS NOT NULL").where(good)
    order = [F.col("vec_id").asc_nulls_last(), "embedding"]
    head = rows.orderBy(*order).limit(1).collect()
    dim = len(head[0]["embedding"]) if head else 0
    rows = rows.where(F.size("embedding") == dim)
    first = rows.orderBy(*order).limit(entries).select(_floors("embedding").alias("v")).collect()
    start = np.array([r["v"] for r in first], np.int64).reshape(len(first), dim)
    books = [start[:, cut] for cut in cuts(dim, parts)]
    moved = [np.ones(len(b), bool) for b in books]
    unknown = [F.array(*[F.lit(x)] * parts) for x in (0, -1)]
    state = rows.select("vec_id", "label", _floors("embedding").alias("vector"), unknown[0].alias("code"), unknown[1].cast("array<long>").alias("known"))
    for turn in range(rounds + 1):
        state = kept(state.select("vec_id", "label", "vector", "code", "known").mapInArrow(_round(books, moved, dim), _DDL))
        if turn < rounds:
            books, moved = _moved(state, books)
        state = state.where("part IS NULL")
    return state.select("vec_id", "label", "code", "error"), books


def with_label_errors(codes: DataFrame) -> DataFrame:
    """codes with label_error: the sum of ``error`` over the rows of the same label, null being a label too."""
    key = [F.col("label").isNull().alias("__none"), F.coalesce("label", F.lit(0)).alias("__label")]
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONG).cast("decimal(38,0)")).cast("long")
    sums = codes.groupBy(*key).agg(total.alias("label_error")).withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = without(codes, ["label_error"]).withColumns({"__none": key[0], "__label": key[1], "__salt": F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int")})
    return salted.join(sums, ["__none", "__label", "__salt"]).drop("__none", "__label", "__salt")


def vector_codes(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256); code as two hex digits for each part."""
    codes, books = coded(vectors)
    text = F.array_join(F.transform("code", lambda c: F.lpad(F.lower(F.hex(c.cast("long"))), 2, "0")), "")
    return with_label_errors(codes).select("vec_id", "label", text.alias("code"), "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))
