"""Differences between two tables, found from above.

Rows are dealt to buckets by a hash of their key, and buckets to finer ones. A bucket's fingerprint (its number of rows, and the XOR and the sum of its rows' hashes) is
one aggregate with map-side combine, so comparing two tables moves a few hundred rows. Only buckets whose fingerprints differ are looked into at the next level, and only the
rows of finest buckets that differ are compared one by one. Tables that agree are told equal by the first level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

#: Buckets of a level within one of the level above, and levels: 65,536 finest buckets.
FAN, LEVELS = 256, 2


def _value(df: DataFrame, c: str) -> Column:
    """A column as it is compared: maps, which have no order, as text with sorted keys."""
    if isinstance(df.schema[c].dataType, MapType):
        return F.to_json(F.array_sort(F.map_entries(F.col(f"`{c}`"))))
    return F.col(f"`{c}`")


def _placed(df: DataFrame, keys: list[str]) -> DataFrame:
    """df with __k, the hash that deals a row to its buckets, and __h, the hash of all its columns. Nulls have a mark of their own in the hash, since a hash passes over them."""
    columns = sorted(df.columns)
    values = [_value(df, c) for c in columns]
    marks = F.concat(*[F.when(F.col(f"`{c}`").isNull(), "1").otherwise("0") for c in columns])
    return df.withColumns({"__k": F.xxhash64(*[_value(df, c) for c in keys], *[F.col(f"`{k}`").isNull() for k in keys]), "__h": F.xxhash64(*values, marks)})


def _bucket(level: int) -> Column:
    return F.pmod(F.shiftright("__k", 8 * level), F.lit(FAN)).cast("int").alias(f"__b{level}")


def _fingerprints(placed: DataFrame, level: int, side: str) -> DataFrame:
    names = [f"__b{i}" for i in range(level + 1)]
    prints = placed.select(*[_bucket(i) for i in range(level + 1)], "__h").groupBy(*names).agg(F.count("*").alias("n"), F.bit_xor("__h").alias("x"), F.sum(F.col("__h").cast("decimal(38,0)")).alias("s"))
    return prints.select(*names, F.struct("n", "x", "s").alias(side))


def differing_buckets(a: DataFrame, b: DataFrame, keys: list[str], levels: int = LEVELS) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(a's rows and b's rows in the finest buckets that differ, those buckets or None if the tables are equal). The rows still have their hashes."""
    left, right, names, places = _placed(a, keys), _placed(b, keys), [], None
    for level in range(levels):
        names = [f"__b{i}" for i in range(level + 1)]
        both = _fingerprints(left, level, "a").join(_fingerprints(right, level, "b"), names, "full").where(~F.col("a").eqNullSafe(F.col("b"))).select(*names)
        found = both.collect()  # at most FAN ** (level + 1) rows of a few numbers
        if not found:
            return left, right, None
        places = both.sparkSession.createDataFrame([tuple(r) for r in found], ", ".join(f"{n} int" for n in names))
        within = [_bucket(i) for i in range(level + 1)]
        left, right = (df.withColumns({n: c for n, c in zip(names, within)}).join(F.broadcast(places), names, "left_semi").drop(*names) for df in (left, right))
    return left, right, places


def table_diff(a: DataFrame, b: DataFrame, keys: list[str], examples: int = 10) -> DataFrame:
    """(side, rows, examples): rows that only one of two tables with the same columns has, counted with their repeats, and the least keys among them as JSON."""
    if set(a.columns) != set(b.columns):
        raise ValueError(f"columns that only one of the tables has: {sorted(set(a.columns) ^ set(b.columns))}")
    left, right, places = differing_buckets(a, b.select(*[F.col(f"`{c}`") for c in a.columns]), keys)
    if places is None:
        return a.sparkSession.createDataFrame([("only in first", 0, []), ("only in second", 0, [])], "side string, rows long, examples array<string>")
    # rows with equal hashes of all columns are equal; what is counted is how many more of them a side has
    of = lambda df, sign: df.select(F.to_json(F.struct(*[F.col(f"`{k}`") for k in keys])).alias("key"), "__k", "__h", F.lit(sign).alias("sign"))
    more = of(left, 1).unionByName(of(right, -1)).groupBy("__k", "__h").agg(F.min("key").alias("key"), F.sum("sign").alias("more")).where("more <> 0")
    side = F.when(F.col("more") > 0, "only in first").otherwise("only in second").alias("side")
    sums = more.select(side, "key", F.abs("more").alias("n"))
    some = sums.groupBy("side").agg(F.sum("n").alias("rows"))
    least = None
    for name in ("only in first", "only in second"):
        keys_of = sums.where(F.col("side") == name).select("key").distinct().orderBy("key").limit(examples)
        one = keys_of.agg(F.array_sort(F.collect_list("key")).alias("examples")).select(F.lit(name).alias("side"), "examples")
        least = one if least is None else least.unionByName(one)
    return least.join(some, "side", "left").select("side", F.coalesce("rows", F.lit(0)).cast("long").alias("rows"), "examples")


def same_rows(a: DataFrame, b: DataFrame, keys: list[str]) -> bool:
    """Whether two tables have the same rows, repeats included; told from the first level if they have."""
    return differing_buckets(a, b.select(*[F.col(f"`{c}`") for c in a.columns]), keys, levels=1)[2] is None
