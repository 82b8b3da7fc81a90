"""Connected components of a graph given as a table of links, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import checkpointed, joined_by_share


def _hang(links: DataFrame, downward: bool, n_links: int) -> DataFrame:
    """Each node's neighbours are hung on the least node among them and itself.

    downward: only the smaller neighbours of a node move, else only the larger ones. The least neighbour of a node that very many links name is sent to them; the links of
    the others meet it by a shuffle.
    """
    both = links.select("a", "b") if downward else links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = checkpointed(both.groupBy("a").agg(F.count("*").alias("n"), F.least(F.min("b"), F.col("a")).alias("m")))
    moved = joined_by_share(both, least, "a", n_links if downward else 2 * n_links)
    if downward:  # links run from the larger a to the smaller b
        moved = moved.select(F.col("b").alias("x"), "m").union(least.select(F.col("a").alias("x"), "m"))
    else:
        moved = moved.where("b > a").select(F.col("b").alias("x"), "m")
    return moved.where("x != m").select(F.col("x").alias("a"), F.col("m").alias("b")).distinct()


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b: numbers); root is the least node that can be reached.

    Alternates two rounds that hang nodes on smaller ones until every link runs from a node straight to its
    root. The number of links never grows and the rounds grow with the logarithm of the longest path. The links of a
    node that very many have never meet in one task: they cost partial minima and a broadcast of one row.
    Null ends and links from a node to itself are ignored. No links: no rows.
    """
    now = checkpointed(links.where("a is not null and b is not null and a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    sign = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    before = sign(now)
    for _ in range(max_rounds):
        if not before[0]:
            break
        up = checkpointed(_hang(now, False, before[0]))
        now = checkpointed(_hang(up, True, up.count()))
        after = sign(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components still change after {max_rounds} rounds")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
