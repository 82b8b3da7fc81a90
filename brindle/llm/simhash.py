"""SimHash near-dedup by deletion-variant signatures.

A fingerprint has 64 bits. To find all pairs that differ in at most RADIUS bits it is cut into two segments
of 32 bits. The lower one is indexed once for each of its bits, with that bit taken out: two segments at most
one bit apart share such a variant. Where the lower ones differ in both bits the upper ones are equal, so they
are indexed whole. Fingerprints that share an index entry, a variant, meet by an equality join and are verified over all
64 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import arrow_function, bounded_batches, checkpointed, joined_by_share
from brindle.llm.components import components
from brindle.session import kept

SHINGLE_WORDS = 3
SEED = 42
#: Two segments and the stars of crowded groups are made for two differing bits.
RADIUS = 2
#: Variants shared by more fingerprints than this are not paired but taken apart exactly by ``_crowded_links``.
PAIRED = 32

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint(text: str | None, words_in_shingle: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """The unsigned fingerprint of one text; 0 for null and for texts without words."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    n = max(len(words) - words_in_shingle + 1, 1)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(words_in_shingle)))) if n > 1 or len(words) == words_in_shingle else [b" ".join(words)]
    total, block = np.zeros(64, np.int64), []

    def add() -> None:
        bits = np.unpackbits(np.array(block, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total.__iadd__(bits.sum(0, dtype=np.int64))
        block.clear()

    for s in shingles:
        block.append(xxhash.xxh64_intdigest(s, seed))
        if len(block) == 65_536:
            add()
    if block:
        add()
    return int.from_bytes(np.packbits(total * 2 > n, bitorder="little").tobytes(), "little")


@arrow_function(pa.int64())
def _fingerprints(texts: pa.Array) -> pa.Array:
    return pa.array(np.array([fingerprint(t) for t in texts.to_pylist()], np.uint64).view(np.int64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint of every row of ``docs`` as a signed long; 0 for null, empty and blank texts."""
    bounded_batches(docs.sparkSession)
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), _fingerprints(F.col(f"`{text_col}`")).alias("fp"))


def _variants(fps: DataFrame) -> DataFrame:
    """(key, fp): a key for each of the lower 32 bits: which bit is taken out, and the rest of the lower segment; and one for the whole upper segment."""
    v = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(32))).alias("v"))
    return v.select(F.expr("shiftleft(CAST(v AS BIGINT), 32) | CASE WHEN v < 32 THEN fp & 4294967295L & ~shiftleft(1L, v) ELSE shiftrightunsigned(fp, 32) END").alias("key"), "fp")


def _near(a: str, b: str):
    return F.expr(f"bit_count({a} ^ {b}) <= {RADIUS}")


def _crowded_links(fps: DataFrame) -> DataFrame:
    """All links of ``fps`` up to two bits, as stars: two fingerprints are at most two bits apart just when some word of 64 bits is within one bit of both.

    Each of those words has at most 65 fingerprints around it, so its group is bounded, and the rows are 65 for each fingerprint however many of them lie together.
    """
    points = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(64))).alias("v")).select("fp", F.expr("CASE WHEN v = 64 THEN fp ELSE fp ^ shiftleft(1L, v) END").alias("point"))
    around = points.groupBy("point").agg(F.min("fp").alias("a"), F.collect_list("fp").alias("all")).where("size(all) > 1")
    return around.select("a", F.explode("all").alias("b")).where("a != b").distinct()


def links(fps: DataFrame, paired: int = PAIRED) -> DataFrame:
    """(a, b): links between the distinct fingerprints ``fps`` (fp), which join exactly those that chains of steps of at most RADIUS bits join.

    A variant that two fingerprints share gives its pair straight from the aggregate; one shared by up to
    ``paired`` is joined with itself, and every pair is verified. The fingerprints of variants that still more share
    are linked by ``_crowded_links``, so that no group is ever expanded into all its pairs.
    """
    variants = _variants(fps)
    shared = checkpointed(variants.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"))
    twos = shared.where("n = 2").select("a", "b").where(_near("a", "b"))
    few = shared.where(F.col("n").between(3, paired)).select("key")
    met = variants.join(few, "key")
    pairs = met.select("key", F.col("fp").alias("a")).join(met.select("key", F.col("fp").alias("b")), "key").where("a < b").where(_near("a", "b")).select("a", "b")
    crowded = joined_by_share(variants, shared.where(F.col("n") > paired), "key", 33 * fps.count()).select("fp").distinct()
    return twos.union(pairs).union(_crowded_links(crowded)).distinct()


def _heads(prints: DataFrame, *more) -> DataFrame:
    """(fp, n, head, ...) for each distinct fingerprint of ``prints`` (doc_id, fp): its rows and its smallest doc_id. more: other aggregates."""
    return checkpointed(prints.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("head"), *more))


def _classes(heads: DataFrame) -> tuple[DataFrame, int]:
    """(heads with component_id, the smallest doc_id that is reachable from each fingerprint; how many rows all heads have)."""
    rows = heads.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    roots = components(links(heads.select("fp"))).select(F.col("node").alias("fp"), "root")
    linked = checkpointed(heads.select("fp", "head").join(roots, "fp"))
    least = checkpointed(linked.groupBy("root").agg(F.count("*").alias("n"), F.min("head").alias("component_id")))
    classes = joined_by_share(linked.select("fp", "root"), least, "root", linked.count()).select("fp", "component_id")
    return checkpointed(heads.join(classes, "fp", "left").withColumn("component_id", F.coalesce("component_id", "head"))), rows


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``; component_id is the smallest doc_id reachable through links, itself included.

    Nulls: a null text has no words and so fingerprint 0, which links like any other; a null doc_id is kept but is
    never a component_id unless its whole component has no other. Repeated rows stay repeated. No rows: no rows.
    Extra columns are not read.
    """
    prints = checkpointed(fingerprints(docs, id_col, text_col))
    classes, rows = _classes(_heads(prints))
    return joined_by_share(prints, classes, "fp", rows).select("doc_id", "fp", "component_id")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all their columns, of which one stays for each component: the one with the smallest doc_id.

    Of repeated rows with one doc_id and one fingerprint one stays. Where every doc_id of a component is null, one row
    stays for each of its fingerprints. Rows are written once, as Parquet, with their fingerprints and numbers, and read whole once, for the result; all that is decided reads only the
    fingerprints, ids and numbers.
    """
    bounded_batches(docs.sparkSession)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = kept(docs.select(whole.alias("row"), F.col(f"`{id_col}`").alias("doc_id"), F.monotonically_increasing_id().alias("at"), _fingerprints(F.col(f"`{text_col}`")).alias("fp")))
    heads = _heads(rows.select("doc_id", "fp", "at"), F.min_by("at", F.struct(F.col("doc_id").isNull(), "doc_id", "at")).alias("first"))
    classes, n = _classes(heads)
    # gone is written first, so that its size is known before the rows are read: they are shuffled only if it is too large to be sent to them
    stays = classes.select("fp", "n", F.when(F.col("head").eqNullSafe(F.col("component_id")), F.col("first")).alias("first"))
    gone = kept(joined_by_share(rows.select("fp", "at"), stays, "fp", n).where("first IS NULL OR at != first").select("at"))
    return rows.join(gone, "at", "left_anti").select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
