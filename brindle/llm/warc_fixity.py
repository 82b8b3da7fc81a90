"""Fixity audit of WARC replicas by Merkle trees.

A manifest gives each archive's records by offset. In a replica every record is hashed, records whose offsets lie in one
range of RANGE_BYTES are hashed together in order, and FANOUT neighbouring ranges at a time up to one root for each archive. Two
replicas are compared at their roots first; only below nodes that differ are the next ones compared, down to the records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.common import checkpointed

#: A range holds no more records than fit in so many bytes, and a node has so many children at most.
RANGE_BYTES, FANOUT = 1 << 16, 16
ARCHIVE_PAGES = 1_000
#: Archives for pages without an id.
NAMELESS = 4_096


def record(url: Column, html: Column) -> Column:
    """A page as a WARC response record; null is empty."""
    html, url = F.coalesce(html, F.lit("")), F.coalesce(url, F.lit(""))
    lines = F.concat_ws("\r\n", F.lit("WARC/1.1"), F.lit("WARC-Type: response"), F.concat(F.lit("WARC-Target-URI: "), url), F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.sha2(html, 256)), F.lit("Content-Type: text/html"), F.concat(F.lit("Content-Length: "), F.octet_length(html).cast("string")))
    return F.concat(lines, F.lit("\r\n\r\n"), html, F.lit("\r\n\r\n"))


def archive_of(page_id: Column, url: Column, pages: int = ARCHIVE_PAGES) -> Column:
    """Pages go to archives by runs of their ids; those without an id go to one of NAMELESS archives, -1, -2 and so on, by a hash of their url."""
    return F.coalesce(F.floor(page_id / pages), -1 - F.pmod(F.crc32(F.coalesce(url, F.lit("")).cast("binary")), F.lit(NAMELESS))).cast("long")


def manifest(records: DataFrame) -> DataFrame:
    """``records`` (archive, page_id, url, length, digest, ...) with ``offset``: where each begins in its archive, which holds them by page_id, url and digest.

    Only these narrow rows are sorted, never the records.
    """
    before = Window.partitionBy("archive").orderBy(F.col("page_id").asc_nulls_first(), F.col("url").asc_nulls_first(), "digest").rowsBetween(Window.unboundedPreceding, -1)
    return records.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))


def _ranges(leaves: DataFrame) -> DataFrame:
    """(archive, at, hash) of the lowest nodes of a replica's tree."""
    in_order = F.array_join(F.array_sort(F.collect_list(F.struct("offset", "length", "digest"))).cast("array<string>"), "\n")
    return leaves.groupBy("archive", F.floor(F.col("offset") / RANGE_BYTES).cast("long").alias("at")).agg(F.sha2(in_order, 256).alias("hash"))


def _above(nodes: DataFrame) -> DataFrame:
    in_order = F.array_join(F.array_sort(F.collect_list(F.struct("at", "hash"))).cast("array<string>"), "\n")
    return nodes.groupBy("archive", F.floor(F.col("at") / FANOUT).cast("long").alias("up")).agg(F.sha2(in_order, 256).alias("hash")).withColumnRenamed("up", "at")


def tree(leaves: DataFrame) -> list[DataFrame]:
    """The levels (archive, at, hash) of a replica's trees, ranges first, as many as the longest archive needs to come to one root."""
    ranges = checkpointed(_ranges(leaves))
    most = (ranges.agg(F.max("at")).first()[0] or 0) + 1
    levels = [ranges]
    while most > 1:
        levels.append(checkpointed(_above(levels[-1])))  # read by the level above and by the descent
        most = -(-most // FANOUT)
    return levels


def _differing(a: DataFrame, b: DataFrame) -> DataFrame:
    pairs = a.select("archive", "at", F.col("hash").alias("__a")).join(b.select("archive", "at", F.col("hash").alias("__b")), ["archive", "at"], "full")
    return pairs.where(~F.col("__a").eqNullSafe(F.col("__b"))).select("archive", "at")


def audit(first: DataFrame, second: DataFrame) -> DataFrame:
    """Records that differ between two replicas, each given by its leaves (archive, offset, length, digest).

    Returns (archive, offset, length, digest, found_length, found_digest, status): ``changed``, ``missing`` (not in the second replica) or ``extra``
    (only there). Replicas without differences give no rows. Two records at one offset of a replica are compared in the order of length and digest.
    """
    a, b = tree(first), tree(second)
    while len(a) < len(b):
        a.append(_above(a[-1]))
    while len(b) < len(a):
        b.append(_above(b[-1]))
    bad = _differing(a[-1], b[-1])
    for low_a, low_b in zip(a[-2::-1], b[-2::-1]):
        parents = bad.select("archive", F.col("at").alias("__up"))
        below = lambda nodes: nodes.withColumn("__up", F.floor(F.col("at") / FANOUT).cast("long")).join(parents, ["archive", "__up"], "left_semi")  # noqa: B023, E731
        bad = _differing(below(low_a), below(low_b))
    bad = checkpointed(bad).withColumnRenamed("at", "__range")

    def suspects(leaves: DataFrame) -> DataFrame:
        rows = leaves.select("archive", "offset", "length", "digest").withColumn("__range", F.floor(F.col("offset") / RANGE_BYTES).cast("long")).join(bad, ["archive", "__range"], "left_semi")
        return rows.withColumn("__k", F.row_number().over(Window.partitionBy("archive", "offset").orderBy("length", "digest"))).drop("__range")

    found = suspects(second).select("archive", "offset", "__k", F.col("length").alias("found_length"), F.col("digest").alias("found_digest"))
    both = suspects(first).join(found, ["archive", "offset", "__k"], "full")
    status = F.when(F.col("digest").isNull(), "extra").when(F.col("found_digest").isNull(), "missing").otherwise("changed")
    return both.where(~F.col("digest").eqNullSafe(F.col("found_digest")) | ~F.col("length").eqNullSafe(F.col("found_length"))).select("archive", "offset", "length", "digest", "found_length", "found_digest", status.alias("status"))


def damaged(page_id: Column, html: Column) -> Column:
    """A copy of a page with one character changed where page_id % 97 is 13, and null, a lost record, where page_id % 1009 is 7: what the registered query looks for."""
    return F.when(page_id % 1009 == 7, F.lit(None)).when(page_id % 97 == 13, F.concat(F.substring(html, 1, 40), F.lit("#"), F.substring(html, 42, 2_000_000_000))).otherwise(html)


def audited_pages(pages: DataFrame) -> DataFrame:
    """Archives of ``pages`` against a replica with planted damage; the rows of ``audit`` with the page_id of each record.

    The replica is read by the manifest of the archives, so its records have the offsets and lengths found there.
    """
    html = F.coalesce("html", F.lit(""))
    lost = damaged(F.coalesce("page_id", F.lit(0)), html)
    whole = record(F.col("url"), html)
    rows = pages.select(archive_of(F.col("page_id"), F.col("url")).alias("archive"), "page_id", "url", F.octet_length(whole).cast("long").alias("length"), F.sha2(whole, 256).alias("digest"), F.when(lost.isNotNull(), F.sha2(record(F.col("url"), lost), 256)).alias("copy"))
    placed = checkpointed(manifest(rows).drop("url"))
    replica = placed.where("copy IS NOT NULL").select("archive", "offset", "length", F.col("copy").alias("digest"))
    found = audit(placed.select("archive", "offset", "length", "digest"), replica)
    return found.join(placed.select("archive", "offset", "page_id"), ["archive", "offset"]).select("page_id", *found.columns)


ORACLE = """
    WITH p AS (
        SELECT page_id, url, coalesce(html, '') AS html, coalesce(floor(page_id / 1000), -1)::BIGINT AS archive,
            CASE WHEN page_id % 1009 = 7 THEN NULL WHEN page_id % 97 = 13 THEN substr(coalesce(html, ''), 1, 40) || '#' || substr(coalesce(html, ''), 42)
                 ELSE coalesce(html, '') END AS copy_html FROM pages
    ), r AS (
        SELECT *, concat('WARC/1.1', chr(13), chr(10), 'WARC-Type: response', chr(13), chr(10), 'WARC-Target-URI: ', url, chr(13), chr(10), 'WARC-Payload-Digest: sha256:') AS head,
            concat(chr(13), chr(10), 'Content-Type: text/html', chr(13), chr(10), 'Content-Length: ') AS mid, concat(chr(13), chr(10), chr(13), chr(10)) AS gap FROM p
    ), d AS (
        SELECT archive, page_id, url, concat(head, sha256(html), mid, strlen(html), gap, html, gap) AS whole,
            CASE WHEN copy_html IS NOT NULL THEN sha256(concat(head, sha256(copy_html), mid, strlen(copy_html), gap, copy_html, gap)) END AS found_digest FROM r
    ), m AS (
        SELECT archive, page_id, strlen(whole)::BIGINT AS length, sha256(whole) AS digest, found_digest,
            coalesce(sum(strlen(whole)) OVER (PARTITION BY archive ORDER BY page_id NULLS FIRST, url NULLS FIRST, sha256(whole) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset"
        FROM d
    )
    SELECT page_id, archive, "offset", length, digest, CASE WHEN found_digest IS NOT NULL THEN length END AS found_length, found_digest,
        CASE WHEN found_digest IS NULL THEN 'missing' ELSE 'changed' END AS status
    FROM m WHERE found_digest IS DISTINCT FROM digest
"""
