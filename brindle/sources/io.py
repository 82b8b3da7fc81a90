"""Sources and sinks: partitioned tables, day-sharded exports, replaced windows, bulk inserts and hit logs.

The registered queries write what they read to a work folder under the shared folder, so that the sinks are run as they are on a cluster.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.registry import query
from brindle.session import shared_folder
from brindle.sources.versions import VersionedTable


def work_folder(spark: SparkSession) -> str:
    """A new folder that all executors share."""
    return f"{shared_folder(spark)}/work-{uuid.uuid4().hex}"


def scan(spark: SparkSession, path: str, columns: list[str] | None = None, where: str | None = None) -> DataFrame:
    """A table with only the columns and rows that are asked for; both reach the Parquet reader."""
    df = spark.read.parquet(path)
    df = df.where(where) if where else df
    return df.select(*columns) if columns else df


def write_partitioned(df: DataFrame, path: str, by: str, sort: list[str] | None = None, mode: str = "overwrite") -> None:
    """Few files for each value of ``by``: rows of a value are brought together first, so tasks times values small files never arise, and a value that many rows have is split among tasks again by its size."""
    rows = df.hint("rebalance", by)
    (rows.sortWithinPartitions(by, *sort) if sort else rows).write.mode(mode).partitionBy(by).parquet(path)


def replace_partitions(df: DataFrame, path: str, by: str) -> None:
    """Replaces the partitions that ``df`` has rows for and leaves all others as they are, in one step: readers see the table before or after, see ``versions``."""
    VersionedTable(df.sparkSession, path).replace(df, F.col(by))


def current(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of a table that ``replace_partitions`` writes."""
    return VersionedTable(spark, path).read()


#: Each column's values are told apart by 2^CURVE_BITS quantiles.
CURVE_BITS = 5


def _number(df: DataFrame, c: str) -> Column:
    """A number in the order of the column's values: of text its first six bytes."""
    kind = df.schema[c].dataType.typeName()
    if kind == "string":
        return F.conv(F.rpad(F.hex(F.substring(F.col(c).cast("binary"), 1, 6)), 12, "0"), 16, 10).cast("double")
    return F.unix_micros(F.col(c).cast("timestamp")).cast("double") if kind in ("date", "timestamp", "timestamp_ntz") else F.col(c).cast("double")


def curve(df: DataFrame, columns: list[str], bits: int = CURVE_BITS) -> Column:
    """A row's place on a space-filling curve through ``columns``: the bits of the columns' quantiles in turn. Rows that lie near each other on it are near in all the columns. Nulls count as least."""
    steps = [i / 2**bits for i in range(1, 2**bits)]
    bounds = df.agg(*[F.percentile_approx(_number(df, c), steps, 10_000).alias(f"b{i}") for i, c in enumerate(columns)]).first()
    place = F.lit(0).cast("long")
    for i, c in enumerate(columns):
        known = F.array(*[F.lit(float(b)) for b in sorted(set(bounds[i] or ()))])
        at = F.coalesce(F.size(F.filter(known, lambda b: b < _number(df, c))), F.lit(0)).cast("long")  # noqa: B023
        for bit in range(bits):
            place = place.bitwiseOR(F.shiftleft(F.shiftright(at, bit).bitwiseAND(F.lit(1)), bit * len(columns) + len(columns) - 1 - i))
    return place


def write_clustered(df: DataFrame, path: str, by: str, columns: list[str], files: int | None = None) -> None:
    """Partitioned by ``by``, and inside along a curve through ``columns``: a filter on any of them finds most files' statistics outside its bounds. files: how many ranges the rows are dealt to, else as many as shuffles have."""
    rows = df.withColumn("__place", curve(df, columns))
    ranged = rows.repartitionByRange(files, by, "__place") if files else rows.repartitionByRange(by, "__place")
    ranged.sortWithinPartitions(by, "__place").drop("__place").write.partitionBy(by).parquet(path)


def read_days(spark: SparkSession, path: str, start: str, end: str, day: str = "day") -> DataFrame:
    """The days from start to end of a table with a folder for each day; other folders aren't opened."""
    return spark.read.parquet(path).where(F.col(day).between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def expire(spark: SparkSession, path: str, values: list[str]) -> None:
    """Drops partitions in one step; no row is read or written."""
    VersionedTable(spark, path).expire(values)


def insert_new(existing: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """The rows whose key is not there yet, each key once: what an insert that ignores conflicts adds."""
    return rows.dropDuplicates(key).join(existing.select(*key), key, "left_anti")


def daily_over_intraday(listing: DataFrame) -> DataFrame:
    """Of a listing (day, kind: daily or intraday, path) the daily table of each day, or its intraday one where there is no daily."""
    daily = listing.where("kind = 'daily'")
    return daily.unionByName(listing.where("kind = 'intraday'").join(daily.select("day"), "day", "left_anti"))


def union_sources(*named: tuple[str, DataFrame]) -> DataFrame:
    """Tables of one kind with different columns as one, with the name of each row's source; what a source lacks is null."""
    out = None
    for name, df in named:
        one = df.withColumn("source", F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


@query("a01_scan", "SELECT count(*) AS rows, sum(l_orderkey)::BIGINT AS keys FROM lineitem")
def scanned(lineitem: DataFrame) -> DataFrame:
    return lineitem.agg(F.count("*").alias("rows"), F.sum("l_orderkey").alias("keys"))


@query("a02_day_shards", "SELECT event_id, ts::DATE AS day FROM events WHERE ts::DATE BETWEEN DATE '2024-01-10' AND DATE '2024-01-12'")
def day_shards(spark: SparkSession, events: DataFrame) -> DataFrame:
    path = work_folder(spark)
    write_partitioned(events.select("event_id", F.col("ts").cast("date").alias("day")), path, "day")
    return read_days(spark, path, "2024-01-10", "2024-01-12")


@query("a03_daily_over_intraday", "SELECT day, CASE WHEN extract(day FROM day) % 3 = 0 THEN 'intraday' ELSE 'daily' END AS kind FROM (SELECT DISTINCT ts::DATE AS day FROM events)")
def export_choice(events: DataFrame) -> DataFrame:
    """Over a listing with an intraday table for each day and a daily one for most."""
    days = events.select(F.col("ts").cast("date").alias("day")).distinct()
    listing = days.where(F.dayofmonth("day") % 3 != 0).withColumn("kind", F.lit("daily")).unionByName(days.withColumn("kind", F.lit("intraday")))
    return daily_over_intraday(listing)


@query("a04_union_sources", "SELECT 'customers' AS source, c_name AS name, c_mktsegment AS segment, NULL::DOUBLE AS balance FROM customer UNION ALL SELECT 'suppliers', s_name, NULL, s_acctbal FROM supplier")
def parties(customer: DataFrame, supplier: DataFrame) -> DataFrame:
    return union_sources(("customers", customer.select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))), ("suppliers", supplier.select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))))


@query("a05_pruned_read", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 400000")
def large_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, f"{sf_dir}/orders.parquet", ["o_orderkey", "o_totalprice"], "o_totalprice > 400000")


@query("a06_partitioned_sink", "SELECT o_orderstatus AS status, count(*) AS orders FROM orders GROUP BY 1")
def orders_by_status(spark: SparkSession, orders: DataFrame) -> DataFrame:
    path = work_folder(spark)
    write_partitioned(orders.withColumnRenamed("o_orderstatus", "status"), path, "status")
    return spark.read.parquet(path).groupBy("status").agg(F.count("*").alias("orders"))


@query("a07_clustered_table", "SELECT movement_type, min(product_id) AS first_product, count(*) AS movements FROM stock_movements GROUP BY 1")
def clustered_ledger(spark: SparkSession, stock_movements: DataFrame) -> DataFrame:
    """Partitioned by type and clustered by product and time inside."""
    path = work_folder(spark)
    write_clustered(stock_movements.select("movement_type", "product_id", "quantity", "created_at"), path, "movement_type", ["product_id", "created_at"])
    return spark.read.parquet(path).groupBy("movement_type").agg(F.min("product_id").alias("first_product"), F.count("*").alias("movements"))


@query("a08_replace_partitions", "SELECT ts::DATE AS day, count(*) * CASE WHEN ts::DATE >= DATE '2024-01-20' THEN 0 ELSE 1 END + CASE WHEN ts::DATE >= DATE '2024-01-20' THEN count(*) FILTER (event_type = 'purchase') ELSE 0 END AS events FROM events GROUP BY 1")
def replaced_window(spark: SparkSession, events: DataFrame) -> DataFrame:
    """The days from the 20th on are written again with purchases only."""
    path = work_folder(spark)
    rows = events.select("event_id", "event_type", F.col("ts").cast("date").alias("day"))
    replace_partitions(rows, path, "day")
    replace_partitions(rows.where("day >= DATE'2024-01-20' AND event_type = 'purchase'"), path, "day")
    return current(spark, path).groupBy("day").agg(F.count("*").alias("events"))


@query("a09_monthly_ledger", "SELECT date_trunc('month', created_at)::DATE AS month, count(*) AS movements FROM stock_movements GROUP BY 1")
def monthly_ledger(spark: SparkSession, stock_movements: DataFrame) -> DataFrame:
    path = work_folder(spark)
    write_partitioned(stock_movements.select("movement_id", F.trunc("created_at", "month").alias("month")), path, "month")
    return spark.read.parquet(path).groupBy("month").agg(F.count("*").alias("movements"))


@query("a10_partition_expiry", "SELECT count(*) AS movements, min(date_trunc('year', created_at))::DATE AS first_year FROM stock_movements WHERE created_at >= (SELECT min(date_trunc('year', created_at)) + INTERVAL 1 YEAR FROM stock_movements)")
def expired_ledger(spark: SparkSession, stock_movements: DataFrame) -> DataFrame:
    """A ledger by year whose first year is dropped: only the manifest changes, no row is rewritten."""
    path = work_folder(spark)
    replace_partitions(stock_movements.select("movement_id", F.trunc("created_at", "year").alias("year")), path, "year")
    expire(spark, path, [min(VersionedTable(spark, path).manifest()["slices"])])
    return current(spark, path).agg(F.count("*").alias("movements"), F.min("year").alias("first_year"))


@query("a11_json_rows", "SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events")
def parsed_props(events: DataFrame) -> DataFrame:
    """JSON text with a declared schema; nothing is inferred."""
    return events.select("event_id", F.from_json("props", "k long").getField("k").alias("k"))


@query("a13_insert_new", "SELECT c_custkey AS id, c_nationkey AS nation FROM customer WHERE c_custkey % 2 = 1")
def missing_customers(customer: DataFrame) -> DataFrame:
    rows = customer.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"))
    return insert_new(rows.where("id % 2 = 0"), rows.union(rows.where("id % 5 = 0")), ["id"])


def hits(bodies: DataFrame, body: str = "body") -> DataFrame:
    """Logged request bodies, a line for each hit of url-encoded pairs, as one row for each hit with decoded, typed columns and its items (pr1, pr2, ...: id~name~quantity)."""
    lines = bodies.withColumn("hit", F.explode(F.split(body, "\n"))).where("hit <> ''").withColumn("p", F.str_to_map("hit", F.lit("&"), F.lit("=")))
    at = lambda key: F.try_url_decode(F.try_element_at("p", F.lit(key)))
    items = F.transform(F.filter(F.map_keys("p"), lambda k: k.rlike("^pr[0-9]+$")), lambda k: F.split(F.try_url_decode(F.try_element_at("p", k)), "~"))
    item = F.transform(F.array_sort(items), lambda x: F.struct(F.get(x, 0).alias("item_id"), F.get(x, 1).alias("item_name"), F.get(x, 2).try_cast("int").alias("quantity")))
    return lines.select(*[c for c in bodies.columns if c != body], at("en").alias("event_name"), at("dl").alias("page_location"), at("epn.value").try_cast("double").alias("value"), item.alias("items"))


def _encoded(c: Column) -> Column:
    return F.url_encode(c.cast("string"))


@query("a14_hit_log", "SELECT user_id, event_type AS event_name, 'https://shop.example/?q=' || event_id || '&x=' || event_type AS page_location, value, event_id % 3 AS n_items, CASE WHEN event_id % 3 > 0 THEN 'item & ' || event_id END AS first_item FROM events")
def logged_hits(events: DataFrame) -> DataFrame:
    """From a log with one body for each user and hour that holds all its hits."""
    line = F.concat(F.lit("en="), _encoded(F.col("event_type")), F.lit("&dl="), _encoded(F.concat(F.lit("https://shop.example/?q="), "event_id", F.lit("&x="), "event_type")), F.lit("&epn.value="), "value",
        F.when(F.col("event_id") % 3 > 0, F.concat(F.lit("&pr1="), _encoded(F.concat(F.lit("1~item & "), "event_id", F.lit("~2"))))).otherwise(""), F.when(F.col("event_id") % 3 > 1, "&pr2=2~other~1").otherwise(""))
    log = events.groupBy("user_id", F.date_trunc("hour", "ts").alias("hour")).agg(F.array_join(F.collect_list(line), "\n").alias("body"))
    got = hits(log)
    return got.select("user_id", "event_name", "page_location", "value", F.size("items").cast("long").alias("n_items"), F.get("items", F.lit(0)).getField("item_name").alias("first_item"))
