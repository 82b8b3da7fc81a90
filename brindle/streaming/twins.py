"""Streaming twins of batch operators: on the same files they end with the same rows.

Each takes a stream of files and runs until all that is there has been read. State and sinks lie in the shared work folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from brindle.operators.ledger import KEY, delta
from brindle.registry import query
from brindle.session import kept
from brindle.sources.io import work_folder
from brindle.sources.versions import KeyedTable


def streamed(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """A table written as files, by the tasks that have its rows, and read back as a stream of some of them at a time."""
    path = f"{work_folder(spark)}/in"
    rows.write.parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 4).parquet(path)


def drained(stream: DataFrame, mode: str, each: Callable[[DataFrame, int], None], state: str | None = None) -> StreamingQuery:
    """Runs a stream over all there is; each: what to do with a batch and its number. state: the folder from which a stream that was run before goes on."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", state or f"{work_folder(stream.sparkSession)}/state").trigger(availableNow=True)
    query = writer.foreachBatch(each).start()
    query.awaitTermination()
    return query


def numbered(changed: DataFrame, batch: int, path: str) -> None:
    changed.withColumn("batch", F.lit(batch)).write.mode("append").parquet(path)


def latest_rows(changes: DataFrame, keys: list[str]) -> DataFrame:
    """Each key's row of its latest batch."""
    values = [c for c in changes.columns if c not in (*keys, "batch")]
    latest = changes.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("b"))
    return latest.select(*keys, *[F.col(f"b.{c}").alias(c) for c in values])


def _added(c: str) -> Column:
    return F.col(f"old.{c}") + F.col(f"new.{c}") if c == "balance" else F.greatest(f"old.{c}", f"new.{c}")


def post_movements(table: KeyedTable, movements: DataFrame, batch: int | None = None) -> None:
    """Adds a batch of movements to the balances of the shelves that they name. A batch that is in the table already changes nothing."""
    sums = movements.groupBy(*KEY).agg(F.sum(delta()).cast("long").alias("balance"), F.max("created_at").alias("last_updated"))
    table.upsert(sums, _added, batch)


def streaming_balances(movements: DataFrame, table: KeyedTable, state: str | None = None) -> StreamingQuery:
    """Keeps a table of balances from a stream of movements. The running sums are in the table, so the stream itself has no state, and a batch rewrites the buckets that it touches."""
    return drained(movements, "append", lambda df, n: post_movements(table, df, n), state)


@query("o01_streaming_balances", "SELECT * FROM balances")
def balances_from_stream(spark: SparkSession, stock_movements: DataFrame) -> DataFrame:
    table = KeyedTable(spark, f"{work_folder(spark)}/balances", KEY, buckets=8)
    streaming_balances(streamed(spark, stock_movements.select("product_id", "warehouse_id", "movement_type", "quantity", "created_at")), table)
    return table.read()


PURCHASE_KEYS = ["source", "order_key", "device"]


def first_purchases(purchases: DataFrame, table: KeyedTable, late: str = "2 days", horizon_days: int = 2, state: str | None = None) -> StreamingQuery:
    """Keeps the earliest purchase of each (source, order, device), whatever order events arrive in.

    The stream remembers the least purchase of each key and span of ``horizon_days``, and lets through what is new or earlier than that, so that repeats, which are nearly all, don't
    reach the table; a span's state ends behind the watermark. Rows that the watermark may have shut out of it (the table notes the latest event time of the batches before) go to the
    table as they are. The table keeps the earlier one of what it has and what it gets, so a purchase that comes when its state has ended still ends right.
    """
    known = purchases.where("event_timestamp IS NOT NULL").withColumn("at", F.col("event_timestamp").cast("timestamp")).withColumn("arrived", F.current_timestamp())
    span = F.window("at", f"{horizon_days} days")
    least = known.withWatermark("at", late).groupBy(span, *PURCHASE_KEYS).agg(F.min(F.struct("event_timestamp", "event_key", "arrived")).alias("f"))
    news = least.where(F.col("f.arrived") == F.current_timestamp())  # the time of the batch: what it hasn't changed is older
    value = ["event_timestamp", "event_key"]
    both = news.select(*PURCHASE_KEYS, *[f"f.{c}" for c in value], F.lit(True).alias("is_new")).unionByName(known.select(*PURCHASE_KEYS, *value, F.lit(False).alias("is_new")))
    earlier = lambda c: F.least(F.struct("old.event_timestamp", "old.event_key"), F.struct("new.event_timestamp", "new.event_key"))[c]

    def each(df: DataFrame, n: int) -> None:
        latest, seen = table.manifest()["notes"].get("latest"), Observation()
        shut_out = F.lit(False) if latest is None else F.col("event_timestamp") < F.lit(latest).cast("timestamp_ntz")
        rows = kept(df.observe(seen, F.max("event_timestamp").cast("string").alias("latest")).where(F.col("is_new") | shut_out))
        first = rows.groupBy(*PURCHASE_KEYS).agg(F.min(F.struct(*value)).alias("f"))
        until = max(filter(None, (latest, seen.get["latest"])), default=None)
        if table.upsert(first.select(*PURCHASE_KEYS, "f.*"), earlier, n, {"latest": until}) is None and until != latest:
            table.note({"latest": until})

    return drained(both, "update", each, state)


@query("o02_streaming_first_purchase", "SELECT event_key FROM int_purchases WHERE NOT is_duplicate_purchase")
def first_purchases_from_stream(spark: SparkSession, flat_events: DataFrame) -> DataFrame:
    bought = flat_events.where("event_name = 'purchase'").select("source", "event_key", "event_timestamp", F.coalesce("transaction_id", F.concat(F.lit("no-transaction-id:"), "event_key")).alias("order_key"), F.coalesce("user_pseudo_id", F.lit("")).alias("device"))
    table, base = KeyedTable(spark, f"{work_folder(spark)}/first", PURCHASE_KEYS, buckets=8), work_folder(spark)
    for part in arriving(bought, "event_timestamp"):
        part.write.mode("append").parquet(f"{base}/in")
        first_purchases(spark.readStream.schema(bought.schema).parquet(f"{base}/in"), table, state=f"{base}/state")
    return table.read().select("event_key")


def daily(rows: DataFrame, at: str, keys: list[str], aggs: list, late: str = "4 days") -> DataFrame:
    """Aggregates by day and keys. The watermark says how late a row may be; rows that are later are left out in append and update mode."""
    return rows.withColumn("__at", F.col(at).cast("timestamp")).withWatermark("__at", late).groupBy(F.window("__at", "1 day"), *keys).agg(*aggs)


def arriving(rows: DataFrame, at: str, parts: int = 4) -> list[DataFrame]:
    """A table in parts by time, as it would have arrived; rows without a time come last. Only the bounds of the parts are read here."""
    rows = kept(rows)
    moment = F.unix_micros(F.col(at).cast("timestamp"))
    bounds = rows.agg(F.percentile_approx(moment, [i / parts for i in range(1, parts)], 1000)).first()[0] or []
    part = F.when(moment.isNull(), len(bounds)).otherwise(sum((F.when(moment > b, 1).otherwise(0) for b in bounds), F.lit(0)))
    return [rows.where(part == i) for i in range(len(bounds) + 1)]


def fed(arrivals: list[DataFrame], state, keys: list[str]) -> DataFrame:
    """What state(stream), an aggregate with a watermark, ends with when the arrivals come one after another; the stream stops and goes on between them.

    In update mode a batch writes only the keys that it changed, and state behind the watermark is let go.
    """
    spark = arrivals[0].sparkSession
    base = work_folder(spark)
    for part in arrivals:
        part.write.mode("append").parquet(f"{base}/in")
        stream = state(spark.readStream.schema(part.schema).parquet(f"{base}/in"))
        drained(stream, "update", lambda df, n: numbered(df, n, f"{base}/out"), f"{base}/state")
    return latest_rows(spark.read.parquet(f"{base}/out"), keys)


@query("o03_streaming_daily_rollup", "SELECT created_at::DATE AS day, movement_type, count(*) AS movements, sum(quantity)::BIGINT AS quantity FROM stock_movements GROUP BY 1, 2")
def daily_rollup_from_stream(spark: SparkSession, stock_movements: DataFrame) -> DataFrame:
    rows = arriving(stock_movements.select("movement_type", "quantity", "created_at"), "created_at")
    aggs = [F.count("*").alias("movements"), F.sum("quantity").alias("quantity")]
    got = fed(rows, lambda stream: daily(stream, "created_at", ["movement_type"], aggs), ["window", "movement_type"])
    return got.select(F.col("window.start").cast("date").alias("day"), "movement_type", "movements", "quantity")


@query("o04_streaming_device_days", "SELECT source, user_pseudo_id, event_date, array_to_string(user_ids, ',') AS user_ids, first_seen_at, last_seen_at, events FROM int_device_days")
def device_days_from_stream(spark: SparkSession, flat_events: DataFrame) -> DataFrame:
    rows = arriving(flat_events.where("user_pseudo_id IS NOT NULL").select("source", "user_pseudo_id", "user_id", "event_timestamp"), "event_timestamp")
    aggs = [F.array_sort(F.collect_set("user_id")).alias("user_ids"), F.min("event_timestamp").alias("first_seen_at"), F.max("event_timestamp").alias("last_seen_at"), F.count("*").alias("events")]
    keys = ["source", "user_pseudo_id"]
    got = fed(rows, lambda stream: daily(stream, "event_timestamp", keys, aggs), ["window", *keys])
    return got.select("source", "user_pseudo_id", F.col("window.start").cast("date").alias("event_date"), F.array_join("user_ids", ",").alias("user_ids"), "first_seen_at", "last_seen_at", "events")
