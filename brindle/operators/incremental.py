"""Incremental maintenance: which days changed, and how each table follows from its last state and the new days.

The registered queries work on two states of the event export: an early one without the last days and
some late events, and the given one. What they make of both must equal a full build.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.operators import orders, staging
from brindle.operators.diff import same_rows, table_diff
from brindle.operators.relational import symmetric_difference
from brindle.registry import TABLES, query, table
from brindle.session import kept

SINCE, LOOK_BACK_DAYS = "2024-01-20", 4


@table(f"SELECT * FROM flat_events WHERE event_date < DATE '2024-01-25' AND NOT (event_date >= DATE '{SINCE}' AND event_id % 13 = 0)")
def early_events(flat_events: DataFrame) -> DataFrame:
    return flat_events.where(f"event_date < DATE'2024-01-25' AND NOT (event_date >= DATE'{SINCE}' AND event_id % 13 = 0)")


def _early(name: str) -> str:
    sql = TABLES[name][1]
    for full in ("flat_events", "stg_events", "int_purchases", "int_device_days", "int_identity", "fct_sessions"):
        sql = re.sub(rf"\b{full}\b", "early_" + full.replace("flat_events", "events"), sql)
    return sql


@table(_early("stg_events"))
def early_stg_events(early_events: DataFrame) -> DataFrame:
    return staging.stg_events(early_events)


@table(_early("int_purchases"))
def early_int_purchases(early_stg_events: DataFrame) -> DataFrame:
    return staging.int_purchases(early_stg_events)


@table(_early("int_device_days"))
def early_int_device_days(early_stg_events: DataFrame) -> DataFrame:
    return staging.int_device_days(early_stg_events)


@table(_early("int_identity"))
def early_int_identity(early_stg_events: DataFrame) -> DataFrame:
    return orders.identity_of_events(early_stg_events)


@table(_early("fct_sessions"))
def early_fct_sessions(early_stg_events: DataFrame, early_int_identity: DataFrame) -> DataFrame:
    return orders.fct_sessions(early_stg_events, early_int_identity)


@table(_early("fct_orders"))
def early_fct_orders(early_int_purchases: DataFrame, early_fct_sessions: DataFrame, early_int_identity: DataFrame) -> DataFrame:
    return orders.fct_orders(early_int_purchases, early_fct_sessions, early_int_identity)


@table("SELECT source, event_date AS day, count(*) AS rows FROM flat_events GROUP BY 1, 2")
def export_listing(flat_events: DataFrame) -> DataFrame:
    """What the export holds now: each source's days and their rows."""
    return flat_events.groupBy("source", F.col("event_date").alias("day")).agg(F.count("*").alias("rows"))


@table("SELECT source, event_date AS day, count(*) AS rows FROM early_events GROUP BY 1, 2 UNION ALL SELECT 'store_a', DATE '2023-12-31', 7")
def recorded_days(early_events: DataFrame) -> DataFrame:
    """What the last run recorded; one of its days is no longer exported."""
    rows = early_events.groupBy("source", F.col("event_date").alias("day")).agg(F.count("*").alias("rows"))
    return rows.union(rows.sparkSession.sql("SELECT 'store_a', DATE'2023-12-31', 7L"))


def changed_days(listing: DataFrame, recorded: DataFrame) -> DataFrame:
    """(source, day, reason): days that are missing from the record or whose rows differ from it, nulls compared as values."""
    r = recorded.select("source", "day", F.col("rows").alias("__then"), F.lit(True).alias("__known"))
    j = listing.join(r, ["source", "day"], "left")
    reason = F.when(F.col("__known").isNull(), "missing").when(~F.col("rows").eqNullSafe(F.col("__then")), "changed")
    return j.withColumn("reason", reason).where("reason IS NOT NULL").select("source", "day", "reason")


query("m15_changed_days", "SELECT source, day, CASE WHEN r.rows IS NULL THEN 'missing' ELSE 'changed' END AS reason FROM export_listing l LEFT JOIN recorded_days r USING (source, day) WHERE l.rows IS DISTINCT FROM r.rows")(lambda export_listing, recorded_days: changed_days(export_listing, recorded_days))
query("m16_vanished_days", "SELECT source, day FROM recorded_days WHERE (source, day) NOT IN (SELECT (source, day) FROM export_listing)")(lambda export_listing, recorded_days: recorded_days.join(export_listing, ["source", "day"], "left_anti").select("source", "day"))


def window_start(listing: DataFrame, recorded: DataFrame, look_back: int = LOOK_BACK_DAYS, forced: str | None = None) -> DataFrame:
    """(source, since): the first day to rebuild: the earliest missing, changed or looked-back day, or a forced one."""
    last = listing.groupBy("source").agg(F.date_sub(F.max("day"), look_back - 1).alias("day"))
    days = changed_days(listing, recorded).select("source", "day").unionByName(last)
    if forced:
        days = days.unionByName(last.select("source", F.lit(forced).cast("date").alias("day")))
    return days.groupBy("source").agg(F.min("day").alias("since"))


@query("m17_window", f"SELECT source, min(day) AS since FROM (SELECT source, day FROM export_listing l LEFT JOIN recorded_days r USING (source, day) WHERE l.rows IS DISTINCT FROM r.rows UNION ALL SELECT source, max(day) - {LOOK_BACK_DAYS - 1} FROM export_listing GROUP BY 1) GROUP BY 1")
def window_plan(export_listing: DataFrame, recorded_days: DataFrame) -> DataFrame:
    return window_start(export_listing, recorded_days)


def replace_window(old: DataFrame, new: DataFrame, starts: DataFrame, day: str) -> DataFrame:
    """The old rows of days before each source's window and the new rows from it on."""
    s = F.broadcast(starts.withColumnRenamed("since", "__since"))
    before = old.join(s, "source", "left").where(F.col("__since").isNull() | (F.col(day) < F.col("__since"))).drop("__since")
    added = new.join(s, "source").where(F.col(day) >= F.col("__since")).drop("__since")
    return before.unionByName(added)


@query("m18_replace_window", "SELECT source, event_key, event_date FROM flat_events")
def events_after_window(early_events: DataFrame, flat_events: DataFrame, export_listing: DataFrame, recorded_days: DataFrame) -> DataFrame:
    columns = ["source", "event_key", "event_date"]
    return replace_window(early_events.select(*columns), flat_events.select(*columns), window_start(export_listing, recorded_days), "event_date")


@query("m19_purchase_history", f"SELECT event_key, order_id, is_duplicate_purchase FROM int_purchases WHERE event_date >= DATE '{SINCE}'")
def purchases_with_history(flat_events: DataFrame, early_events: DataFrame, since: str = SINCE) -> DataFrame:
    """The window's purchases, judged together with earlier days' so that the dedupe sees the past."""
    columns = ["source", "event_key", "event_date", "event_timestamp", "user_pseudo_id", "transaction_id", "purchase_revenue_usd"]
    start = F.lit(since).cast("date")
    window = flat_events.where((F.col("event_name") == "purchase") & (F.col("event_date") >= start)).select(*columns)
    history = early_events.where((F.col("event_name") == "purchase") & (F.col("event_date") < start)).select(*columns)
    return staging.with_orders(history.unionByName(window)).where(F.col("event_date") >= start).select("event_key", "order_id", "is_duplicate_purchase")


@query("m20_collision_flips", "SELECT source, transaction_id FROM (SELECT source, transaction_id, bool_or(is_transaction_id_collision) AS now FROM int_purchases WHERE transaction_id IS NOT NULL GROUP BY 1, 2) JOIN (SELECT source, transaction_id, bool_or(is_transaction_id_collision) AS before FROM early_int_purchases WHERE transaction_id IS NOT NULL GROUP BY 1, 2) USING (source, transaction_id) WHERE now <> before")
def collision_flips(int_purchases: DataFrame, early_int_purchases: DataFrame) -> DataFrame:
    """Transaction ids that came to be used by several devices, or by one only."""
    ids = lambda df, name: df.where("transaction_id IS NOT NULL").groupBy("source", "transaction_id").agg((F.count_distinct(F.coalesce("user_pseudo_id", F.lit(""))) > 1).alias(name))
    return ids(int_purchases, "now").join(ids(early_int_purchases, "before"), ["source", "transaction_id"]).where("now <> before").select("source", "transaction_id")


@query("m21_identity_diff", "SELECT source, user_pseudo_id FROM int_identity n LEFT JOIN early_int_identity e USING (source, user_pseudo_id) WHERE n.person_id IS DISTINCT FROM e.person_id")
def identity_diff(int_identity: DataFrame, early_int_identity: DataFrame) -> DataFrame:
    """Devices that are another person now, new ones included."""
    before = early_int_identity.select("source", "user_pseudo_id", F.col("person_id").alias("before"))
    return int_identity.join(before, ["source", "user_pseudo_id"], "left").where(~F.col("person_id").eqNullSafe(F.col("before"))).select("source", "user_pseudo_id")


def followed_sessions(old: DataFrame, events: DataFrame, identity: DataFrame, since: str) -> DataFrame:
    """Sessions after new days: those with an event in the window are built anew from all their events; the others only get their device's person of today."""
    keys = ["user_pseudo_id", "ga_session_id", "source"]
    touched = events.where(F.col("event_date") >= F.lit(since).cast("date")).where("user_pseudo_id IS NOT NULL").select(*keys).distinct()
    anew = orders.fct_sessions(events.join(touched, keys, "left_semi"), identity)
    own = F.when(F.col("identity_rule") == "session_account", F.col("user_id"))
    rest = old.join(touched, keys, "left_anti").withColumn("session_user_id", own).drop("person_id", "user_id", "identity_rule")
    return anew.unionByName(orders.with_person(rest, identity).drop("session_user_id"))


@query("m22_touched_sessions", "SELECT session_key, person_id, identity_rule, events, orders, session_source FROM fct_sessions")
def sessions_after_window(early_fct_sessions: DataFrame, stg_events: DataFrame, int_identity: DataFrame) -> DataFrame:
    return followed_sessions(early_fct_sessions, stg_events, int_identity, SINCE).select("session_key", "person_id", "identity_rule", "events", "orders", "session_source")


@query("m23_changed_orders", "WITH d AS (SELECT source, order_id FROM ((SELECT source, order_id, person_id, revenue_usd, session_source FROM fct_orders EXCEPT SELECT source, order_id, person_id, revenue_usd, session_source FROM early_fct_orders) UNION ALL (SELECT source, order_id, person_id, revenue_usd, session_source FROM early_fct_orders EXCEPT SELECT source, order_id, person_id, revenue_usd, session_source FROM fct_orders))) SELECT source, order_id, line_number FROM fct_order_items WHERE (source, order_id) IN (SELECT (source, order_id) FROM d)")
def lines_of_changed_orders(fct_orders: DataFrame, early_fct_orders: DataFrame, fct_order_items: DataFrame) -> DataFrame:
    columns = ["order_id", "source", "person_id", "revenue_usd", "session_source"]
    changed = symmetric_difference(early_fct_orders.select(*columns), fct_orders.select(*columns)).select("source", "order_id")
    return fct_order_items.join(changed, ["order_id", "source"], "left_semi").select("source", "order_id", "line_number")


@query("m24_affected_days", "SELECT DISTINCT source, event_date AS day FROM (SELECT source, event_date, event_key FROM flat_events EXCEPT SELECT source, event_date, event_key FROM early_events)")
def affected_days(early_events: DataFrame, flat_events: DataFrame) -> DataFrame:
    """Days whose daily tables must be written again."""
    new = flat_events.join(early_events, ["source", "event_key"], "left_anti")
    return new.select("source", F.col("event_date").alias("day")).distinct()


@query("m25_equivalence", "SELECT (SELECT count(*) FROM fct_sessions) AS rows, true AS equal")
def equivalence(fct_sessions: DataFrame, early_fct_sessions: DataFrame, stg_events: DataFrame, int_identity: DataFrame) -> DataFrame:
    """Whether the sessions followed from the early state are those of a full build, in all columns."""
    full, followed = kept(fct_sessions), followed_sessions(early_fct_sessions, stg_events, int_identity, SINCE)
    equal = same_rows(full, followed, ["session_key"])
    return full.agg(F.count("*").alias("rows"), F.lit(equal).alias("equal"))


@query("m26_table_diff", """WITH a AS (SELECT * FROM early_stg_events EXCEPT ALL SELECT * FROM stg_events), b AS (SELECT * FROM stg_events EXCEPT ALL SELECT * FROM early_stg_events), n AS (
        SELECT 'only in first' AS side, source, event_key FROM a UNION ALL SELECT 'only in second', source, event_key FROM b
    ), keys AS (SELECT DISTINCT side, '{"source":"' || source || '","event_key":"' || event_key || '"}' AS key FROM n)
    SELECT side, (SELECT count(*) FROM n WHERE n.side = s.side) AS rows, (SELECT coalesce(string_agg(key, ' ' ORDER BY key), '') FROM (SELECT key FROM keys k WHERE k.side = s.side ORDER BY key LIMIT 10)) AS examples
    FROM (VALUES ('only in first'), ('only in second')) s(side)""")  # fmt: skip
def events_diff(early_stg_events: DataFrame, stg_events: DataFrame) -> DataFrame:
    """The staged events before and after the new days, in all columns: new rows, and rows whose order changed."""
    return table_diff(kept(early_stg_events), kept(stg_events), ["source", "event_key"]).withColumn("examples", F.array_join("examples", " "))
