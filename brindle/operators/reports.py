"""Reports and dashboard aggregates over the marts. Rates are always recomputed from sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.operators.attribution import folded
from brindle.operators.orders import money_rate, rate
from brindle.operators.relational import exact_sum
from brindle.registry import query


@query("m01_sources", "SELECT e.source, events, first_date, last_date, sessions, orders, revenue_usd FROM (SELECT source, count(*) AS events, min(event_date) AS first_date, max(event_date) AS last_date FROM stg_events GROUP BY 1) e LEFT JOIN (SELECT source, count(*) AS sessions FROM fct_sessions GROUP BY 1) USING (source) LEFT JOIN (SELECT source, count(*) AS orders, round(sum(revenue_usd::DECIMAL(38,9))::DOUBLE, 2) AS revenue_usd FROM fct_orders GROUP BY 1) USING (source)")
def sources_overview(stg_events: DataFrame, fct_sessions: DataFrame, fct_orders: DataFrame) -> DataFrame:
    e = stg_events.groupBy("source").agg(F.count("*").alias("events"), F.min("event_date").alias("first_date"), F.max("event_date").alias("last_date"))
    o = fct_orders.groupBy("source").agg(F.count("*").alias("orders"), F.round(exact_sum(F.col("revenue_usd"), 9), 2).alias("revenue_usd"))
    return e.join(fct_sessions.groupBy("source").agg(F.count("*").alias("sessions")), "source", "left").join(o, "source", "left")


@query("m02_identity", "SELECT source, identity_rule, count(*) AS devices, count(DISTINCT person_id) AS persons, sum(events)::BIGINT AS events FROM int_identity GROUP BY 1, 2")
def identity_report(int_identity: DataFrame) -> DataFrame:
    return int_identity.groupBy("source", "identity_rule").agg(F.count("*").alias("devices"), F.count_distinct("person_id").alias("persons"), F.sum("events").alias("events"))


@query("m03_session_identity", "SELECT source, identity_rule, count(*) AS sessions, count(DISTINCT person_id) AS persons FROM fct_sessions GROUP BY 1, 2")
def session_identity_report(fct_sessions: DataFrame) -> DataFrame:
    return fct_sessions.groupBy("source", "identity_rule").agg(F.count("*").alias("sessions"), F.count_distinct("person_id").alias("persons"))


@query("m04_campaigns", "SELECT source, session_source, session_medium, session_campaign, sum(sessions)::BIGINT AS sessions, sum(orders)::BIGINT AS orders, sum(revenue_usd::DECIMAL(38,9))::DOUBLE AS revenue_usd, sum(cost_usd::DECIMAL(38,9))::DOUBLE AS cost_usd, floor(sum(revenue_usd::DECIMAL(38,9))::DOUBLE / sum(cost_usd::DECIMAL(38,9))::DOUBLE * 10000 + 0.5) / 10000.0 AS roas FROM mart_campaign_daily GROUP BY 1, 2, 3, 4")
def campaign_totals(mart_campaign_daily: DataFrame) -> DataFrame:
    sums = mart_campaign_daily.groupBy("source", "session_source", "session_medium", "session_campaign").agg(F.sum("sessions").alias("sessions"), F.sum("orders").alias("orders"), exact_sum(F.col("revenue_usd"), 9).alias("revenue_usd"), exact_sum(F.col("cost_usd"), 9).alias("cost_usd"))
    return sums.withColumn("roas", money_rate("revenue_usd", "cost_usd"))


@query("m05_top_channels", "SELECT source, session_source, session_medium, sessions FROM (SELECT source, session_source, session_medium, count(*) AS sessions FROM fct_sessions GROUP BY 1, 2, 3) QUALIFY row_number() OVER (PARTITION BY source ORDER BY sessions DESC, session_source, session_medium) <= 10")
def top_channels(fct_sessions: DataFrame, n: int = 10) -> DataFrame:
    counts = fct_sessions.groupBy("source", "session_source", "session_medium").agg(F.count("*").alias("sessions"))
    return counts.withColumn("r", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("sessions"), "session_source", "session_medium"))).where(F.col("r") <= n).drop("r")


_STEPS = ("sessions", "view_item_sessions", "add_to_cart_sessions", "begin_checkout_sessions", "purchase_sessions")


@query("m06_funnel", f"SELECT source, {', '.join(f'sum({s})::BIGINT AS {s}' for s in _STEPS)} FROM mart_funnel_daily GROUP BY 1")
def funnel_totals(mart_funnel_daily: DataFrame) -> DataFrame:
    return mart_funnel_daily.groupBy("source").agg(*[F.sum(s).alias(s) for s in _STEPS])


@query("m07_margin", "SELECT source, count(*) AS lines, round(sum(line_revenue_usd::DECIMAL(38,9))::DOUBLE, 2) AS revenue_usd, round(sum(gross_margin_usd::DECIMAL(38,9))::DOUBLE, 2) AS margin_usd FROM fct_order_items WHERE is_catalog_product GROUP BY 1")
def margin_report(fct_order_items: DataFrame) -> DataFrame:
    return fct_order_items.where("is_catalog_product").groupBy("source").agg(F.count("*").alias("lines"), F.round(exact_sum(F.col("line_revenue_usd"), 9), 2).alias("revenue_usd"), F.round(exact_sum(F.col("gross_margin_usd"), 9), 2).alias("margin_usd"))


@query("m08_kpi_totals", "SELECT source, sum(sessions)::BIGINT AS sessions, sum(orders)::BIGINT AS orders, round(sum(converted_sessions) / sum(sessions), 6) AS conversion_rate, floor(sum(revenue_usd::DECIMAL(38,9))::DOUBLE / sum(orders) * 100 + 0.5) / 100.0 AS aov_usd FROM mart_kpi_daily GROUP BY 1")
def kpi_totals(mart_kpi_daily: DataFrame) -> DataFrame:
    sums = mart_kpi_daily.groupBy("source").agg(F.sum("sessions").alias("sessions"), F.sum("orders").alias("orders"), F.sum("converted_sessions").alias("converted"), exact_sum(F.col("revenue_usd"), 9).alias("revenue"))
    return sums.select("source", "sessions", "orders", rate("converted", "sessions", 6).alias("conversion_rate"), money_rate("revenue", "orders", 2).alias("aov_usd"))


@query("m09_funnel_rates", "SELECT source, step, n, round(n / nullif(lag(n) OVER (PARTITION BY source ORDER BY pos), 0), 4) AS rate FROM (SELECT source, unnest(['sessions', 'view_item_sessions', 'add_to_cart_sessions', 'begin_checkout_sessions', 'purchase_sessions']) AS step, unnest([a, b, c, d, e]) AS n, unnest([1, 2, 3, 4, 5]) AS pos FROM (SELECT source, sum(sessions)::BIGINT AS a, sum(view_item_sessions)::BIGINT AS b, sum(add_to_cart_sessions)::BIGINT AS c, sum(begin_checkout_sessions)::BIGINT AS d, sum(purchase_sessions)::BIGINT AS e FROM mart_funnel_daily GROUP BY 1))")
def funnel_rates(mart_funnel_daily: DataFrame) -> DataFrame:
    totals = funnel_totals(mart_funnel_daily)
    steps = F.array(*[F.struct(F.lit(s).alias("step"), F.col(s).alias("n"), (F.col(_STEPS[i - 1]) if i else F.lit(None).cast("long")).alias("before")) for i, s in enumerate(_STEPS)])
    return totals.select("source", F.inline(steps)).select("source", "step", "n", rate("n", "before").alias("rate"))


@query("m10_paid_campaigns", "SELECT session_campaign, sum(cost_usd::DECIMAL(38,9))::DOUBLE AS cost_usd, sum(revenue_usd::DECIMAL(38,9))::DOUBLE AS revenue_usd, floor(sum(revenue_usd::DECIMAL(38,9))::DOUBLE / sum(cost_usd::DECIMAL(38,9))::DOUBLE * 10000 + 0.5) / 10000.0 AS roas FROM mart_campaign_daily WHERE cost_usd IS NOT NULL GROUP BY 1")
def paid_campaigns(mart_campaign_daily: DataFrame) -> DataFrame:
    """Only rows with spend count, so that the return is on what was paid for."""
    sums = mart_campaign_daily.where("cost_usd IS NOT NULL").groupBy("session_campaign").agg(exact_sum(F.col("cost_usd"), 9).alias("cost_usd"), exact_sum(F.col("revenue_usd"), 9).alias("revenue_usd"))
    return sums.withColumn("roas", money_rate("revenue_usd", "cost_usd"))


@query("m11_channel_fold", "WITH c AS (SELECT source, session_source AS channel, count(*) AS sessions FROM fct_sessions GROUP BY 1, 2), r AS (SELECT channel, row_number() OVER (ORDER BY max(sessions) DESC, channel) AS r FROM c GROUP BY 1) SELECT source, CASE WHEN r <= 3 THEN channel ELSE 'other' END AS channel, sum(sessions)::BIGINT AS sessions FROM c JOIN r USING (channel) GROUP BY 1, 2")
def channel_fold(fct_sessions: DataFrame, n: int = 3) -> DataFrame:
    counts = fct_sessions.groupBy("source", F.col("session_source").alias("channel")).agg(F.count("*").alias("sessions"))
    return folded(counts, ["source"], "channel", "sessions", n).select("source", "channel", "sessions")


@query("m12_attribution_view", "SELECT model, session_source, complete, round(sum(weight), 6) AS orders FROM fct_attribution GROUP BY 1, 2, 3")
def attribution_view(fct_attribution: DataFrame) -> DataFrame:
    return fct_attribution.groupBy("model", "session_source", "complete").agg(F.round(exact_sum(F.col("weight")), 6).alias("orders"))


@query("m13_tag_health_summary", "SELECT source, status, check_kind, count(*) AS rows, sum(violations)::BIGINT AS violations FROM mart_tag_health_daily GROUP BY 1, 2, 3")
def tag_health_summary(mart_tag_health_daily: DataFrame) -> DataFrame:
    return mart_tag_health_daily.groupBy("source", "status", "check_kind").agg(F.count("*").alias("rows"), F.sum("violations").alias("violations"))


@query("m14_daily_series", "SELECT date, source, sessions, orders, round(revenue_usd, 1) AS revenue_usd, round(conversion_rate, 4) AS conversion_rate FROM mart_kpi_daily")
def daily_series(mart_kpi_daily: DataFrame) -> DataFrame:
    return mart_kpi_daily.select("date", "source", "sessions", "orders", F.round("revenue_usd", 1).alias("revenue_usd"), F.round("conversion_rate", 4).alias("conversion_rate"))
