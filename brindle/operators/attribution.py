"""Multi-touch attribution: each order's journey of sessions, six models' weights, and what they add up to.

A model is a score for each touch; a touch's weight is its share of the scores of its journey. All six
are normalised by the same window and turned into rows by one unpivot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.operators.orders import money_rate
from brindle.operators.relational import exact_sum, look_back
from brindle.registry import query, table, whole_table

LOOK_BACK_DAYS, HALF_LIFE_DAYS, ENDS = 30, 7.0, 0.4
MODELS = ("last_click", "last_non_direct", "first_click", "linear", "time_decay", "position_based")
ORDER = ["source", "order_id"]
#: By what journeys are dealt: sorts tell rows apart by the first column's first bytes.
BY = ["order_id", "source"]


def is_direct() -> Column:
    return F.coalesce(F.col("session_source") == "(direct)", F.lit(False)) & F.coalesce(F.col("session_medium").isin("(none)", "(not set)"), F.lit(False))


@table("SELECT source, order_id, order_date, ordered_at, person_id, session_key, coalesce(revenue_usd, 0) AS revenue FROM fct_orders WHERE NOT is_zero_value_without_id AND session_key IS NOT NULL")
def attributable_orders(fct_orders: DataFrame) -> DataFrame:
    kept = fct_orders.where("NOT is_zero_value_without_id AND session_key IS NOT NULL")
    return kept.select(*ORDER, "order_date", "ordered_at", "person_id", "session_key", F.coalesce("revenue_usd", F.lit(0.0)).alias("revenue"))


@table(f"""WITH a AS (SELECT o.*, e.session_start_at AS ends_at FROM attributable_orders o JOIN fct_sessions e USING (source, session_key)),
    t AS (SELECT DISTINCT a.source, a.order_id, a.order_date, a.ordered_at, a.person_id, a.session_key AS order_session_key, a.revenue, a.session_key = s.session_key AS own, s.session_key, s.session_start_at, s.session_source, s.session_medium, s.session_campaign FROM a JOIN fct_sessions s ON s.source = a.source
        AND (s.session_key = a.session_key OR (s.person_id = a.person_id AND s.session_start_at <= a.ends_at AND s.session_start_at >= a.ordered_at - INTERVAL {LOOK_BACK_DAYS} DAY)))
    SELECT t.*, row_number() OVER (PARTITION BY t.source, order_id ORDER BY session_start_at, own, session_key)::INT AS position, count(*) OVER (PARTITION BY t.source, order_id) AS touches, coalesce(session_source = '(direct)' AND session_medium IN ('(none)', '(not set)'), false) AS direct,
        (epoch_us(ordered_at) - epoch_us(session_start_at)) / 86400e6 AS days_before, ordered_at - INTERVAL {LOOK_BACK_DAYS} DAY >= start_at AS complete FROM t JOIN (SELECT source, min(session_start_at) AS start_at FROM fct_sessions GROUP BY 1) USING (source)""")  # fmt: skip
def journey_touches(attributable_orders: DataFrame, fct_sessions: DataFrame, days: int = LOOK_BACK_DAYS) -> DataFrame:
    """The sessions that led to each order: its own, and its person's that began within ``days`` before the order and no later than its own.

    Own sessions and the person's come from two equi-joins; a touch found by both is one.
    """
    s = fct_sessions.select("source", "session_key", "person_id", "session_start_at", "session_source", "session_medium", "session_campaign")
    own = attributable_orders.join(s.drop("person_id"), ["session_key", "source"]).withColumn("own", F.lit(True)).withColumn("order_session_key", F.col("session_key"))
    ends = own.select(*ORDER, "order_date", "ordered_at", "person_id", "revenue", "order_session_key", F.col("session_start_at").alias("ends_at"))
    earlier = look_back(ends, s, ["person_id", "source"], "ordered_at", "session_start_at", days).where("session_start_at <= ends_at AND session_key <> order_session_key").withColumn("own", F.lit(False))
    touch = ["order_date", "ordered_at", "person_id", "order_session_key", "revenue", "own", "session_key", "session_start_at", "session_source", "session_medium", "session_campaign"]
    rows = own.select(*ORDER, *touch).unionByName(earlier.select(*ORDER, *touch))
    journey = Window.partitionBy(*BY)
    starts = F.broadcast(s.groupBy("source").agg(F.min("session_start_at").alias("start_at")))
    rows = rows.join(starts, "source")
    return rows.select(*ORDER, *touch, F.row_number().over(journey.orderBy("session_start_at", "own", "session_key")).alias("position"), F.count("*").over(journey).alias("touches"), is_direct().alias("direct"),
        (F.expr("timestampdiff(MICROSECOND, session_start_at, ordered_at)") / 86400e6).alias("days_before"), (F.col("ordered_at") - F.expr(f"INTERVAL {days} DAYS") >= F.col("start_at")).alias("complete"))


def scores(half_life: float = HALF_LIFE_DAYS, ends: float = ENDS) -> dict[str, Column]:
    """Each model's score of a touch, of any scale."""
    p, n = F.col("position"), F.col("touches")
    sourced = F.max(F.when(~F.col("direct"), p)).over(Window.partitionBy(*BY))
    edge = (p == 1) | (p == n)
    return {
        "last_click": p == n,
        "last_non_direct": p == F.coalesce(sourced, n),
        "first_click": p == 1,
        "linear": F.lit(True),
        "time_decay": F.exp(-F.col("days_before") * F.log(F.lit(2.0)) / half_life),
        "position_based": F.when(edge, ends).otherwise((1 - 2 * ends) / (n - 2)),
    }


@table("""WITH weighed AS (SELECT source, order_id, order_date, ordered_at, person_id, order_session_key, session_key, session_start_at, session_source, session_medium, session_campaign, position, touches, own, direct AS is_direct, days_before AS days_before_order, complete, revenue, m.model, CASE m.model WHEN 'last_click' THEN (position = touches)::INT WHEN 'first_click' THEN (position = 1)::INT WHEN 'linear' THEN 1.0::DOUBLE / touches
    WHEN 'last_non_direct' THEN (position = coalesce(sourced, touches))::INT WHEN 'time_decay' THEN pow(2, -days_before / 7) / decay WHEN 'position_based' THEN CASE WHEN touches = 1 THEN 1 WHEN touches = 2 THEN 0.5 WHEN position IN (1, touches) THEN 0.4 ELSE 0.2 / (touches - 2) END END::DOUBLE AS weight
    FROM (SELECT *, max(CASE WHEN NOT direct THEN position END) OVER w AS sourced, sum(pow(2, -days_before / 7)) OVER w AS decay FROM journey_touches WINDOW w AS (PARTITION BY source, order_id)), (VALUES ('last_click'), ('last_non_direct'), ('first_click'), ('linear'), ('time_decay'), ('position_based')) m(model))
    SELECT *, weight * revenue AS attributed_revenue_usd FROM weighed""")  # fmt: skip
def fct_attribution(journey_touches: DataFrame, models: tuple[str, ...] = MODELS) -> DataFrame:
    """One row for each order, touch and model. Who reads some models only names them: no others' scores are worked out."""
    scored = journey_touches.select("*", *[c.cast("double").alias(m) for m, c in scores().items() if m in models])
    scored = scored.withColumnsRenamed({"direct": "is_direct", "days_before": "days_before_order"})
    ids = ["source", "order_id", "order_date", "ordered_at", "person_id", "order_session_key", "session_key", "session_start_at", "session_source", "session_medium", "session_campaign"]
    ids += ["position", "touches", "own", "is_direct", "days_before_order", "complete", "revenue"]
    total = Window.partitionBy(*BY)
    shares = scored.select(*ids, *[(F.col(m) / F.sum(m).over(total)).alias(m) for m in models])
    return shares.unpivot(ids, list(models), "model", "weight").withColumn("attributed_revenue_usd", F.col("weight") * F.col("revenue"))


def attributed(digits: int = 4) -> Column:
    """Attributed revenue, summed and rounded as decimals."""
    return F.round(F.sum(F.round(F.col("weight") * F.col("revenue"), 9).cast("decimal(38,9)")), digits).cast("double")


@table("SELECT order_date AS date, source, model, session_source, session_medium, session_campaign, complete AS lookback_complete, round(sum(weight), 6) AS orders, round(sum(round(weight * revenue, 9)::DECIMAL(38,9)), 4)::DOUBLE AS revenue_usd FROM fct_attribution WHERE weight > 0 GROUP BY ALL")
def mart_attribution_daily(fct_attribution: DataFrame) -> DataFrame:
    """Orders and revenue of each day, model and campaign; orders whose look-back reaches before the first data stand apart."""
    keys = [F.col("order_date").alias("date"), "source", "model", "session_source", "session_medium", "session_campaign", F.col("complete").alias("lookback_complete")]
    return fct_attribution.where("weight > 0").groupBy(*keys).agg(F.round(exact_sum(F.col("weight")), 6).alias("orders"), attributed().alias("revenue_usd"))


whole_table("k01_attributable_orders", "attributable_orders")
query("k02_is_direct", "SELECT session_key, coalesce(session_source = '(direct)' AND session_medium IN ('(none)', '(not set)'), false) AS direct FROM fct_sessions")(lambda fct_sessions: fct_sessions.select("session_key", is_direct().alias("direct")))
query("k03_touches", "SELECT source, order_id, session_key, position, touches, own, direct, round(days_before, 6) AS days_before FROM journey_touches")(lambda journey_touches: journey_touches.select("source", "order_id", "session_key", "position", "touches", "own", "direct", F.round("days_before", 6).alias("days_before")))
query("k04_look_back_complete", "SELECT DISTINCT source, order_id, complete FROM journey_touches")(lambda journey_touches: journey_touches.select("source", "order_id", "complete").distinct())
for _k, _m in zip(("k05", "k06", "k07", "k08", "k09", "k10"), MODELS):
    query(f"{_k}_{_m}", f"SELECT source, order_id, session_key, round(weight, 9) AS weight FROM fct_attribution WHERE model = '{_m}'")(lambda journey_touches, m=_m: fct_attribution(journey_touches, (m,)).select("source", "order_id", "session_key", F.round("weight", 9).alias("weight")))
@query("k11_attribution", "SELECT * REPLACE (round(days_before_order, 6) AS days_before_order, round(weight, 9) AS weight, round(attributed_revenue_usd, 9) AS attributed_revenue_usd) FROM fct_attribution")
def attribution(fct_attribution: DataFrame) -> DataFrame:
    return fct_attribution.withColumns({c: F.round(c, digits) for c, digits in (("days_before_order", 6), ("weight", 9), ("attributed_revenue_usd", 9))})


whole_table("k12_attribution_daily", "mart_attribution_daily")


def gate(attribution: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """(problem, n): what makes an attribution unfit to be written; no rows when it is fit. One pass over orders and models and one over models."""
    per = attribution.groupBy(*BY, "model").agg(F.sum("weight").alias("w"), F.min("weight").alias("least"), F.max("weight").alias("most"), F.count_if((F.col("model") == "last_click") & (F.col("weight") > 0) & ~F.col("own")).alias("astray"), F.max("revenue").alias("revenue"), F.sum(F.col("weight") * F.col("revenue")).alias("given"))
    per_order = per.groupBy(*ORDER).agg(F.count("*").alias("models"))
    faults = {"weights don't sum to one": F.abs(F.col("w") - 1) > tolerance, "weight outside 0 to 1": (F.col("least") < 0) | (F.col("most") > 1 + tolerance), "last click not on the order's session": F.col("astray") > 0, "revenue not conserved": F.abs(F.col("given") - F.col("revenue")) > 0.005}
    found = per.select(F.explode(F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in faults.items()]))).alias("problem"))
    missing = per_order.where(F.col("models") != len(MODELS)).select(F.lit("models missing").alias("problem"))
    return found.union(missing).groupBy("problem").agg(F.count("*").alias("n"))


def gated(attribution: DataFrame) -> DataFrame:
    """The attribution itself; raises before anything is written when the gate finds problems."""
    problems = gate(attribution).collect()  # a handful of rows
    if problems:
        raise ValueError("; ".join(f"{r['problem']}: {r['n']}" for r in problems))
    return attribution


@query("k13_gate", """SELECT problem, count(*) AS n FROM (SELECT source, order_id, model, unnest([CASE WHEN abs(sum(weight) - 1) > 1e-6 THEN 'weights don''t sum to one' END, CASE WHEN model = 'last_click' AND count(*) FILTER (weight > 0 AND NOT own) > 0 THEN 'last click not on the order''s session' END]) AS problem
    FROM (SELECT *  REPLACE (CASE WHEN model = 'linear' AND position = 1 AND touches = 3 THEN 0 ELSE weight END AS weight) FROM fct_attribution) GROUP BY 1, 2, 3) WHERE problem IS NOT NULL GROUP BY 1
    UNION ALL SELECT 'revenue not conserved', count(*) FROM (SELECT source, order_id FROM fct_attribution WHERE model = 'linear' GROUP BY 1, 2 HAVING max(touches) = 3 AND max(revenue) / 3 > 0.005)""")  # fmt: skip
def gate_on_faults(fct_attribution: DataFrame) -> DataFrame:
    """The gate on an attribution in which one weight of each three-touch journey is lost."""
    lost = (F.col("model") == "linear") & (F.col("position") == 1) & (F.col("touches") == 3)
    return gate(fct_attribution.withColumn("weight", F.when(lost, 0.0).otherwise(F.col("weight"))))


@query("k14_rebuild_diff", "SELECT source, model, count(DISTINCT order_id) AS orders, round(sum(weight), 6) AS weight FROM fct_attribution GROUP BY 1, 2")
def rebuild_totals(fct_attribution: DataFrame) -> DataFrame:
    """Totals whose SQL is a second, separate formulation of the whole computation."""
    return fct_attribution.groupBy("source", "model").agg(F.count_distinct("order_id").alias("orders"), F.round(F.sum("weight"), 6).alias("weight"))


@query("k15_run_summary", "SELECT count(DISTINCT (source, order_id)) AS orders, count(*) AS touches, max(touches) AS most, count(*) FILTER (direct) AS direct, round((SELECT sum(revenue) FROM attributable_orders), 2) AS revenue FROM journey_touches")
def run_summary(journey_touches: DataFrame) -> DataFrame:
    """One pass: an order's last touch stands for the order."""
    last = F.col("position") == F.col("touches")
    return journey_touches.agg(F.count_if(last).alias("orders"), F.count("*").alias("touches"), F.max("touches").alias("most"), F.count_if("direct").alias("direct"), F.round(exact_sum(F.when(last, F.col("revenue")), 9), 2).alias("revenue"))


def folded(df: DataFrame, keys: list[str], name: str, value: str, n: int, by: Column | None = None) -> DataFrame:
    """Sums of ``value`` by keys and name, in which only the ``n`` names with the largest total (of ``by``) keep their own rows."""
    sums = df.groupBy(*keys, name).agg(F.sum(value).alias(value))
    ranked = sums.groupBy(name).agg(F.max(value).alias("__m")).withColumn("__r", F.row_number().over(Window.orderBy(F.desc("__m"), name)))
    named = sums.join(F.broadcast(ranked.where(F.col("__r") <= n).select(name, F.lit(True).alias("__top"))), name, "left")
    return named.groupBy(*keys, F.when(F.col("__top"), F.col(name)).otherwise("other").alias(name)).agg(F.sum(value).alias(value))


@query("k16_channel_share", """WITH s AS (SELECT model, session_source AS channel, round(sum(weight), 6) AS w FROM fct_attribution GROUP BY 1, 2), r AS (SELECT channel, row_number() OVER (ORDER BY max(w) DESC, channel) AS r FROM s GROUP BY 1)
    SELECT model, CASE WHEN r <= 3 THEN channel ELSE 'other' END AS channel, round(sum(w), 4) AS orders FROM s JOIN r USING (channel) GROUP BY 1, 2""")  # fmt: skip
def channel_share(fct_attribution: DataFrame, n: int = 3) -> DataFrame:
    per = fct_attribution.groupBy("model", F.col("session_source").alias("channel")).agg(F.round(exact_sum(F.col("weight")), 6).alias("orders"))
    return folded(per, ["model"], "channel", "orders", n).select("model", "channel", F.round("orders", 4).alias("orders"))


@query("k17_journey_lengths", "SELECT source, touches, count(*) AS orders, floor(sum(revenue::DECIMAL(38,9))::DOUBLE / count(*) * 10000 + 0.5) / 10000 AS mean_revenue FROM (SELECT source, order_id, max(touches) AS touches, max(revenue) AS revenue FROM journey_touches GROUP BY 1, 2) GROUP BY 1, 2")
def journey_lengths(journey_touches: DataFrame) -> DataFrame:
    orders = journey_touches.groupBy(*BY).agg(F.max("touches").alias("touches"), F.max("revenue").alias("revenue"))
    return orders.groupBy("source", "touches").agg(F.count("*").alias("orders"), exact_sum(F.col("revenue"), 9).alias("__sum")).select("source", "touches", "orders", money_rate("__sum", "orders").alias("mean_revenue"))
