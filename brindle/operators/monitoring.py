"""Monitoring: daily series, robust bands, rules and alerts.

A day is held against the median of its weekday in the trailing window. The spread is the scaled median absolute
residual, where each day of the window is predicted by the other days of its weekday.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.registry import query, table, whole_table

WINDOW_DAYS, MIN_HISTORY, MIN_WEEKDAY = 21, 14, 2
K, K_CRITICAL, MAD_SCALE, LOG_OFFSET = 1.5, 3.0, 1.4826, 1.0
MIN_SPREAD = 0.02
#: metric: (scale, volume column, least volume, direction, floor, least move)
RULES = {
    "sessions": ("log", None, 0, "both", 30.0, 1.0),
    "orders": ("log", None, 0, "down", 25.0, 1.0),
    "revenue_usd": ("log", None, 0, "both", None, 5.0),
    "conversion_rate": ("linear", "sessions", 30, "both", None, 0.0),
}
#: Names the rules that an alert was judged by.
RULES_VERSION = hashlib.sha256(repr((WINDOW_DAYS, MIN_HISTORY, MIN_WEEKDAY, K, K_CRITICAL, MIN_SPREAD, sorted(RULES.items()))).encode()).hexdigest()[:12]
_RULES_SQL = ", ".join(f"('{m}', '{s}', {least}, '{d}', {'NULL' if f is None else f}::DOUBLE, {move}::DOUBLE)" for m, (s, _, least, d, f, move) in RULES.items())


@table("""SELECT source, metric, date AS day, value, volume FROM (SELECT source, date, unnest(['sessions', 'orders', 'revenue_usd', 'conversion_rate']) AS metric, unnest([sessions::DOUBLE, orders::DOUBLE, revenue_usd, conversion_rate]) AS value, unnest([NULL, NULL, NULL, sessions::DOUBLE]) AS volume FROM mart_kpi_daily)""")
def kpi_series(mart_kpi_daily: DataFrame) -> DataFrame:
    """Long: one row for each source, metric and day, with the volume that a rate stands on."""
    point = lambda m, v: F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), (F.col(v) if v else F.lit(None)).cast("double").alias("volume"))
    return mart_kpi_daily.select("source", F.col("date").alias("day"), F.inline(F.array(*[point(m, r[1]) for m, r in RULES.items()]))).select("source", "metric", "day", "value", "volume")


whole_table("l01_kpi_series", "kpi_series")


@table("SELECT source, event_name || '/' || check_name AS metric, date AS day, violation_rate AS value, events::DOUBLE AS volume, status, check_kind FROM mart_tag_health_daily")
def health_series(mart_tag_health_daily: DataFrame) -> DataFrame:
    return mart_tag_health_daily.select("source", F.concat("event_name", F.lit("/"), "check_name").alias("metric"), F.col("date").alias("day"), F.col("violation_rate").alias("value"), F.col("events").cast("double").alias("volume"), "status", "check_kind")


whole_table("l02_health_series", "health_series")


@table("SELECT source, unnest(generate_series(min(date), greatest(max(date), DATE '2024-02-03'), INTERVAL 1 DAY))::DATE AS day FROM mart_kpi_daily GROUP BY 1")
def source_calendar(mart_kpi_daily: DataFrame, through: str = "2024-02-03") -> DataFrame:
    return calendar(mart_kpi_daily, through)


def calendar(mart_kpi_daily: DataFrame, through: str | None = None) -> DataFrame:
    """Every day of each source from its first, up to its last, or up to ``through`` if data was due until then."""
    last = F.max("date") if through is None else F.greatest(F.max("date"), F.lit(through).cast("date"))
    span = mart_kpi_daily.groupBy("source").agg(F.min("date").alias("a"), last.alias("b"))
    return span.select("source", F.explode(F.expr("sequence(a, b, interval 1 day)")).alias("day"))


whole_table("l03_calendar", "source_calendar")


@table("SELECT source, event_name, date AS day, max(events)::DOUBLE AS n FROM mart_tag_health_daily WHERE event_name <> '(session)' GROUP BY 1, 2, 3")
def event_counts(mart_tag_health_daily: DataFrame) -> DataFrame:
    """Events of each day."""
    return mart_tag_health_daily.where("event_name <> '(session)'").groupBy("source", "event_name", F.col("date").alias("day")).agg(F.max("events").cast("double").alias("n"))


whole_table("l04_event_counts", "event_counts")


RULE_SCHEMA = "source string, metric string, scale string, volume string, least double, direction string, floor double, move double"


def rules(spark: SparkSession, given: list[tuple] | None = None) -> DataFrame:
    """Rules as a table of RULE_SCHEMA. A rule without a source is for every source that has none of its own for the metric. given: rows, else RULES."""
    rows = given if given is not None else [(None, m, scale, volume, float(least), direction, floor, move) for m, (scale, volume, least, direction, floor, move) in RULES.items()]
    return spark.createDataFrame(rows, RULE_SCHEMA)


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules from a file with one JSON object for each."""
    return spark.read.schema(RULE_SCHEMA).json(path)


def ruled(series: DataFrame, rules: DataFrame) -> DataFrame:
    """Points with the scale, least volume, direction, floor and move of their rule; points without a rule are left out. Two equi-joins: the source's own rule, else the one for all sources."""
    fields = ["scale", "least", "direction", "floor", "move"]
    of = lambda rows, name, *key: rows.groupBy(*key).agg(F.max(F.struct(*fields)).alias(name))
    own = of(rules.where("source IS NOT NULL"), "__own", "source", "metric")
    each = of(rules.where("source IS NULL"), "__each", "metric")
    found = series.join(own, ["source", "metric"], "left").join(each, "metric", "left").withColumn("__rule", F.coalesce("__own", "__each"))
    return found.where("__rule IS NOT NULL").select(*series.columns, "__rule.*")


_JUDGEABLE = f"""SELECT s.*, scale, direction, floor, move, CASE scale WHEN 'log' THEN ln(greatest(value, 0) + {LOG_OFFSET}) ELSE value END AS y FROM kpi_series s JOIN (VALUES {_RULES_SQL}) r(metric, scale, least, direction, floor, move) USING (metric) WHERE value IS NOT NULL AND NOT isnan(value) AND (volume IS NULL OR volume >= least)"""


@table(_JUDGEABLE)
def judgeable(kpi_series: DataFrame, by: DataFrame | None = None) -> DataFrame:
    """Points that can be judged, on their rule's scale: known, finite, and with enough volume behind a rate. by: a table of rules, else the built-in ones."""
    j = ruled(kpi_series, rules(kpi_series.sparkSession) if by is None else by).where("value IS NOT NULL AND NOT isnan(value) AND (volume IS NULL OR volume >= least)")
    y = F.when(F.col("scale") == "log", F.log(F.greatest("value", F.lit(0.0)) + LOG_OFFSET)).otherwise(F.col("value"))
    return j.select("source", "metric", "day", "value", "volume", "scale", "direction", "floor", "move", y.alias("y"))


query("l05_judgeable", "SELECT source, metric, day, value FROM judgeable")(lambda judgeable: judgeable.select("source", "metric", "day", "value"))
query("l06_transform", f"SELECT source, metric, day, round(y, 6) AS y, round(CASE scale WHEN 'log' THEN exp(y) - {LOG_OFFSET} ELSE y END, 4) AS back FROM judgeable")(lambda judgeable: judgeable.select("source", "metric", "day", F.round("y", 6).alias("y"), F.round(inverse(F.col("y")), 4).alias("back")))


def inverse(y: Column) -> Column:
    return F.when(F.col("scale") == "log", F.exp(y) - LOG_OFFSET).otherwise(y)


def median(values: Column) -> Column:
    """Of an array; null when it is empty."""
    s, n = F.array_sort(values), F.size(values)
    mid = lambda k: F.get(s, F.floor(k).cast("int"))
    return F.when(n > 0, (mid((n - 1) / 2) + mid(n / 2)) / 2)


def mad(values: Column) -> Column:
    m = median(values)
    return MAD_SCALE * median(F.transform(values, lambda v: F.abs(v - m)))


@query("l07_mad", "SELECT source, metric, round(1.4826 * median(abs(y - m)), 6) AS mad FROM (SELECT *, median(y) OVER (PARTITION BY source, metric) AS m FROM judgeable) GROUP BY 1, 2")
def series_mad(judgeable: DataFrame) -> DataFrame:
    m = judgeable.groupBy("source", "metric").agg(F.median("y").alias("m"))
    return judgeable.join(m, ["source", "metric"]).groupBy("source", "metric").agg(F.round(MAD_SCALE * F.median(F.abs(F.col("y") - F.col("m"))), 6).alias("mad"))


_BAND = f"""WITH h AS (SELECT a.source, a.metric, a.day, b.day AS hday, b.y, dayofweek(a.day) = dayofweek(b.day) AS same FROM judgeable a JOIN judgeable b ON b.source = a.source AND b.metric = a.metric AND b.day < a.day AND b.day >= a.day - {WINDOW_DAYS}),
    c AS (SELECT source, metric, day, count(*) AS n, median(y) AS m_all, median(y) FILTER (same) AS m_same, count(*) FILTER (same) AS n_same FROM h GROUP BY 1, 2, 3),
    r AS (SELECT a.source, a.metric, a.day, a.hday, any_value(a.y) - median(b.y) AS residual FROM h a JOIN h b ON b.source = a.source AND b.metric = a.metric AND b.day = a.day AND b.hday <> a.hday AND dayofweek(a.hday) = dayofweek(b.hday) GROUP BY 1, 2, 3, 4),
    rm AS (SELECT *, median(residual) OVER (PARTITION BY source, metric, day) AS m, count(*) OVER (PARTITION BY source, metric, day) AS k FROM r),
    rs AS (SELECT source, metric, day, 1.4826 * median(abs(residual - m)) AS spread, max(k) AS k FROM rm GROUP BY 1, 2, 3),
    fs AS (SELECT h.source, h.metric, h.day, 1.4826 * median(abs(y - m_all)) AS spread FROM h JOIN c USING (source, metric, day) GROUP BY 1, 2, 3)
    SELECT j.*, n AS history_days, CASE WHEN n_same >= {MIN_WEEKDAY} THEN m_same ELSE m_all END AS center, greatest(CASE WHEN n_same >= {MIN_WEEKDAY} AND rs.k >= {MIN_HISTORY} THEN rs.spread ELSE fs.spread END, {MIN_SPREAD}) AS spread
    FROM judgeable j JOIN c USING (source, metric, day) JOIN fs USING (source, metric, day) LEFT JOIN rs USING (source, metric, day) WHERE n >= {MIN_HISTORY}"""


@table(_BAND)
def bands(judgeable: DataFrame, window: int = WINDOW_DAYS) -> DataFrame:
    """Each judged day with its expected value and spread, on the rule's scale; days without enough history have none.

    The window's points come as an array of at most ``window`` entries for each day, so the leave-one-out medians are array functions.
    """
    keys = ["source", "metric"]
    w = Window.partitionBy(*keys).orderBy(F.unix_date("day")).rangeBetween(-window, -1)
    h = judgeable.withColumn("history", F.collect_list(F.struct(F.dayofweek("day").alias("d"), "y")).over(w)).where(F.size("history") >= MIN_HISTORY)
    ys = lambda points: F.transform(points, lambda p: p["y"])
    same = ys(F.filter("history", lambda p: p["d"] == F.dayofweek("day")))
    residual = lambda p, i: p["y"] - median(F.transform(F.filter(F.transform("history", lambda q, j: F.struct(q["d"].alias("d"), q["y"].alias("y"), j.alias("j"))), lambda q: (q["d"] == p["d"]) & (q["j"] != i)), lambda q: q["y"]))
    residuals = F.array_compact(F.transform("history", residual))
    h = h.withColumn("same", same).withColumn("residuals", residuals)
    center = F.when(F.size("same") >= MIN_WEEKDAY, median(F.col("same"))).otherwise(median(ys(F.col("history"))))
    spread = F.when((F.size("same") >= MIN_WEEKDAY) & (F.size("residuals") >= MIN_HISTORY), mad(F.col("residuals"))).otherwise(mad(ys(F.col("history"))))
    return h.select(*judgeable.columns, F.size("history").cast("long").alias("history_days"), center.alias("center"), F.greatest(spread, F.lit(MIN_SPREAD)).alias("spread"))


query("l08_robust_band", "SELECT source, metric, day, history_days, round(center, 6) AS center, round(spread, 6) AS spread FROM bands")(lambda bands: bands.select("source", "metric", "day", "history_days", F.round("center", 6).alias("center"), F.round("spread", 6).alias("spread")))

#: What each rule says, in words.
DETAIL = {"mad": "outside the band of its weekday", "floor": "below its floor", "contract_violation": "events violate a check", "no_data": "no data on a day that was due", "vanished": "no rows of an event that is usual"}


def alert(rule: str, direction: Column | str, severity: Column | str, **known: Column) -> list[Column]:
    """An alert's columns. known: those of expected, band_low, band_high, score, history_days and volume that the rule has; the others are null."""
    kinds = {"expected": "double", "band_low": "double", "band_high": "double", "score": "double", "history_days": "bigint", "volume": "double"}
    text = lambda v: F.lit(v) if isinstance(v, str) else v
    judged = [known.get(c, F.lit(None)).cast(kind) for c, kind in kinds.items()]
    judged = [(F.round(v, 6) if kind == "double" else v).alias(c) for v, (c, kind) in zip(judged, kinds.items())]
    return [F.lit(rule).alias("rule"), text(direction).alias("direction"), text(severity).alias("severity"), *judged, F.lit(DETAIL[rule]).alias("detail")]


def _judged_sql(rule: str, expected="NULL", low="NULL", high="NULL", score="NULL", history="NULL", volume="NULL") -> str:
    amounts = ", ".join(f"round(({v})::DOUBLE, 6) AS {c}" for c, v in (("expected", expected), ("band_low", low), ("band_high", high), ("score", score), ("volume", volume)))
    return f"{amounts}, ({history})::BIGINT AS history_days, '{DETAIL[rule]}' AS detail"



@table(f"""SELECT source, metric, day, value, 'mad' AS rule, CASE WHEN score < 0 THEN 'down' ELSE 'up' END AS direction, CASE WHEN abs(score) >= {K_CRITICAL} THEN 'critical' ELSE 'warning' END AS severity, {_judged_sql('mad', 'foreseen', 'low', 'high', 'score', 'history_days', 'volume')}
    FROM (SELECT *, (y - center) / spread AS score, CASE scale WHEN 'log' THEN exp(center) - {LOG_OFFSET} ELSE center END AS foreseen, CASE scale WHEN 'log' THEN exp(center - {K} * spread) - {LOG_OFFSET} ELSE center - {K} * spread END AS low, CASE scale WHEN 'log' THEN exp(center + {K} * spread) - {LOG_OFFSET} ELSE center + {K} * spread END AS high FROM bands)
    WHERE abs(value - foreseen) >= move AND (floor IS NULL OR value >= floor) AND ((score < -{K} AND direction IN ('down', 'both')) OR (score > {K} AND direction IN ('up', 'both')))""")  # fmt: skip
def mad_alerts(bands: DataFrame) -> DataFrame:
    """Days outside K spreads in a direction that their rule minds, that also moved far enough; a day under its floor is the floor rule's."""
    s = bands.withColumn("score", (F.col("y") - F.col("center")) / F.col("spread")).withColumn("expected", inverse(F.col("center")))
    down = (F.col("score") < -K) & F.col("direction").isin("down", "both")
    up = (F.col("score") > K) & F.col("direction").isin("up", "both")
    hit = s.where((F.abs(F.col("value") - F.col("expected")) >= F.col("move")) & (F.col("floor").isNull() | (F.col("value") >= F.col("floor"))) & (down | up))
    edge = lambda k: inverse(F.col("center") + k * F.col("spread"))
    direction, severity = F.when(F.col("score") < 0, "down").otherwise("up"), F.when(F.abs("score") >= K_CRITICAL, "critical").otherwise("warning")
    return hit.select("source", "metric", "day", "value", *alert("mad", direction, severity, expected=F.col("expected"), band_low=edge(-K), band_high=edge(K), score=F.col("score"), history_days=F.col("history_days"), volume=F.col("volume")))


@table(f"""SELECT j.source, j.metric, j.day, j.value, 'floor' AS rule, 'down' AS direction, 'critical' AS severity, {_judged_sql('floor', f"CASE j.scale WHEN 'log' THEN exp(center) - {LOG_OFFSET} ELSE center END", 'j.floor', history='history_days', volume='j.volume')}
    FROM judgeable j LEFT JOIN bands b ON b.source = j.source AND b.metric = j.metric AND b.day = j.day WHERE j.value < j.floor""")  # fmt: skip
def floor_alerts(judgeable: DataFrame, bands: DataFrame) -> DataFrame:
    """Days under their floor; what was expected is known only where the day has enough history for a band."""
    usual = bands.select("source", "metric", "day", "center", "history_days")
    low = judgeable.where("value < floor").join(usual, ["source", "metric", "day"], "left")
    return low.select("source", "metric", "day", "value", *alert("floor", "down", "critical", expected=inverse(F.col("center")), band_low=F.col("floor"), history_days=F.col("history_days"), volume=F.col("volume")))


@table(f"SELECT source, metric, day, value, 'contract_violation' AS rule, 'up' AS direction, CASE WHEN check_kind IN ('pii', 'value_math') OR value >= 0.5 THEN 'critical' ELSE 'warning' END AS severity, {_judged_sql('contract_violation', '0', high='0', volume='volume')} FROM health_series WHERE status = 'violation'")
def contract_alerts(health_series: DataFrame, critical_kinds: tuple[str, ...] = ("pii", "value_math"), critical_rate: float = 0.5) -> DataFrame:
    """From the first day on: a violation needs no history."""
    severity = F.when(F.col("check_kind").isin(*critical_kinds) | (F.col("value") >= critical_rate), "critical").otherwise("warning")
    return health_series.where("status = 'violation'").select("source", "metric", "day", "value", *alert("contract_violation", "up", severity, expected=F.lit(0.0), band_high=F.lit(0.0), volume=F.col("volume")))


@table(f"SELECT source, 'no_data' AS metric, day, 0.0::DOUBLE AS value, 'no_data' AS rule, 'down' AS direction, 'critical' AS severity, {_judged_sql('no_data')} FROM source_calendar WHERE (source, day) NOT IN (SELECT (source, date) FROM mart_kpi_daily)")
def no_data_alerts(source_calendar: DataFrame, mart_kpi_daily: DataFrame) -> DataFrame:
    gone = source_calendar.join(mart_kpi_daily.select("source", F.col("date").alias("day")), ["source", "day"], "left_anti")
    return gone.select("source", F.lit("no_data").alias("metric"), "day", F.lit(0.0).alias("value"), *alert("no_data", "down", "critical"))


@table(f"""WITH f AS (SELECT source, event_name, min(day) AS first FROM event_counts GROUP BY 1, 2), g AS (SELECT f.source, f.event_name, d.date AS day, coalesce(n, 0) AS n FROM f JOIN (SELECT DISTINCT source, date FROM mart_kpi_daily) d ON d.source = f.source AND d.date >= first LEFT JOIN event_counts e ON e.source = f.source AND e.event_name = f.event_name AND e.day = d.date)
    SELECT g.source, 'events.' || g.event_name AS metric, g.day, 0.0::DOUBLE AS value, 'vanished' AS rule, 'down' AS direction, 'critical' AS severity, {_judged_sql('vanished', 'median(h.n)', history='count(*)')} FROM g JOIN g h ON h.source = g.source AND h.event_name = g.event_name AND h.day < g.day AND h.day >= g.day - {WINDOW_DAYS} WHERE g.n = 0 GROUP BY 1, 2, 3 HAVING count(*) >= 7 AND median(h.n) >= 3""")  # fmt: skip
def vanished_alerts(event_counts: DataFrame, mart_kpi_daily: DataFrame, window: int = WINDOW_DAYS, min_days: int = 7, least: float = 3.0) -> DataFrame:
    """Events that a day with data has none of, though the median of the days before it is at least ``least``."""
    first = event_counts.groupBy("source", "event_name").agg(F.min("day").alias("first"))
    days = mart_kpi_daily.select("source", F.col("date").alias("day")).distinct()
    grid = first.join(days, "source").where("day >= first").join(event_counts, ["source", "event_name", "day"], "left").fillna(0.0, ["n"])
    w = Window.partitionBy("source", "event_name").orderBy(F.unix_date("day")).rangeBetween(-window, -1)
    judged = grid.withColumn("history", F.collect_list("n").over(w)).where((F.col("n") == 0) & (F.size("history") >= min_days))
    gone = judged.withColumn("usual", median(F.col("history"))).where(F.col("usual") >= least)
    return gone.select("source", F.concat(F.lit("events."), "event_name").alias("metric"), "day", F.lit(0.0).alias("value"), *alert("vanished", "down", "critical", expected=F.col("usual"), history_days=F.size("history")))


for _n, _t in (("l09_mad_rule", "mad_alerts"), ("l10_floor_rule", "floor_alerts"), ("l11_contract_rule", "contract_alerts"), ("l12_no_data_rule", "no_data_alerts"), ("l13_vanished_rule", "vanished_alerts")):
    whole_table(_n, _t)


@table(" UNION ALL BY NAME ".join(f"SELECT * FROM {t}" for t in ("mad_alerts", "floor_alerts", "contract_alerts", "no_data_alerts", "vanished_alerts")))
def alerts(mad_alerts: DataFrame, floor_alerts: DataFrame, contract_alerts: DataFrame, no_data_alerts: DataFrame, vanished_alerts: DataFrame) -> DataFrame:
    out = mad_alerts
    for more in (floor_alerts, contract_alerts, no_data_alerts, vanished_alerts):
        out = out.unionByName(more)
    return out


whole_table("l14_detect", "alerts")
query("l15_fresh", "SELECT * FROM alerts WHERE day >= DATE '2024-01-25'")(lambda alerts: fresh(alerts, "2024-01-25"))


def fresh(alerts: DataFrame, since: str) -> DataFrame:
    return alerts.where(F.col("day") >= F.lit(since).cast("date"))


#: From the least to the most severe.
SEVERITIES = ("warning", "critical")
ALERT_KEY = ["source", "metric", "day", "rule"]
#: An alert as it is kept: what fired, what was expected, which rules said so, and what became of it.
ALERT_RECORD = (*ALERT_KEY, "value", "expected", "band_low", "band_high", "severity", "direction", "score", "history_days", "volume", "detail", "rules_version", "detected_at", "first_detected_at", "notified_at", "delivery")


def severity_rank(severity: Column) -> Column:
    return F.coalesce(*[F.when(severity == s, i + 1) for i, s in enumerate(SEVERITIES)], F.lit(0))


def upsert_alerts(now: DataFrame, before: DataFrame, at: str) -> DataFrame:
    """Alerts that fire now, each as a whole record, with when it was first detected, when it was last told of and how; those that no longer fire are dropped. Of equal keys the most severe alert is kept, with all that it says."""
    fired = [c for c in ALERT_RECORD if c in now.columns]
    values = [c for c in fired if c not in ALERT_KEY]
    one = now.groupBy(*ALERT_KEY).agg(F.max(F.struct(severity_rank(F.col("severity")).alias("__rank"), *values)).alias("a")).select(*ALERT_KEY, *[F.col(f"a.{c}").alias(c) for c in values])
    old = before.select(*ALERT_KEY, F.col("first_detected_at").alias("__first"), "notified_at", "delivery")
    moment = F.lit(at).cast("timestamp_ntz")
    known = one.join(old, ALERT_KEY, "left").withColumns({"rules_version": F.lit(RULES_VERSION), "detected_at": moment, "first_detected_at": F.coalesce("__first", moment)})
    return known.select(*[c for c in ALERT_RECORD if c in known.columns])


def told(state: DataFrame, at: str, delivery: str, since: str) -> DataFrame:
    """The state after a delivery: alerts that were not told of yet are now, but for those about days before ``since``, which are no news."""
    news = F.col("notified_at").isNull() & (F.col("day") >= F.lit(since).cast("date"))
    return state.withColumns({"delivery": F.when(news, delivery).otherwise(F.col("delivery")), "notified_at": F.when(news, F.lit(at).cast("timestamp_ntz")).otherwise(F.col("notified_at"))})


@query("l16_upsert", f"""SELECT source, metric, day, rule, value, expected, band_low, band_high, severity, direction, score, history_days, volume, detail, '{RULES_VERSION}' AS rules_version, TIMESTAMP '2024-01-31 06:00:00' AS detected_at,
    CASE WHEN day < DATE '2024-01-20' THEN TIMESTAMP '2024-01-20 06:00:00' ELSE TIMESTAMP '2024-01-31 06:00:00' END AS first_detected_at,
    CASE WHEN day < DATE '2024-01-20' THEN TIMESTAMP '2024-01-20 07:00:00' WHEN day >= DATE '2024-01-25' THEN TIMESTAMP '2024-01-31 06:05:00' END AS notified_at, CASE WHEN day < DATE '2024-01-20' THEN 'webhook' WHEN day >= DATE '2024-01-25' THEN 'log' END AS delivery
    FROM alerts QUALIFY row_number() OVER (PARTITION BY source, metric, day, rule ORDER BY severity = 'critical' DESC, value DESC) = 1""")  # fmt: skip
def upserted(alerts: DataFrame) -> DataFrame:
    """Onto the state of an earlier run that had seen the days before the 20th; then what is new and fresh is logged."""
    seen = {"first_detected_at": F.lit("2024-01-20 06:00:00").cast("timestamp_ntz"), "notified_at": F.lit("2024-01-20 07:00:00").cast("timestamp_ntz"), "delivery": F.lit("webhook")}
    before = alerts.where("day < DATE'2024-01-20'").select(*ALERT_KEY).distinct().withColumns(seen)
    return told(upsert_alerts(alerts, before, "2024-01-31 06:00:00"), "2024-01-31 06:05:00", "log", "2024-01-25")


@query("l17_digest", "SELECT source, metric, count(*) AS days, min(severity) AS worst, row_number() OVER (ORDER BY min(severity), count(*) DESC, source, metric)::INT AS line FROM alerts GROUP BY 1, 2 QUALIFY line <= 20")
def digest(alerts: DataFrame, lines: int = 20) -> DataFrame:
    """One line for each source and metric, critical ones first; a digest has at most ``lines``."""
    per = alerts.groupBy("source", "metric").agg(F.count("*").alias("days"), F.max(F.struct(severity_rank(F.col("severity")), "severity"))["severity"].alias("worst"))
    return per.withColumn("line", F.row_number().over(Window.orderBy(severity_rank(F.col("worst")).desc(), F.desc("days"), "source", "metric"))).where(F.col("line") <= lines)


@query("l18_alert_counts", "SELECT rule, severity, source, day, count(*) AS alerts FROM alerts GROUP BY 1, 2, 3, 4")
def alert_counts(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("rule", "severity", "source", "day").agg(F.count("*").alias("alerts"))
