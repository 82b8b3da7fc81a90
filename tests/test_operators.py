"""Hand-made rows for the edges that the given tables lack."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from brindle.operators import attribution, ledger, monitoring, orders, quality, relational, staging
from brindle.sources import io
from brindle.streaming import twins


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def moves(spark, *data):
    return spark.createDataFrame(data, "movement_id string, product_id long, warehouse_id int, movement_type string, quantity int, created_at timestamp_ntz")


def at(day, hour=0):
    return datetime(2024, 1, day, hour)


def test_first_out_on_an_unknown_key_is_negative_unless_clamped(spark):
    m = moves(spark, ("a", 1, 1, "OUT", 5, at(1)), ("b", 1, 1, "IN", 3, at(2)), ("c", 2, 1, "IN", 4, at(1)), ("d", 2, 1, "ADJUSTMENT", 1, at(3)))
    before = spark.createDataFrame([(3, 1, 9, None)], "product_id long, warehouse_id int, balance long, last_updated timestamp_ntz")
    assert rows(ledger.apply_movements(before, m), "product_id", "balance") == [(1, -2), (2, 5), (3, 9)]
    assert rows(ledger.apply_movements(before, m, clamp_first=True), "product_id", "balance") == [(1, 3), (2, 5), (3, 9)]
    assert rows(ledger.silent_zero(m), "product_id", "movement_id") == [(1, "a")]


def test_transfers_promise_stock_in_turn(spark):
    stock = spark.createDataFrame([(1, 1, 10)], "product_id long, warehouse_id int, quantity int")
    asked = spark.createDataFrame([(1, 1, 1, 2, 6), (2, 1, 1, 2, 5), (3, 1, 1, 1, 1), (4, 1, 1, 2, 0), (5, 9, 1, 2, 1)], "request_id long, product_id long, from_warehouse int, to_warehouse int, quantity int")
    assert rows(ledger.judged_transfers(asked, stock), "request_id", "reason") == [(1, None), (2, "not enough stock"), (3, "same warehouse"), (4, "quantity"), (5, "unknown product")]


def test_attribution_weights(spark):
    def journey(n, direct=()):
        return [("s", f"o{n}", date(2024, 1, 9), at(9), 10.0, i == n, f"k{i}", at(i), "x", "y", "z", i, n, i in direct, float(n - i), True, "p", f"k{n}") for i in range(1, n + 1)]

    columns = "source string, order_id string, order_date date, ordered_at timestamp_ntz, revenue double, own boolean, session_key string, session_start_at timestamp_ntz, session_source string, session_medium string, session_campaign string, position int, touches int, direct boolean, days_before double, complete boolean, person_id string, order_session_key string"
    touches = spark.createDataFrame(journey(1) + journey(2) + journey(3, direct=(3,)) + journey(5, direct=(1, 2, 3, 4, 5)), columns)
    a = attribution.fct_attribution(touches)
    assert attribution.gate(a).count() == 0
    weights = {(r["order_id"], r["model"], r["position"]): round(r["weight"], 6) for r in a.collect()}
    assert weights["o1", "position_based", 1] == 1 and weights["o2", "position_based", 1] == 0.5
    assert [weights["o5", "position_based", i] for i in range(1, 6)] == [0.4, round(0.2 / 3, 6), round(0.2 / 3, 6), round(0.2 / 3, 6), 0.4]
    assert weights["o3", "last_non_direct", 2] == 1 and weights["o5", "last_non_direct", 5] == 1
    assert weights["o2", "time_decay", 2] > weights["o2", "time_decay", 1]
    broken = a.withColumn("weight", F.when((F.col("order_id") == "o2") & (F.col("model") == "last_click"), 0.7).otherwise(F.col("weight")))
    assert {r["problem"] for r in attribution.gate(broken).collect()} >= {"weights don't sum to one", "revenue not conserved", "last click not on the order's session"}
    assert attribution.gate(a.where("model <> 'linear'")).collect()[0]["problem"] == "models missing"


def test_purchases_repeat_and_collide(spark):
    data = [("s", "e1", "d1", "T1", at(1), 1.0), ("s", "e2", "d1", "T1", at(2), 1.0), ("s", "e3", "d2", "T1", at(3), 1.0), ("s", "e4", None, None, at(1), 0.0), ("s", "e5", None, "T2", at(1), None)]
    got = staging.with_orders(spark.createDataFrame(data, "source string, event_key string, user_pseudo_id string, transaction_id string, event_timestamp timestamp_ntz, purchase_revenue_usd double"))
    assert rows(got, "event_key", "order_id", "is_duplicate_purchase", "is_zero_value_without_id") == [
        ("e1", "T1@d1", False, False), ("e2", "T1@d1", True, False), ("e3", "T1@d2", False, False), ("e4", "no-transaction-id:e4", False, True), ("e5", "T2", False, False)]


def test_identity_of_shared_and_anonymous_devices(spark):
    days = spark.createDataFrame([("s", "d1", ["a"], [1]), ("s", "d1", ["a"], [2]), ("s", "d2", ["a", "b"], [1]), ("s", "d3", [], [1]), ("s", "d4", ["a"], [1])], "source string, user_pseudo_id string, user_ids array<string>, ga_session_ids array<long>")
    days = days.withColumns({c: F.lit("2024-01-01").cast("timestamp_ntz") for c in ("first_seen_at", "first_signed_in_at", "last_seen_at")}).withColumn("events", F.lit(1).cast("long"))
    got = orders.int_identity(days)
    assert rows(got, "user_pseudo_id", "person_id", "identity_rule", "person_device_count", "sessions") == [
        ("d1", "a", "user_id", 2, 2), ("d2", "anon:s:d2", "shared_device", 1, 1), ("d3", "anon:s:d3", "anonymous_device", 1, 1), ("d4", "a", "user_id", 2, 1)]


def test_band_sees_a_halved_day_through_weekends(spark):
    from datetime import timedelta

    start = date(2024, 1, 1)
    value = lambda i: (40.0 if (start + timedelta(i)).weekday() >= 5 else 100.0) + i % 3
    points = [("s", "sessions", start + timedelta(i), value(i) / (2 if i == 25 else 1), None) for i in range(28)]
    series = spark.createDataFrame(points, "source string, metric string, day date, value double, volume double")
    hits = monitoring.mad_alerts(monitoring.bands(monitoring.judgeable(series))).where("severity = 'critical'").collect()
    assert [(r["day"], r["direction"]) for r in hits] == [(start + timedelta(25), "down")]


def test_checks_find_just_what_is_wrong(spark):
    t = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (2, None)], "id long, x string")
    assert rows(quality.key_problems(t, "t", ["id"]), "problem", "n") == [("null in key", 1), ("repeated key", 1)]
    assert rows(quality.violations(t, "id", {"has x": "x IS NOT NULL", "small": "id < 2"}), "rule", "key") == [("has x", "2"), ("small", "2"), ("small", None)]
    assert quality.orphans(t, spark.createDataFrame([(1,)], "id long"), "id").select("id").collect()[0][0] == 2


def test_fingerprint_knows_multisets(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (2, None)], "a int, b string")
    b = a.orderBy(F.desc("a")).repartition(3)
    assert relational.fingerprint(a).collect() == relational.fingerprint(b).collect()
    assert relational.fingerprint(a).collect() != relational.fingerprint(a.distinct()).collect()


def test_insert_ignores_known_and_repeated_keys(spark):
    old, new = spark.createDataFrame([(1, "a")], "id int, v string"), spark.createDataFrame([(1, "b"), (2, "c"), (2, "c")], "id int, v string")
    assert rows(io.insert_new(old, new, ["id"]), "id", "v") == [(2, "c")]


def test_exact_sum_does_not_depend_on_partitions(spark):
    df = spark.range(2000).select(((F.col("id") * 37 % 1000) / 7.0).alias("x"))
    sums = {df.repartition(n).agg(relational.exact_sum(F.col("x")).alias("s")).first()[0] for n in (1, 3, 8)}
    assert len(sums) == 1


def test_a_contract_becomes_checks(spark):
    rules = quality.rules_of('{"purchase": {"required": ["id"], "properties": {"id": {"minLength": 1, "maxLength": 3, "pattern": "^[A-Z]"}, "paid": {"minimum": 0, "multipleOf": 0.01}}}}')
    assert [r.name for r in rules] == ["required:id", "format:id", "value_math:paid"]
    t = spark.createDataFrame([("purchase", "A1", 2.5), ("purchase", "", -1.0), ("purchase", "ABCD", 0.001), ("purchase", None, None), ("other", None, None)], "event_name string, id string, paid double")
    found = t.select("id", F.inline(quality.contract_checks(rules))).where("violated")
    assert rows(found, "id", "check_name") == sorted([("", "format:id"), ("", "value_math:paid"), ("ABCD", "format:id"), ("ABCD", "value_math:paid"), (None, "required:id")], key=repr)


def test_a_contract_with_an_unknown_word_is_refused():
    with pytest.raises(ValueError, match="uniqueItems"):
        quality.rules_of('{"purchase": {"properties": {"id": {"uniqueItems": true}}}}')


def test_look_back_over_spans_equals_all_pairs(spark):
    minutes = [i * 1_013 for i in range(120)]
    asked = spark.createDataFrame([(k, i, datetime(1969, 12, 20) + timedelta(minutes=m)) for k in "ab" for i, m in enumerate(minutes)], "k string, i int, at timestamp_ntz")
    seen = spark.createDataFrame([(k, i, datetime(1969, 12, 18) + timedelta(minutes=m)) for k in "ac" for i, m in enumerate(minutes)], "k string, j int, seen timestamp_ntz")
    for days in (1, 3, 30):
        expected = asked.join(seen, "k").where(f"seen <= at AND seen >= at - INTERVAL {days} DAYS")
        got = relational.look_back(asked, seen, ["k"], "at", "seen", days)
        assert got.columns == expected.columns and rows(got, "k", "i", "j") == rows(expected, "k", "i", "j")


def test_alerts_are_told_of_once(spark):
    now = spark.createDataFrame([("s", "m", date(2024, 1, d), "floor", sev, 1.0) for d, sev in ((1, "warning"), (1, "critical"), (2, "warning"), (9, "warning"))], "source string, metric string, day date, rule string, severity string, value double")
    before = now.where("day = DATE'2024-01-02'").select("source", "metric", "day", "rule").withColumns({"first_detected_at": F.lit(at(3)), "notified_at": F.lit(at(4)), "delivery": F.lit("webhook")})
    state = monitoring.told(monitoring.upsert_alerts(now, before, "2024-01-10"), "2024-01-11", "log", "2024-01-05")
    assert rows(state, "day", "severity", "first_detected_at", "notified_at", "delivery") == [
        (date(2024, 1, 1), "critical", at(10), None, None), (date(2024, 1, 2), "warning", at(3), at(4), "webhook"), (date(2024, 1, 9), "warning", at(10), at(11), "log")]
    later = monitoring.told(monitoring.upsert_alerts(now, state, "2024-01-12"), "2024-01-13", "webhook", "2024-01-05")
    assert rows(later, "day", "notified_at", "delivery") == rows(state, "day", "notified_at", "delivery")


def test_rows_behind_the_watermark_are_left_out_and_late_ones_counted(spark):
    part = lambda *data: spark.createDataFrame(data, "kind string, n int, at timestamp_ntz")
    arrivals = [part(("a", 1, at(1)), ("a", 2, at(10))), part(("a", 4, at(8, 5)), ("a", 8, at(2)), ("b", 16, at(10)), ("a", 32, at(10, 7)))]
    state = lambda stream: twins.daily(stream, "at", ["kind"], [F.sum("n").alias("n"), F.count("*").alias("rows")])
    got = twins.fed(arrivals, state, ["window", "kind"]).withColumn("day", F.dayofmonth("window.start"))
    assert rows(got, "day", "kind", "n", "rows") == sorted([(1, "a", 1, 1), (8, "a", 4, 1), (10, "a", 34, 2), (10, "b", 16, 1)], key=repr)


def test_parts_arrive_in_order_and_are_the_whole(spark):
    table = spark.createDataFrame([(i, at(1 + i % 20)) for i in range(50)] + [(50, None)], "i int, at timestamp_ntz")
    parts = [rows(p, "at", "i") for p in twins.arriving(table, "at")]
    assert sorted(r for p in parts for r in p if r[0]) == sorted(r for r in rows(table, "at", "i") if r[0]) and sum(map(len, parts)) == 51
    assert all(max(r[0] for r in a if r[0]) < min(r[0] for r in b if r[0]) for a, b in zip(parts, parts[1:]))
    assert [p.count() for p in twins.arriving(table.limit(0), "at")] == [0]


def test_flat_events_nest_nothing_on_their_way(spark, sf_dir):
    from brindle.registry import Tables

    flat = Tables(spark, sf_dir)["flat_events"].select("event_key", "ga_session_number", "session_key", "page_path", "transaction_id", "tax_usd")
    plan = flat._jdf.queryExecution().optimizedPlan().toString()
    assert "named_struct" not in plan and "page_title" not in plan


def test_day_of_a_text(spark):
    texts = spark.createDataFrame([("20240229",), ("19991231",), (None,)], "t string")
    assert [r[0] for r in texts.select(staging.day_of("t")).collect()] == [date(2024, 2, 29), date(1999, 12, 31), None]
    for wrong in ("20230229", "2024-1-5", "2024011", " 2024011"):
        with pytest.raises(Exception, match="CAST_INVALID_INPUT|CANNOT_PARSE"):
            texts.select(staging.day_of("t")).union(spark.createDataFrame([(wrong,)], "t string").select(staging.day_of("t"))).collect()
