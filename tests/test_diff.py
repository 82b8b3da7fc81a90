"""Differences by descent, sequences, alerts and refreshed valuations."""

import random
from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from brindle.operators import diff, monitoring, quality

KIND = "k int, v string, xs array<int>, m map<string,int>"


def table(spark, rows):
    return spark.createDataFrame(rows, KIND)


def base(n=2000):
    return [(i, f"v{i}", [i, 1], {"a": i, "b": 1}) for i in range(n)]


def found(df):
    return {r["side"]: (r["rows"], r["examples"]) for r in df.collect()}


def test_equal_tables_are_told_equal_by_a_few_rows(spark, monkeypatch):
    a, b = table(spark, base() + [(None, None, None, None)] * 2), table(spark, [(None, None, None, None)] * 2 + base()[::-1]).repartition(9)
    looked = []
    real = diff._fingerprints
    monkeypatch.setattr(diff, "_fingerprints", lambda placed, level, side: looked.append(level) or real(placed, level, side))
    assert found(diff.table_diff(a, b, ["k"])) == {"only in first": (0, []), "only in second": (0, [])}
    assert looked == [0, 0] and diff.same_rows(a, b, ["k"])


def test_a_difference_is_found_among_the_rows_of_its_bucket(spark, monkeypatch):
    rows = base()
    changed = [r if r[0] != 77 else (77, None, [77, 1], {"a": 77, "b": 1}) for r in rows[5:]] + [rows[9]] + [(5000, "new", None, {})]
    a, b = table(spark, rows), table(spark, changed)
    left, right, places = diff.differing_buckets(a, b, ["k"])
    assert places.count() <= 8 and left.count() <= 20 and right.count() <= 20  # of 2,000
    assert found(diff.table_diff(a, b, ["k"])) == {"only in first": (6, [f'{{"k":{i}}}' for i in (0, 1, 2, 3, 4, 77)]), "only in second": (3, ['{"k":5000}', '{"k":77}', '{"k":9}'])}
    assert found(diff.table_diff(a, b, ["k"], examples=2))["only in first"] == (6, ['{"k":0}', '{"k":1}'])
    assert not diff.same_rows(a, b, ["k"]) and not diff.same_rows(a, a.limit(0), ["k"])
    nulls = spark.createDataFrame([(None, 1)], "k int, v int"), spark.createDataFrame([(1, None)], "k int, v int")
    assert not diff.same_rows(*nulls, ["k", "v"])


def test_diff_equals_counting(spark):
    rnd = random.Random(8)
    some = lambda: [(rnd.randint(0, 40), rnd.choice("ab"), [rnd.randint(0, 1)], {"x": 1}) for _ in range(300)]
    a, b = some(), some()
    text = lambda rows: [repr(r) for r in rows]
    more = lambda x, y: sum(max(text(x).count(t) - text(y).count(t), 0) for t in set(text(x)))
    got = found(diff.table_diff(table(spark, a), table(spark, b), ["k"]))
    assert (got["only in first"][0], got["only in second"][0]) == (more(a, b), more(b, a))


def test_sequences_that_depart_or_end_too_early(spark):
    at = datetime(2024, 1, 1)
    sessions = {"good": "ABC", "long": "ABCAB", "short": "AB", "wrong": "AXC", "late": "ABX", "none": "B", "again": "AABC"}
    rows = [(s, f"{s}{i}", e, at + timedelta(minutes=i)) for s, events in sessions.items() for i, e in enumerate(events)] + [(None, "x", "A", at)]
    df = spark.createDataFrame(rows, "session_key string, event_key string, event_name string, event_timestamp timestamp_ntz").repartition(5)
    run = lambda course: {r[0]: tuple(r)[1:] for r in quality.sequence_mismatch(df, course).collect()}
    strict = run((("A", False), ("B", False), ("C", False)))
    assert strict == {"short": (3, "C", None), "wrong": (2, "B", "X"), "late": (3, "C", "X"), "none": (1, "A", "B"), "again": (2, "B", "A")}
    assert run((("A", True), ("B", False), ("C", False))) == {k: v for k, v in strict.items() if k != "again"}
    assert quality.transitions((("A", True), ("B", False))) == {(0, "A"): 1, (1, "A"): 1, (1, "B"): 2}


def test_an_alert_keeps_its_whole_record(spark):
    fired = spark.createDataFrame([("s", "m", date(2024, 1, 1), 5.0, "mad", "up", "warning", 2.0, 1.0, 3.0, 1.7, 21, 9.0, "w"), ("s", "m", date(2024, 1, 1), 4.0, "mad", "down", "critical", 2.5, 1.5, 3.5, -4.0, 20, 8.0, "c")],
        "source string, metric string, day date, value double, rule string, direction string, severity string, expected double, band_low double, band_high double, score double, history_days bigint, volume double, detail string")
    none = fired.limit(0).select(*monitoring.ALERT_KEY).withColumns({"first_detected_at": F.lit(None).cast("timestamp_ntz"), "notified_at": F.lit(None).cast("timestamp_ntz"), "delivery": F.lit(None).cast("string")})
    state = monitoring.upsert_alerts(fired, none, "2024-01-10")
    assert tuple(state.columns) == monitoring.ALERT_RECORD and len(state.columns) == 19
    row = state.collect()[0].asDict()
    assert (row["severity"], row["value"], row["expected"], row["direction"], row["score"], row["detail"], row["volume"]) == ("critical", 4.0, 2.5, "down", -4.0, "c", 8.0)


def test_rules_are_a_table_with_a_sources_own_first(spark, tmp_path):
    (tmp_path / "rules.json").write_text('{"metric": "orders", "scale": "linear", "least": 0, "direction": "down", "floor": 5, "move": 0}\n{"source": "b", "metric": "orders", "scale": "log", "least": 0, "direction": "both", "move": 1}\n')
    by = monitoring.read_rules(spark, str(tmp_path / "rules.json"))
    series = spark.createDataFrame([(s, m, date(2024, 1, 1), v, None) for s in "ab" for m, v in (("orders", 3.0), ("other", 1.0))] + [("a", "orders", None, float("nan"), None)], "source string, metric string, day date, value double, volume double")
    got = {r["source"]: (r["scale"], r["floor"], round(r["y"], 3)) for r in monitoring.judgeable(series, by).collect()}
    assert got == {"a": ("linear", 5.0, 3.0), "b": ("log", None, 1.386)}
