"""Steps that many queries share: what they move and how often they are done."""

from pyspark.sql import functions as F

from brindle import plans, registry
from brindle.operators import staging


def test_a_parameter_from_its_place_or_the_largest_of_repeats(spark):
    value = "struct<string_value: string, int_value: bigint, double_value: double>"
    rows = [(1, [("a", (None, 5, None)), ("b", ("x", None, None))]), (2, [("a", (None, 3, None)), ("b", ("y", None, None)), ("a", (None, 9, None))]), (3, [("b", (None, None, None))]), (4, []), (5, None), (6, [("a", None), (None, (None, 4, None))])]
    df = spark.createDataFrame(rows, f"n int, event_params array<struct<key: string, value: {value}>>")
    got = df.select("n", staging.param("a", "int_value").alias("a"), staging.param("b", "string_value").alias("b")).orderBy("n").collect()
    assert [(r["a"], r["b"]) for r in got] == [(5, "x"), (9, "y"), (None, None), (None, None), (None, None), (None, None)]


def test_purchases_leave_other_events_out_before_the_shuffle(spark, sf_dir):
    plans.load()
    flat = registry.Tables(spark, sf_dir)["flat_events"]
    plan = flat.where("event_name = 'purchase'").select("event_key")._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" not in plan[: plan.index("Aggregate [event_key")] and "Filter" in plan, plan


def test_events_of_one_row_group_are_dealt_to_all_cores(spark, sf_dir):
    plans.load()
    assert spark.read.parquet(f"{sf_dir}/events.parquet").rdd.getNumPartitions() == 1
    flat = registry.Tables(spark, sf_dir)["web_export"].select("event_params")
    assert "RepartitionByExpression" in flat._jdf.queryExecution().optimizedPlan().toString()


def test_identity_and_flat_events_are_worked_out_once(spark, sf_dir):
    plans.load()
    asked = {}
    for name in ("k03_touches", "m22_touched_sessions"):
        tables = registry.Tables(spark, sf_dir)
        tables.run(registry.QUERIES[name][0])
        asked[name] = set(tables._asked)
    assert "int_identity" in asked["k03_touches"]
    assert "flat_events" in asked["m22_touched_sessions"]


def test_a_first_run_over_an_empty_export_makes_empty_tables(spark, sf_dir, tmp_path):
    from brindle.operators.build import IncrementalBuild

    plans.load()
    build = IncrementalBuild(spark, str(tmp_path))
    empty = registry.Tables(spark, sf_dir)["flat_events"].where("false")
    assert build.run(empty) and build.run(empty) == []
    assert build.read("orders").count() == 0


def test_wide_events_are_not_shuffled_again(spark, sf_dir):
    plans.load()
    flat = registry.Tables(spark, sf_dir)["flat_events"]
    plan = flat._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1, plan  # of narrow rows, before they are nested


def test_only_purchases_are_joined_with_their_orders(spark, sf_dir):
    plans.load()
    flat = registry.Tables(spark, sf_dir)["flat_events"]
    staged = staging.stg_events(flat)
    plan = staged.where("event_name <> 'purchase'")._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftOuter" not in plan, plan
    some = spark.createDataFrame(flat.limit(30).collect(), flat.schema)
    some = some.unionByName(some.withColumns({"event_name": F.lit(None).cast("string"), "event_id": F.lit(None).cast("bigint"), "event_key": F.concat("event_key", F.lit("x"))}))
    rows = staging.stg_events(some).collect()
    assert len(rows) == 60 and all((r["order_id"] is not None) == (r["event_name"] == "purchase") for r in rows)


def test_a_query_of_one_model_works_out_no_other(spark):
    plans.load()
    touch = "source string, order_id string, order_date date, ordered_at timestamp_ntz, person_id string, order_session_key string, revenue double, own boolean, session_key string, session_start_at timestamp_ntz, "
    touch += "session_source string, session_medium string, session_campaign string, position int, touches bigint, direct boolean, days_before double, complete boolean"
    df = registry.QUERIES["k10_position_based"][0](journey_touches=spark.createDataFrame([], touch))
    assert "time_decay" not in df._jdf.queryExecution().analyzed().toString()


def test_purchases_are_shuffled_once_to_find_their_orders(spark, sf_dir):
    plans.load()
    flat = spark.createDataFrame([], registry.Tables(spark, sf_dir)["flat_events"].schema)
    exchanges = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert exchanges(staging.with_orders(flat.where("event_name = 'purchase'"))) == 1
    assert exchanges(staging.stg_events(flat).select("event_key", "user_pseudo_id")) == 0  # who asks for no orders has none worked out


def test_purchases_of_no_source_have_no_order(spark, sf_dir):
    plans.load()
    flat = registry.Tables(spark, sf_dir)["flat_events"].where("event_name = 'purchase'").limit(20)
    some = spark.createDataFrame(flat.collect(), flat.schema)
    got = staging.stg_events(some.withColumn("source", F.when(F.col("event_id") % 2 == 0, F.col("source")))).collect()
    assert len(got) == 20 and all((r["source"] is None) == (r["order_id"] is None) == (r["is_duplicate_purchase"] is None) == (r["is_zero_value_without_id"] is None) for r in got)


def test_sessions_are_sorted_and_shuffled_once(spark, sf_dir):
    from brindle.operators import orders

    plans.load()
    staged = staging.stg_events(spark.createDataFrame([], registry.Tables(spark, sf_dir)["flat_events"].schema))
    plan = orders.sessions_of(staged).select("session_start_at", "last_click", "collected")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "REPARTITION_BY_COL" in plan, plan


def test_identity_of_all_events_is_that_of_their_days(spark):
    from datetime import datetime

    from brindle.operators import orders

    at = lambda day: datetime(2024, 1, day)
    data = [("a", "d1", "u1", 1, 1), ("a", "d1", "u1", 2, 2), ("a", "d1", None, None, 3), ("a", "d2", "u1", 5, 4), ("a", "d2", "u2", 5, 5), ("b", "d2", None, 7, 6), (None, "d3", "u3", 8, 7), (None, "d3", "u3", 9, 8), ("", "d3", None, 1, 9), ("a", None, "u9", 1, 9)]
    events = spark.createDataFrame([(*r[:4], at(r[4]), at(r[4]).date()) for r in data], "source string, user_pseudo_id string, user_id string, ga_session_id bigint, event_timestamp timestamp_ntz, event_date date")
    got, want = orders.identity_of_events(events), orders.int_identity(staging.int_device_days(events))
    assert got.schema.names == want.schema.names
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    plan = got.select("source", "user_pseudo_id", "person_id")._jdf.queryExecution().executedPlan().toString()
    assert "collect" not in plan and "LeftOuter" not in plan, plan
