"""Shared tables are written once, with what their readers ask for."""

from pyspark.sql import functions as F

from brindle import plans, registry
from brindle.registry import Tables


def asked(spark, sf_dir, f):
    plans.load()
    tables, seen = Tables(spark, sf_dir), []
    tables._count(f, seen)
    for n in tables._readers:
        if n not in registry.TABLES:
            tables[n]  # noqa: B018
    shared = [n for n in seen if n in registry.WRITTEN or n in registry.KEPT and tables._readers[n] > 1]
    return tables._demand(f, shared)


def test_only_the_columns_that_are_read_are_written(spark, sf_dir):
    def query(stg_events, int_purchases):
        a = stg_events.groupBy("source").agg(F.max("event_timestamp").alias("last"))
        return a.join(int_purchases.groupBy("source").agg(F.sum("purchase_revenue_usd").alias("paid")), "source")

    assert asked(spark, sf_dir, query) == {"stg_events": {"source", "event_timestamp", "event_name", "purchase_revenue_usd"}}


def test_what_one_scan_alone_reads_is_not_written(spark, sf_dir):
    assert asked(spark, sf_dir, registry.QUERIES["i07_session_metrics"][0]) == {}  # the optimiser takes the identity's reader out


def test_a_query_that_looks_at_rows_while_it_is_built_gets_whole_tables(spark, sf_dir):
    def query(stg_events, int_purchases):
        n = int_purchases.where("tax_usd > 1").count()
        return stg_events.select("source").distinct().withColumn("n", F.lit(n))

    got = asked(spark, sf_dir, query)
    assert len(got["stg_events"]) > 60


def test_results_are_those_of_whole_tables(spark, sf_dir, monkeypatch):
    plans.load()
    f = registry.QUERIES["i10_campaign_mart"][0]
    pruned = sorted(map(repr, Tables(spark, sf_dir).run(f).collect()))
    monkeypatch.setattr(registry, "_ASKED", {})
    monkeypatch.setattr(Tables, "_demand", lambda self, f, shared: {n: set(Tables(spark, sf_dir)[n].columns) for n in shared})
    assert sorted(map(repr, Tables(spark, sf_dir).run(f).collect())) == pruned
