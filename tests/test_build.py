"""The incremental build against a full one, stopped and resumed; the refreshed valuation against a rebuild."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from brindle import plans
from brindle.operators import build, orders, staging, views
from brindle.operators.diff import same_rows
from brindle.registry import Tables
from brindle.session import kept


def test_runs_follow_the_export_and_resume_where_they_were_stopped(spark, sf_dir, tmp_path, monkeypatch):
    plans.load()
    full = kept(Tables(spark, sf_dir)["flat_events"].where("user_pseudo_id < 'd4' AND event_date < DATE'2024-01-28'"))
    early = full.where("event_date < DATE'2024-01-23' AND NOT (event_date >= DATE'2024-01-20' AND event_id % 13 = 0)")
    b = build.IncrementalBuild(spark, str(tmp_path / "state"))
    assert b.read("orders") is None and b.run(early) == list(build.STEPS) and b.run(early) == []
    before, seen = b.versions(), b.read("orders").count()

    def stopped(self, *a):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(build.IncrementalBuild, "_sessions", stopped)
        with pytest.raises(KeyboardInterrupt):
            b.run(full)
    assert b.versions() == before and b.read("orders").count() == seen and b.read("events").count() == early.count()
    assert b.run(full) == ["sessions", "orders", "record"]  # what was finished isn't done again

    def check(export):
        stg, days = staging.stg_events(export), staging.int_device_days(export)
        identity = orders.int_identity(days)
        sessions = orders.fct_sessions(stg, identity)
        assert same_rows(b.read("events"), export, ["event_key"])
        assert same_rows(b.read("identity").drop("first_seen_at"), identity.drop("first_seen_at"), ["source", "user_pseudo_id"])
        assert same_rows(b.read("sessions"), sessions, ["session_key"])
        assert same_rows(b.read("orders"), orders.fct_orders(staging.int_purchases(stg), sessions, identity), ["source", "order_id"])

    check(full)
    # days before the window aren't written again
    old = {s: f for s, f in b.table("events").manifest(before["events"])["slices"].items() if s.split("/")[1] < "2024-01-15"}
    new = b.table("events").manifest()["slices"]
    assert old and all(new[s] == f for s, f in old.items())
    less = full.where("event_date <> DATE'2024-01-25' OR source = 'store_b'")  # a day has vanished from the export
    assert b.run(less) == list(build.STEPS)
    check(less)


def test_a_refreshed_valuation_equals_a_rebuild_and_reads_what_changed(spark, tmp_path):
    rnd = random.Random(3)
    warehouses = spark.createDataFrame([(w, f"WH{w}", "n") for w in range(1, 5)], "warehouse_id int, code string, name string")
    price = lambda: Decimal(rnd.randint(100, 9999)) / 100
    products = {p: (price(), price()) for p in range(300)}
    stock = {(p, w): rnd.randint(0, 50) for p in range(300) for w in range(1, 4) if rnd.random() < 0.7}
    after, prices = dict(stock), dict(products)
    for k in rnd.sample(sorted(stock), 40):
        after[k] = rnd.randint(0, 50)
    for k in [k for k in stock if k[1] == 3]:
        after.pop(k, None)  # warehouse 3 is emptied
    for p in range(5):
        after[p, 4] = 7  # warehouse 4 gets its first stock
    for p in rnd.sample(range(300), 20):
        prices[p] = (price(), price())
    frame = lambda s, p: (spark.createDataFrame([(*k, q) for k, q in s.items()], "product_id long, warehouse_id int, quantity int"), spark.createDataFrame([(k, *v) for k, v in p.items()], "product_id long, unit_cost decimal(12,2), unit_price decimal(12,2)"))
    old, new = frame(stock, products), frame(after, prices)
    new[0].write.parquet(str(tmp_path / "stock"))
    live = spark.read.parquet(str(tmp_path / "stock"))
    moved = [(*k, stock.get(k), after.get(k)) for k in {*stock, *after} if stock.get(k) != after.get(k)]
    dearer = [(p, products[p][0], prices[p][0], products[p][1], prices[p][1]) for p in products if products[p] != prices[p]]
    change = views.valuation_change(
        spark.createDataFrame(moved, "product_id long, warehouse_id int, before int, after int"),
        spark.createDataFrame(dearer, "product_id long, unit_cost_before decimal(12,2), unit_cost_after decimal(12,2), unit_price_before decimal(12,2), unit_price_after decimal(12,2)"), live, new[1])
    got = views.refreshed_valuation(views.stored_valuation(warehouses, *old), change)
    plain = lambda df: sorted(tuple(r[c] for c in ("warehouse_id", "units", "cost_value", "retail_value", "stock_rows")) for r in df.collect())
    assert plain(got) == plain(views.stored_valuation(warehouses, *new))
    assert "In(product_id" in change._jdf.queryExecution().executedPlan().toString()  # the filter reaches the files
