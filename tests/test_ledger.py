"""Rules in which a refused row changes nothing, against plain loops."""

import random
from datetime import datetime, timedelta

from brindle.operators import folds, ledger

REQUESTS = "request_id long, product_id long, from_warehouse int, to_warehouse int, quantity int"
STOCK = "product_id long, warehouse_id int, quantity int"


def verdicts(df):
    return {r["request_id"]: r["reason"] for r in df.collect()}


def test_a_refused_transfer_changes_nothing_and_an_accepted_one_moves_its_stock(spark):
    stock = spark.createDataFrame([(1, 1, 10), (1, 2, 0)], STOCK)
    asked = spark.createDataFrame([(1, 1, 1, 2, 6), (2, 1, 1, 2, 5), (3, 1, 1, 2, 4), (4, 1, 2, 1, 3), (5, 1, 2, 1, 8)], REQUESTS)
    assert verdicts(ledger.judged_transfers(asked, stock)) == {1: None, 2: "not enough stock", 3: None, 4: None, 5: "not enough stock"}


def test_transfers_name_what_is_wrong_with_them(spark):
    products, warehouses = spark.createDataFrame([(1,), (2,)], "product_id long"), spark.createDataFrame([(1,), (2,), (3,)], "warehouse_id int")
    stock = spark.createDataFrame([(1, 1, 10)], STOCK)
    asked = [(1, 1, 1, 2, 0), (2, 9, 1, 2, 1), (3, 1, 7, 2, 1), (4, 1, 1, 7, 1), (5, 1, 2, 2, 1), (6, 2, 1, 2, 1), (7, 1, 3, 2, 1), (8, 1, 1, 3, 10), (9, 1, 3, 1, 10), (10, 1, None, 2, 1), (11, None, 1, 2, 1), (12, 1, 1, 2, None)]
    got = verdicts(ledger.judged_transfers(spark.createDataFrame(asked, REQUESTS), stock, products, warehouses))
    assert got == {1: "quantity", 2: "unknown product", 3: "unknown source", 4: "unknown destination", 5: "same warehouse", 6: "not enough stock", 7: "not enough stock", 8: None, 9: None, 10: "unknown source", 11: "unknown product", 12: "quantity"}


def test_transfers_equal_a_plain_loop(spark):
    rnd = random.Random(4)
    stock = {(p, w): rnd.randint(0, 30) for p in range(8) for w in range(1, 5) if rnd.random() < 0.8}
    # a third of all requests name one product
    asked = [(i, rnd.choice([0, 0, 0, *range(8)]), rnd.randint(1, 4), rnd.randint(1, 4), rnd.randint(0, 12)) for i in rnd.sample(range(10_000), 900)]
    held, expected = dict(stock), {}
    for i, p, a, b, q in sorted(asked):
        why = "quantity" if q <= 0 else "same warehouse" if a == b else "not enough stock" if held.get((p, a), 0) < q else None
        expected[i] = why
        if not why:
            held[p, a] -= q
            held[p, b] = held.get((p, b), 0) + q
    got = ledger.judged_transfers(spark.createDataFrame(asked, REQUESTS).repartition(7), spark.createDataFrame([(*k, q) for k, q in stock.items()], STOCK))
    assert verdicts(got) == expected and "not enough stock" in expected.values()


MOVES = "movement_id string, product_id long, warehouse_id int, movement_type string, quantity int, created_at timestamp_ntz"


def moved(rnd, n):
    start = datetime(2024, 1, 1)
    return [(f"m{i}", rnd.choice([0, 0, *range(6)]), rnd.randint(1, 3), rnd.choice(["IN", "OUT", "OUT", "RETURN", "TRANSFER_OUT", "ADJUSTMENT"]), rnd.randint(1, 20), start + timedelta(days=rnd.randint(0, 30))) for i in range(n)]


def test_movements_beyond_the_stock_are_refused_in_turn(spark, monkeypatch):
    rnd = random.Random(6)
    moves = moved(rnd, 800) + [("a", 50, 1, "OUT", 5, datetime(2024, 1, 2)), ("b", 50, 1, "IN", 5, datetime(2024, 1, 3)), ("c", 51, 1, "OUT", 5, datetime(2024, 1, 2)), ("d", 51, 1, "IN", 9, datetime(2024, 1, 1)), ("e", 52, 1, "OUT", 5, datetime(2024, 1, 1))]
    before = {(p, 1): 40 for p in range(6)} | {(52, 1): 5, (60, 1): 7}
    balance, refused, last = dict(before), {}, {}
    for i, p, w, kind, q, at in sorted(moves, key=lambda m: (m[5], m[0])):
        d = q if kind in ledger.POSITIVE else -q
        if d < 0 and balance.get((p, w), 0) + d < 0:
            refused[i] = balance.get((p, w), 0)
        else:
            balance[p, w] = balance.get((p, w), 0) + d
            last[p, w] = at
    reached = []
    monkeypatch.setattr(ledger, "ordered_fold", lambda rows, *a: reached.extend((r[0], r[1]) for r in rows.select("product_id", "warehouse_id").distinct().collect()) or folds.ordered_fold(rows, *a))
    first = spark.createDataFrame([(*k, q, None) for k, q in before.items()], "product_id long, warehouse_id int, balance long, last_updated timestamp_ntz")
    after, no = ledger.apply_within_stock(first, spark.createDataFrame(moves, MOVES).repartition(5))
    assert {r["movement_id"]: r["held"] for r in no.collect()} == refused and len(refused) > 20
    got = {(r["product_id"], r["warehouse_id"]): (r["balance"], r["last_updated"]) for r in after.collect()}
    assert {k: v for k, v in got.items() if v[1] or k in before} == {k: (balance[k], last.get(k)) for k in balance}
    where = {(m[1], m[2]) for m in moves if m[0] in refused}
    assert set(reached) == where and (50, 1) in where and not where & {(51, 1), (52, 1)}  # what refuses nothing is never folded


def test_a_fold_keeps_its_state_from_batch_to_batch(spark):
    import pyarrow as pa

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    rows = spark.range(500).selectExpr("id", "if(id % 3 = 0, null, id % 2) AS k", "1 AS n")
    got = folds.ordered_fold(rows, ["k"], ["id"], ["id"], lambda r: [0], lambda s, r: (s.__setitem__(0, s[0] + 1) or s[0],), pa.schema([("n", pa.int64())])).collect()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    by = {}
    for r in sorted(got, key=lambda r: r["id"]):
        by.setdefault(r["k"], []).append(r["n"])
    assert len(by) == 3 and all(v == list(range(1, len(v) + 1)) for v in by.values())
    assert folds.ordered_fold(rows.limit(0), ["k"], ["id"], ["id"], lambda r: [0], lambda s, r: (1,), pa.schema([("n", pa.int64())])).count() == 0
