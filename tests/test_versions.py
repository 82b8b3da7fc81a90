"""Tables that are replaced all at once, keyed upserts, and streams that end in them."""

import random

import pytest
from pyspark.sql import functions as F

from brindle.sources import io, versions
from brindle.sources.versions import ConcurrentWrite, KeyedTable, VersionedTable

DAYS = "day string, n int"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_replaced_slices_and_their_history(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    assert t.versions() == [] and t.replace(spark.createDataFrame([("a/b", 1), ("b", 2), (None, 3)], DAYS), F.col("day")) == 1
    assert t.replace(spark.createDataFrame([("b", 20), ("c", 30)], DAYS), F.col("day")) == 2
    assert rows(t.read()) == [("a/b", 1), ("b", 20), ("c", 30), (None, 3)] and rows(t.read(version=1)) == [("a/b", 1), ("b", 2), (None, 3)]
    assert rows(t.read(["b", versions.NULL])) == [("b", 20), (None, 3)]
    t.expire(["a/b"])
    t.replace(spark.createDataFrame([("c", 31)], DAYS), F.col("day"), slices=["b", "c"])  # b is in the window, but has no rows any more
    assert rows(t.read()) == [("c", 31), (None, 3)] and t.versions() == [1, 2, 3, 4]
    assert t.vacuum(keep=1) > 0 and t.versions() == [4] and rows(t.read()) == [("c", 31), (None, 3)]
    t.overwrite(spark.createDataFrame([("z", 1)], DAYS), F.col("day"))
    assert rows(t.read()) == [("z", 1)]
    t.expire(["z"])
    assert rows(t.read()) == []


def test_a_writer_that_dies_before_its_commit_leaves_the_old_version(spark, tmp_path, monkeypatch):
    t = VersionedTable(spark, str(tmp_path / "t"))
    t.replace(spark.createDataFrame([("a", 1), ("b", 2)], DAYS), F.col("day"))

    def killed(self, manifest):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(VersionedTable, "_commit", killed)
        with pytest.raises(KeyboardInterrupt):
            t.replace(spark.createDataFrame([("a", 9), ("c", 9)], DAYS), F.col("day"))
    assert rows(t.read()) == [("a", 1), ("b", 2)] and t.versions() == [1]
    assert t.vacuum() == 2 and rows(t.read()) == [("a", 1), ("b", 2)]


def test_of_two_writers_of_a_version_one_is_refused(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    t.replace(spark.createDataFrame([("a", 1)], DAYS), F.col("day"))
    seen = t.manifest()
    t.replace(spark.createDataFrame([("a", 2)], DAYS), F.col("day"), before=seen)
    with pytest.raises(ConcurrentWrite):
        t.replace(spark.createDataFrame([("a", 3)], DAYS), F.col("day"), before=seen)
    assert rows(t.read()) == [("a", 2)]


def test_an_upsert_rewrites_the_buckets_it_touches(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), ["k"], buckets=8)
    first = [(k, k * 10, None) for k in range(100)] + [(None, -1, None)]
    t.upsert(spark.createDataFrame(first, "k int, v int, w string"), batch=0)
    before = t.manifest()["slices"]
    assert len(before) == 8
    t.upsert(spark.createDataFrame([(5, 1, "x")], "k int, v int, w string"), batch=1)
    after = t.manifest()["slices"]
    assert sum(before[s] != after[s] for s in before) == 1
    assert rows(t.read().where("k in (4, 5, 6)")) == [(4, 40, None), (5, 1, "x"), (6, 60, None)] and t.read().count() == 101
    add = lambda c: F.coalesce(F.col(f"old.{c}"), F.lit(0)) + F.coalesce(F.col(f"new.{c}"), F.lit(0)) if c == "v" else F.col(f"new.{c}")
    more = spark.createDataFrame([(5, 100, None), (500, 7, None)], "k int, v int, w string")
    assert t.upsert(more, add, batch=2) and t.upsert(more, add, batch=2) is None  # a repeated batch adds nothing
    assert rows(t.read().where("k in (5, 500)")) == [(5, 101, None), (500, 7, None)]
    assert t.upsert(more.limit(0), batch=3) is None
    t.upsert(spark.createDataFrame([(None, 1, "n")], "k int, v int, w string"), add, batch=4)
    assert rows(t.read().where("k is null")) == [(None, 0, "n")]
    assert KeyedTable(spark, str(tmp_path / "t"), ["k"], buckets=99).buckets == 8


def test_partitions_are_replaced_and_expired_by_version(spark, tmp_path):
    path = str(tmp_path / "t")
    days = spark.createDataFrame([("2024-01-01", 1), ("2024-01-02", 2)], DAYS)
    io.replace_partitions(days, path, "day")
    io.replace_partitions(spark.createDataFrame([("2024-01-02", 20)], DAYS), path, "day")
    io.expire(spark, path, ["2024-01-01"])
    assert rows(io.current(spark, path)) == [("2024-01-02", 20)]
    assert rows(VersionedTable(spark, path).read(version=2)) == [("2024-01-01", 1), ("2024-01-02", 20)]


def test_a_filter_on_any_clustered_column_skips_most_files(spark, tmp_path):
    import pyarrow.parquet as pq

    rnd = random.Random(1)
    path = str(tmp_path / "t")
    data = [(rnd.choice("ab"), int(1000 * rnd.random() ** 3), rnd.choice(["x", "y", "z"]) + str(rnd.randint(0, 999))) for _ in range(6000)] + [("a", None, None)]
    df = spark.createDataFrame(data, "kind string, n int, s string")
    io.write_clustered(df, path, "kind", ["n", "s"], files=32)
    assert rows(spark.read.parquet(path).select("kind", "n", "s")) == rows(df)
    files = list((tmp_path / "t").rglob("*.parquet"))
    for column, value in (("n", 100), ("s", "y500")):
        hit = 0
        for f in files:
            meta = pq.ParquetFile(f).metadata
            c = next(i for i in range(meta.num_columns) if meta.schema.column(i).name == column)
            stats = [meta.row_group(g).column(c).statistics for g in range(meta.num_row_groups)]
            hit += any(x is not None and x.has_min_max and x.min <= value <= x.max for x in stats)
        assert len(files) >= 30 and hit < len(files) / 2, (column, hit, len(files))


def test_balances_from_a_stream_that_stops_and_repeats(spark, tmp_path):
    from brindle.operators import ledger
    from brindle.streaming import twins

    rnd = random.Random(2)
    moves = [(rnd.randint(0, 20), rnd.randint(1, 3), rnd.choice(["IN", "OUT"]), rnd.randint(1, 9), f"2024-01-{1 + i % 28:02d}") for i in range(400)]
    df = spark.createDataFrame(moves, "product_id long, warehouse_id int, movement_type string, quantity int, d string").withColumn("created_at", F.col("d").cast("timestamp_ntz")).drop("d")
    table = KeyedTable(spark, str(tmp_path / "b"), ledger.KEY, buckets=4)
    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    for part in df.randomSplit([1.0, 1.0], seed=1):
        part.write.mode("append").parquet(source)
        progress = twins.streaming_balances(spark.readStream.schema(df.schema).parquet(source), table, state).lastProgress
        assert not progress["stateOperators"]  # the sums are in the table
    assert rows(table.read()) == rows(ledger.balances(df))
    last, before = table.manifest()["notes"]["batch"], table.versions()
    twins.post_movements(table, df, last)  # a batch that comes again
    assert table.versions() == before and rows(table.read()) == rows(ledger.balances(df))


def test_first_purchases_end_their_state_and_late_ones_still_win(spark, tmp_path):
    from brindle.streaming import twins

    kind = "source string, event_key string, at string, order_key string, device string"
    table = KeyedTable(spark, str(tmp_path / "p"), twins.PURCHASE_KEYS, buckets=4)
    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    arrivals = [
        [("s", f"e{i}", "2024-01-01 10:00:00", f"o{i}", "d") for i in range(20)],
        [("s", "a", "2024-01-01 09:00:00", "o1", "d"), ("s", "b", "2024-01-01 11:00:00", "o2", "d"), ("s", "c", "2024-01-01 10:00:00", "o3", "other"), ("s", "c0", "2024-01-01 10:00:00", "o4", "d")],  # earlier, later, another device, a tie
        [("s", "z", "2024-02-01 00:00:00", "new", "d")],
        [("s", "z2", "2024-02-01 00:00:01", "new2", "d")],
        [("s", "w", "2024-02-01 08:00:00", "o5", "d")],  # a repeat of what the stream has forgotten
    ]
    held = []
    for part in arrivals:
        df = spark.createDataFrame(part, kind).withColumn("event_timestamp", F.col("at").cast("timestamp_ntz")).drop("at")
        df.write.mode("append").parquet(source)
        held.append(twins.first_purchases(spark.readStream.schema(df.schema).parquet(source), table, state=state).lastProgress["stateOperators"][0]["numRowsTotal"])
    every = [p for part in arrivals for p in part]
    expected = {}
    for s, key, at, order, device in every:
        expected[s, order, device] = min(expected.get((s, order, device), ("9",)), (at, key))
    assert {(r["source"], r["order_key"], r["device"]): r["event_key"] for r in table.read().collect()} == {k: v[1] for k, v in expected.items()}
    assert max(held) >= 21 and held[-1] <= 4, held


def test_first_purchases_behind_the_watermark_still_win(spark, tmp_path):
    from brindle.streaming import twins

    kind = "source string, event_key string, at string, order_key string, device string"
    table = KeyedTable(spark, str(tmp_path / "p"), twins.PURCHASE_KEYS, buckets=4)
    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    arrivals = [
        [("s", "a", "2024-01-20 10:00:00", "o1", "d"), ("s", "b", "2024-01-20 10:00:00", "o2", "d")],
        [("s", "c", "2024-03-01 00:00:00", "o1", "d")],  # a repeat moves the watermark, and nothing reaches the table
        [("s", "d", "2024-01-05 00:00:00", "o2", "d"), ("s", "e", "2024-02-10 00:00:00", "o3", "d"), ("s", "f", "2024-01-21 00:00:00", "o1", "d")],  # all behind it
    ]
    queries = []
    for part in arrivals:
        df = spark.createDataFrame(part, kind).withColumn("event_timestamp", F.col("at").cast("timestamp_ntz")).drop("at")
        df.coalesce(1).write.mode("append").parquet(source)
        queries.append(twins.first_purchases(spark.readStream.schema(df.schema).parquet(source), table, state=state))
    assert {r["order_key"]: r["event_key"] for r in table.read().collect()} == {"o1": "a", "o2": "d", "o3": "e"}
    dropped = sum(o["numRowsDroppedByWatermark"] for p in queries[-1].recentProgress for o in p["stateOperators"])
    assert dropped == 3, dropped


def test_first_purchases_need_no_python_for_each_key(spark, tmp_path, monkeypatch):
    from pyspark.sql import GroupedData

    from brindle.streaming import twins

    monkeypatch.setattr(GroupedData, "applyInPandasWithState", None)
    df = spark.createDataFrame([("s", "a", "o", "d")], "source string, event_key string, order_key string, device string").withColumn("event_timestamp", F.lit("2024-01-20").cast("timestamp_ntz"))
    df.write.parquet(str(tmp_path / "in"))
    table = KeyedTable(spark, str(tmp_path / "p"), twins.PURCHASE_KEYS, buckets=4)
    twins.first_purchases(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), table, state=str(tmp_path / "state"))
    assert table.read().count() == 1
