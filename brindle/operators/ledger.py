"""The stock ledger: signed deltas, balances, transfers, receipts, reconciliation and profiles."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.operators.folds import ordered_fold
from brindle.operators.relational import QTY, as_of_ts, concentration, pair_selectivity
from brindle.registry import query, table
from brindle.session import kept
from brindle.sources.domain import AS_OF

POSITIVE = ("IN", "RETURN", "TRANSFER_IN", "ADJUSTMENT")
KEY = ["product_id", "warehouse_id"]
_SIGNED = "CASE WHEN movement_type IN ('IN', 'RETURN', 'TRANSFER_IN', 'ADJUSTMENT') THEN quantity ELSE -quantity END"


def delta() -> Column:
    """What a movement adds to its balance; an adjustment counts as positive."""
    return F.when(F.col("movement_type").isin(*POSITIVE), F.col("quantity")).otherwise(-F.col("quantity"))


@query("g01_signed_delta", f"SELECT movement_id, {_SIGNED} AS delta FROM stock_movements")
def signed_deltas(stock_movements: DataFrame) -> DataFrame:
    return stock_movements.select("movement_id", delta().alias("delta"))


@table(f"SELECT product_id, warehouse_id, sum({_SIGNED})::BIGINT AS balance, max(created_at) AS last_updated FROM stock_movements GROUP BY 1, 2")
def balances(stock_movements: DataFrame) -> DataFrame:
    return stock_movements.groupBy(*KEY).agg(F.sum(delta()).alias("balance"), F.max("created_at").alias("last_updated"))


def apply_movements(before: DataFrame, movements: DataFrame, clamp_first: bool = False) -> DataFrame:
    """Balances (product_id, warehouse_id, balance, last_updated) after a batch of movements: keys of either side stay.

    clamp_first: a key that had no balance and whose first movement takes stock away starts at 0 with that movement dropped, as a row trigger that inserts greatest(delta, 0) would have it.
    """
    rows = movements.withColumn("__delta", delta())
    if clamp_first:
        first = Window.partitionBy(*KEY).orderBy("created_at", "movement_id")
        known = before.select(*KEY, F.lit(True).alias("__known"))
        rows = rows.withColumn("__n", F.row_number().over(first)).join(known, KEY, "left")
        rows = rows.withColumn("__delta", F.when((F.col("__n") == 1) & F.col("__known").isNull(), F.greatest("__delta", F.lit(0))).otherwise(F.col("__delta")))
    sums = rows.groupBy(*KEY).agg(F.sum("__delta").alias("__d"), F.max("created_at").alias("__at"))
    return before.join(sums, KEY, "full").select(*KEY, (F.coalesce("balance", F.lit(0)) + F.coalesce("__d", F.lit(0))).alias("balance"), F.greatest("last_updated", "__at").alias("last_updated"))


@query("g02_apply_movements", f"SELECT product_id, warehouse_id, coalesce(s.quantity, 0)::BIGINT + coalesce(d, 0)::BIGINT AS balance, moved_at AS last_updated FROM stock_levels s FULL JOIN (SELECT product_id, warehouse_id, sum({_SIGNED}) AS d, max(created_at) AS moved_at FROM stock_movements GROUP BY 1, 2) USING (product_id, warehouse_id)")
def applied(stock_levels: DataFrame, stock_movements: DataFrame) -> DataFrame:
    before = stock_levels.select(*KEY, F.col("quantity").cast("long").alias("balance"), F.lit(None).cast("timestamp_ntz").alias("last_updated"))
    return apply_movements(before, stock_movements)


query("g03_last_updated", "SELECT product_id, warehouse_id, last_updated FROM balances")(lambda balances: balances.select(*KEY, "last_updated"))


def judged_movements(before: DataFrame, movements: DataFrame) -> DataFrame:
    """Movements with ``held``, the balance that their shelf has when their turn comes, and ``refused``: a balance never falls below zero, so what would take more than is there is
    refused and leaves it as it was. The turn goes by time and movement id. before: (product_id, warehouse_id, balance); other shelves start at zero.

    For the shelves that ``_doubtful`` names, and only for those, the movements are returned: on all others nothing is refused.
    """
    rows = movements.withColumn("__delta", delta().cast("long")).join(_doubtful(before, movements), KEY)
    got = ordered_fold(rows, KEY, ["created_at", "movement_id"], ["__start", "__delta"], lambda row: [row[0]], _take, pa.schema([("held", pa.int64()), ("refused", pa.bool_())]))
    return got.drop("__delta", "__start")


def _take(balance: list[int], row: tuple) -> tuple[int, bool]:
    held = balance[0]
    if row[1] < 0 and held + row[1] < 0:
        return held, True
    balance[0] += row[1]
    return held, False


def _doubtful(before: DataFrame, movements: DataFrame) -> DataFrame:
    """(product_id, warehouse_id, __start): shelves where something is refused.

    A shelf that holds all that is ever taken from it can't run short: one sum with map-side combine. Of the others, those whose running balance never falls below zero when
    all is accepted have no refusal either.
    """
    start = F.coalesce("balance", F.lit(0)).cast("long").alias("__start")
    taken = movements.groupBy(*KEY).agg(F.sum(F.least(delta().cast("long"), F.lit(0))).alias("__taken"))
    short = taken.join(before.select(*KEY, "balance"), KEY, "left").select(*KEY, start, "__taken").where("__start + __taken < 0").drop("__taken")
    turn = Window.partitionBy(*KEY).orderBy("created_at", "movement_id").rowsBetween(Window.unboundedPreceding, 0)
    running = movements.select(*KEY, "created_at", "movement_id", delta().cast("long").alias("__delta")).join(short, KEY).withColumn("__after", F.col("__start") + F.sum("__delta").over(turn))
    return running.groupBy(*KEY).agg(F.min("__after").alias("__least"), F.first("__start").alias("__start")).where("__least < 0").drop("__least")


def apply_within_stock(before: DataFrame, movements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(balances after the movements that aren't refused, the refused movements with what their shelf held)."""
    judged = kept(judged_movements(before, movements))
    others = movements.join(judged.select(*KEY).distinct(), KEY, "left_anti")
    good = others.unionByName(judged.where("NOT refused").select(*movements.columns))
    return apply_movements(before, good), judged.where("refused").drop("refused")


#: Movements one at a time, shelf by shelf.
_WITHIN = f"""(WITH RECURSIVE turns AS MATERIALIZED (
        SELECT *, {_SIGNED} AS delta, row_number() OVER (PARTITION BY product_id, warehouse_id ORDER BY created_at, movement_id) AS turn FROM stock_movements
    ), states AS (
        SELECT 0::BIGINT AS turn, k.product_id, k.warehouse_id, NULL::VARCHAR AS movement_id, NULL::TIMESTAMP AS created_at, coalesce(s.quantity, 0)::BIGINT AS held, false AS refused, coalesce(s.quantity, 0)::BIGINT AS balance
        FROM (SELECT DISTINCT product_id, warehouse_id FROM turns) k LEFT JOIN stock_levels s ON s.product_id = k.product_id AND s.warehouse_id = k.warehouse_id
        UNION ALL
        SELECT t.turn, t.product_id, t.warehouse_id, t.movement_id, t.created_at, s.balance, t.delta < 0 AND s.balance + t.delta < 0, CASE WHEN t.delta < 0 AND s.balance + t.delta < 0 THEN s.balance ELSE s.balance + t.delta END
        FROM states s JOIN turns t ON t.product_id = s.product_id AND t.warehouse_id = s.warehouse_id AND t.turn = s.turn + 1
    ) SELECT * FROM states)"""


@query("g02_rejected_movements", f"SELECT movement_id, product_id, warehouse_id, held FROM {_WITHIN} WHERE refused")
def rejected_movements(stock_levels: DataFrame, stock_movements: DataFrame) -> DataFrame:
    """Movements that would take more than their shelf holds at their turn."""
    before = stock_levels.select(*KEY, F.col("quantity").cast("long").alias("balance"))
    return judged_movements(before, stock_movements).where("refused").select("movement_id", *KEY, "held")


@query("g02_apply_within_stock", f"SELECT product_id, warehouse_id, coalesce(balance, quantity)::BIGINT AS balance, last_updated FROM (SELECT product_id, warehouse_id, arg_max(balance, turn) AS balance, max(created_at) FILTER (NOT refused) AS last_updated FROM {_WITHIN} GROUP BY 1, 2) FULL JOIN stock_levels USING (product_id, warehouse_id)")
def applied_within_stock(stock_levels: DataFrame, stock_movements: DataFrame) -> DataFrame:
    before = stock_levels.select(*KEY, F.col("quantity").cast("long").alias("balance"), F.lit(None).cast("timestamp_ntz").alias("last_updated"))
    return apply_within_stock(before, stock_movements)[0]


@query("g04_po_status", f"""SELECT po_id, CASE WHEN status IN ('DRAFT', 'CANCELLED') THEN status WHEN received > 0 AND received >= ordered THEN 'RECEIVED' WHEN received > 0 THEN 'PARTIALLY_RECEIVED' ELSE 'PLACED' END AS status,
    CASE WHEN status NOT IN ('DRAFT', 'CANCELLED') AND received > 0 AND received >= ordered THEN DATE '{AS_OF}' END AS received_date FROM purchase_order_summary WHERE lines > 0""")  # fmt: skip
def po_status(purchase_order_summary: DataFrame, as_of: str = AS_OF) -> DataFrame:
    """An order's status from its lines; drafts and cancelled orders stay as they are, and an earlier received date is kept."""
    frozen, got, all_ = F.col("status").isin("DRAFT", "CANCELLED"), F.col("received") > 0, F.col("received") >= F.col("ordered")
    status = F.when(frozen, F.col("status")).when(got & all_, "RECEIVED").when(got, "PARTIALLY_RECEIVED").otherwise("PLACED")
    before = F.col("received_date") if "received_date" in purchase_order_summary.columns else F.lit(None).cast("date")
    day = F.coalesce(before, F.when(~frozen & got & all_, F.lit(as_of).cast("date")))
    return purchase_order_summary.where("lines > 0").select("po_id", status.alias("status"), day.alias("received_date"))


@table("SELECT event_id AS request_id, (event_id * 13 % (SELECT count(*) FROM part + 3 parts))::BIGINT AS product_id, (k % 5 + 1)::INT AS from_warehouse, (k % 7 % 5 + 1)::INT AS to_warehouse, (k - 5)::INT AS quantity FROM numbered_events WHERE event_type = 'click'".replace("(SELECT count(*) FROM part + 3 parts)", "(SELECT count(*) + 3 FROM part)"))
def transfer_requests(numbered_events: DataFrame, part: DataFrame) -> DataFrame:
    """Requests to move stock between warehouses; some name no product, one warehouse twice, or no amount."""
    n = F.broadcast(part.agg((F.count("*") + 3).alias("n")))
    clicks = numbered_events.where("event_type = 'click'").crossJoin(n)
    return clicks.select(F.col("event_id").alias("request_id"), (F.col("event_id") * 13 % F.col("n")).alias("product_id"), (F.col("k") % 5 + 1).cast("int").alias("from_warehouse"), (F.col("k") % 7 % 5 + 1).cast("int").alias("to_warehouse"), (F.col("k") - 5).cast("int").alias("quantity"))


def judged_transfers(requests: DataFrame, stock_levels: DataFrame, products: DataFrame | None = None, warehouses: DataFrame | None = None) -> DataFrame:
    """Requests with a ``reason`` they are rejected for (null: accepted), one after the other by request id: an accepted one moves its stock, so a later one finds it at its
    destination; a rejected one changes nothing.

    Products and warehouses default to those that hold stock. Where no shelf that requests touch would fall below zero if all of its product's well-formed requests were
    accepted, they all are; only the other products' requests are folded in order, each product on its own, over the few shelves that it has.
    """
    some = requests.where("quantity > 0 AND from_warehouse <> to_warehouse")
    known = (stock_levels if products is None else products).select("product_id", F.lit(True).alias("__product")).distinct()
    places = (stock_levels if warehouses is None else warehouses).select("warehouse_id").distinct()
    if warehouses is None:
        places = places.unionByName(some.select(F.col("to_warehouse").alias("warehouse_id"))).distinct()
    for side in ("from", "to"):
        requests = requests.join(places.select(F.col("warehouse_id").alias(f"{side}_warehouse"), F.lit(True).alias(f"__{side}")), f"{side}_warehouse", "left")
    rows = requests.join(known, "product_id", "left")
    shape = (
        F.when(F.col("quantity").isNull() | (F.col("quantity") <= 0), "quantity").when(F.col("__product").isNull(), "unknown product").when(F.col("__from").isNull(), "unknown source")
        .when(F.col("__to").isNull(), "unknown destination").when(F.col("from_warehouse") == F.col("to_warehouse"), "same warehouse")
    )
    rows = rows.withColumn("shape", shape).drop("__product", "__from", "__to")
    formed = rows.where("shape IS NULL")
    legs = formed.select("product_id", F.col("from_warehouse").alias("warehouse_id"), F.col("quantity").cast("long").alias("taken"))
    stock = stock_levels.groupBy(*KEY).agg(F.sum("quantity").cast("long").alias("held"))
    short = legs.groupBy(*KEY).agg(F.sum("taken").alias("taken")).join(stock, KEY, "left").where(F.col("taken") > F.coalesce("held", F.lit(0))).select("product_id").distinct()
    doubtful, settled = formed.join(short, "product_id", "left_semi"), formed.join(short, "product_id", "left_anti")
    # the shelves of a product are a few numbers, as many as there are warehouses
    shelves = stock.join(short, "product_id", "left_semi").groupBy("product_id").agg(F.collect_list(F.struct("warehouse_id", "held")).alias("__shelves"))
    folded = ordered_fold(doubtful.join(shelves, "product_id", "left"), ["product_id"], ["request_id"], ["__shelves", "from_warehouse", "to_warehouse", "quantity"], _shelves, _transfer, pa.schema([("reason", pa.string())]))
    none = F.lit(None).cast("string").alias("reason")
    parts = [folded.drop("__shelves"), settled.withColumn("reason", none), rows.where("shape IS NOT NULL").withColumn("reason", F.col("shape"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).drop("shape")


def _shelves(row: tuple) -> dict:
    return {s["warehouse_id"]: s["held"] for s in row[0] or ()}


def _transfer(stock: dict, row: tuple) -> tuple[str | None]:
    _, source, destination, quantity = row
    if stock.get(source, 0) < quantity:
        return ("not enough stock",)
    stock[source] -= quantity
    stock[destination] = stock.get(destination, 0) + quantity
    return (None,)


#: Requests one at a time: shelf k of a product is the k-th number of a list.
_JUDGED = """(WITH RECURSIVE asked AS MATERIALIZED (
        SELECT r.*, CASE WHEN r.quantity <= 0 THEN 'quantity' WHEN p.product_id IS NULL THEN 'unknown product' WHEN f.warehouse_id IS NULL THEN 'unknown source' WHEN t.warehouse_id IS NULL THEN 'unknown destination' WHEN from_warehouse = to_warehouse THEN 'same warehouse' END AS shape
        FROM transfer_requests r LEFT JOIN products p USING (product_id) LEFT JOIN warehouses f ON f.warehouse_id = from_warehouse LEFT JOIN warehouses t ON t.warehouse_id = to_warehouse
    ), turns AS MATERIALIZED (
        SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY request_id) AS turn FROM asked WHERE shape IS NULL
    ), shelves AS MATERIALIZED (
        SELECT p.product_id, list(coalesce(quantity, 0)::BIGINT ORDER BY w.warehouse_id) AS shelf FROM (SELECT DISTINCT product_id FROM turns) p CROSS JOIN warehouses w LEFT JOIN stock_levels s ON s.product_id = p.product_id AND s.warehouse_id = w.warehouse_id GROUP BY 1
    ), states AS (
        SELECT 0::BIGINT AS turn, product_id, NULL::BIGINT AS request_id, NULL::VARCHAR AS reason, shelf FROM shelves
        UNION ALL
        SELECT t.turn, t.product_id, t.request_id, CASE WHEN s.shelf[t.from_warehouse] < t.quantity THEN 'not enough stock' END,
            CASE WHEN s.shelf[t.from_warehouse] < t.quantity THEN s.shelf ELSE list_transform(s.shelf, lambda q, k: q - CASE WHEN k = t.from_warehouse THEN t.quantity ELSE 0 END + CASE WHEN k = t.to_warehouse THEN t.quantity ELSE 0 END) END
        FROM states s JOIN turns t ON t.product_id = s.product_id AND t.turn = s.turn + 1
    )
    SELECT a.request_id, a.product_id, from_warehouse, to_warehouse, quantity, coalesce(shape, reason) AS reason FROM asked a LEFT JOIN states s ON s.request_id = a.request_id)"""


@query("g05_transfers", f"SELECT request_id, leg.k AS movement_type, product_id, CASE leg.k WHEN 'TRANSFER_OUT' THEN from_warehouse ELSE to_warehouse END AS warehouse_id, quantity FROM {_JUDGED}, (VALUES ('TRANSFER_OUT'), ('TRANSFER_IN')) leg(k) WHERE reason IS NULL")
def transfers(transfer_requests: DataFrame, stock_levels: DataFrame, products: DataFrame, warehouses: DataFrame) -> DataFrame:
    """The two movements of each accepted request."""
    good = judged_transfers(transfer_requests, stock_levels, products, warehouses).where("reason IS NULL")
    legs = F.array(F.struct(F.lit("TRANSFER_OUT").alias("movement_type"), F.col("from_warehouse").alias("warehouse_id")), F.struct(F.lit("TRANSFER_IN").alias("movement_type"), F.col("to_warehouse").alias("warehouse_id")))
    return good.select("request_id", F.inline(legs), "product_id", "quantity")


@query("g05_rejected_transfers", f"SELECT request_id, reason FROM {_JUDGED} WHERE reason IS NOT NULL")
def rejected_transfers(transfer_requests: DataFrame, stock_levels: DataFrame, products: DataFrame, warehouses: DataFrame) -> DataFrame:
    return judged_transfers(transfer_requests, stock_levels, products, warehouses).where("reason IS NOT NULL").select("request_id", "reason")


@query("g06_receive_orders", "SELECT po_id, product_id, warehouse_id, 'IN' AS movement_type, (quantity_ordered - quantity_received)::INT AS quantity FROM purchase_order_items JOIN purchase_orders USING (po_id) WHERE status IN ('PLACED', 'PARTIALLY_RECEIVED') AND quantity_ordered > quantity_received")
def receipts(purchase_order_items: DataFrame, purchase_orders: DataFrame) -> DataFrame:
    """The movements that bring in what open orders still lack."""
    open_ = purchase_orders.where(F.col("status").isin("PLACED", "PARTIALLY_RECEIVED")).select("po_id", "warehouse_id")
    lines = purchase_order_items.where("quantity_ordered > quantity_received").join(open_, "po_id")
    return lines.select("po_id", "product_id", "warehouse_id", F.lit("IN").alias("movement_type"), (F.col("quantity_ordered") - F.col("quantity_received")).alias("quantity"))


@query("g06_received_summary", "SELECT po_id, count(*) AS lines, sum(quantity_ordered - quantity_received)::BIGINT AS units FROM purchase_order_items JOIN purchase_orders USING (po_id) WHERE status IN ('PLACED', 'PARTIALLY_RECEIVED') AND quantity_ordered > quantity_received GROUP BY 1")
def received_summary(purchase_order_items: DataFrame, purchase_orders: DataFrame) -> DataFrame:
    return receipts(purchase_order_items, purchase_orders).groupBy("po_id").agg(F.count("*").alias("lines"), F.sum("quantity").alias("units"))


@query("g07_reconcile", "SELECT product_id, warehouse_id, s.quantity::BIGINT AS stored, b.balance AS ledger FROM stock_levels s FULL JOIN balances b USING (product_id, warehouse_id) WHERE s.quantity IS DISTINCT FROM b.balance")
def reconcile(stock_levels: DataFrame, balances: DataFrame, how: str = "full") -> DataFrame:
    """Keys whose stored quantity isn't the ledger's; how='inner' leaves out keys that only one side has."""
    both = stock_levels.select(*KEY, F.col("quantity").cast("long").alias("stored")).join(balances.select(*KEY, F.col("balance").alias("ledger")), KEY, how)
    return both.where(~F.col("stored").eqNullSafe(F.col("ledger")))


@query("g08_silent_zero", f"SELECT product_id, warehouse_id, movement_id FROM (SELECT *, row_number() OVER (PARTITION BY product_id, warehouse_id ORDER BY created_at, movement_id) AS n FROM stock_movements) WHERE n = 1 AND {_SIGNED} < 0")
def silent_zero(stock_movements: DataFrame) -> DataFrame:
    """Keys whose first movement takes stock away that nobody had brought: one minimum for each key."""
    first = F.min(F.struct("created_at", "movement_id", delta().alias("d"))).alias("f")
    return stock_movements.groupBy(*KEY).agg(first).where("f.d < 0").select(*KEY, "f.movement_id")


@query("g09_first_negative", f"SELECT product_id, warehouse_id, arg_min(movement_id, (created_at, movement_id)) AS movement_id, arg_min(running, (created_at, movement_id)) AS balance FROM (SELECT *, sum({_SIGNED}) OVER (PARTITION BY product_id, warehouse_id ORDER BY created_at, movement_id ROWS UNBOUNDED PRECEDING)::BIGINT AS running FROM stock_movements) WHERE running < 0 GROUP BY 1, 2")
def first_negative(stock_movements: DataFrame) -> DataFrame:
    """Where each running balance first falls below zero."""
    w = Window.partitionBy(*KEY).orderBy("created_at", "movement_id").rowsBetween(Window.unboundedPreceding, 0)
    below = stock_movements.withColumn("running", F.sum(delta()).over(w)).where("running < 0")
    return below.groupBy(*KEY).agg(F.min(F.struct("created_at", "movement_id", "running")).alias("f")).select(*KEY, "f.movement_id", F.col("f.running").alias("balance"))


@query("g10_valuation_snapshot", f"SELECT *, TIMESTAMP '{AS_OF}' AS refreshed_at FROM stock_valuation")
def valuation_snapshot(stock_valuation: DataFrame, as_of: str = AS_OF) -> DataFrame:
    return stock_valuation.withColumn("refreshed_at", as_of_ts(as_of))


def staleness(stored: DataFrame, live: DataFrame, on: list[str], value: str) -> DataFrame:
    """Stored and live values of each key and how far they lie apart."""
    a, b = stored.select(*on, F.col(value).alias("stored")), live.select(*on, F.col(value).alias("live"))
    return a.join(b, on, "full").select(*on, "stored", "live", (F.coalesce("live", F.lit(0)) - F.coalesce("stored", F.lit(0))).cast(QTY).alias("drift"))


@query("g11_snapshot_staleness", "SELECT code, stored, live, (live - stored)::DECIMAL(18,2) AS drift FROM (SELECT code, cost_value AS live FROM stock_valuation) JOIN (SELECT code, sum(quantity * unit_cost)::DECIMAL(18,2) AS stored FROM stock_levels JOIN products USING (product_id) JOIN warehouses USING (warehouse_id) WHERE product_id % 10 <> 0 GROUP BY 1) USING (code)")
def snapshot_staleness(stock_valuation: DataFrame, warehouses: DataFrame, stock_levels: DataFrame, products: DataFrame) -> DataFrame:
    """Against a snapshot from before a tenth of the products came."""
    from brindle.operators.inventory import stock_valuation as valuation

    old = valuation(warehouses, stock_levels.where("product_id % 10 <> 0"), products)
    return staleness(old, stock_valuation, ["code"], "cost_value")


@query("g12_refresh_drift", """WITH r AS (SELECT count(*)::DOUBLE / greatest(1, (max(created_at)::DATE - min(created_at)::DATE)) AS per_day, avg(quantity)::DOUBLE AS mean_quantity FROM stock_movements)
    SELECT v.minutes, per_day * v.minutes / 1440 AS movements, per_day * v.minutes / 1440 * mean_quantity AS units FROM r, (VALUES (1), (5), (15), (60), (1440)) v(minutes)""")  # fmt: skip
def refresh_drift(stock_movements: DataFrame, minutes: tuple[int, ...] = (1, 5, 15, 60, 1440)) -> DataFrame:
    """How many movements and units a snapshot misses, by how often it is refreshed."""
    days = F.greatest(F.date_diff(F.max("created_at"), F.min("created_at")), F.lit(1))
    r = stock_movements.agg((F.count("*").cast("double") / days).alias("per_day"), F.avg("quantity").alias("mean_quantity"))
    each = r.withColumn("minutes", F.explode(F.array(*map(F.lit, minutes))))
    moved = F.col("per_day") * F.col("minutes") / 1440
    return each.select("minutes", moved.alias("movements"), (moved * F.col("mean_quantity")).alias("units"))


@query("g14_skew_profile", """WITH n AS (SELECT product_id, count(*) AS c FROM stock_movements GROUP BY 1), r AS (SELECT c, row_number() OVER (ORDER BY c DESC) AS i FROM n)
    SELECT ceil((SELECT count(*) FROM n) * 0.05)::BIGINT AS top_keys, round(sum(c) FILTER (i <= ceil((SELECT count(*) FROM n) * 0.05))::DOUBLE / sum(c), 6) AS share FROM r""")  # fmt: skip
def skew_profile(stock_movements: DataFrame) -> DataFrame:
    return concentration(stock_movements)


@query("g15_home_share", "SELECT round(sum(n) FILTER (best = 1)::DOUBLE / sum(n), 6) AS home_share FROM (SELECT product_id, warehouse_id, count(*) AS n, row_number() OVER (PARTITION BY product_id ORDER BY count(*) DESC) AS best FROM stock_movements GROUP BY 1, 2)")
def home_share(stock_movements: DataFrame) -> DataFrame:
    """The share of movements in each product's busiest warehouse, over all rows."""
    per = stock_movements.groupBy("product_id", "warehouse_id").agg(F.count("*").alias("n")).groupBy("product_id").agg(F.max("n").alias("home"), F.sum("n").alias("all"))
    return per.agg(F.round(F.sum("home").cast("double") / F.sum("all"), 6).alias("home_share"))


@query("g16_pair_independence", "SELECT count(*) AS n, avg((quantity > 25)::INT) AS share_a, avg((movement_type IN ('IN', 'OUT'))::INT) AS share_b, avg((quantity > 25 AND movement_type IN ('IN', 'OUT'))::INT) AS share_both, avg((quantity > 25)::INT) * avg((movement_type IN ('IN', 'OUT'))::INT) AS expected_both FROM stock_movements")
def pair_independence(stock_movements: DataFrame) -> DataFrame:
    return pair_selectivity(stock_movements, F.col("quantity") > 25, F.col("movement_type").isin("IN", "OUT"))


@query("g17_order_correlation", "SELECT round(corr(o_orderkey, epoch(o_orderdate)), 6) AS correlation FROM orders")
def order_correlation(orders: DataFrame) -> DataFrame:
    """Whether the order of the keys is the order of the dates."""
    seconds = F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', cast(o_orderdate AS timestamp_ntz))")
    return orders.select(F.round(F.corr(F.col("o_orderkey").cast("double"), seconds.cast("double")), 6).alias("correlation"))


@query("g18_row_hash", "SELECT md5(string_agg(h, '' ORDER BY h)) AS hash FROM (SELECT md5(po_id || '|' || status || '|' || order_date) AS h FROM purchase_orders ORDER BY po_id LIMIT 1000)")
def head_hash(purchase_orders: DataFrame, n: int = 1_000) -> DataFrame:
    """A hash of the first n orders: the sample's size is the feature."""
    first = purchase_orders.orderBy("po_id").limit(n)
    return first.select(F.md5(F.concat_ws("|", "po_id", "status", "order_date")).alias("h")).agg(F.md5(F.array_join(F.array_sort(F.collect_list("h")), "")).alias("hash"))
