"""Relational building blocks over the inventory tables: projection, filter, sort, set operations, joins, aggregates and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.registry import query
from brindle.session import kept
from brindle.sources.domain import AS_OF

QTY = "decimal(18,2)"


def as_of_ts(as_of: str = AS_OF) -> Column:
    return F.lit(as_of).cast("timestamp_ntz")


# --- B: projection, filter, sort, limit, sets ------------------------------------------------------


@query("b01_projection_filter", "SELECT sku, name, unit_price FROM products WHERE unit_price > 950")
def costly_products(products: DataFrame, least: int = 950) -> DataFrame:
    return products.select("sku", "name", "unit_price").where(F.col("unit_price") > least)


@query("b02_top_k", "SELECT sku, name, unit_price FROM products ORDER BY unit_price DESC, sku LIMIT 10")
def top_k(products: DataFrame, k: int = 10) -> DataFrame:
    return products.select("sku", "name", "unit_price").orderBy(F.col("unit_price").desc(), "sku").limit(k)


@query("b03_nulls_order", "SELECT category_id, name, parent_id, row_number() OVER (ORDER BY parent_id ASC NULLS FIRST, name)::INT AS pos, row_number() OVER (ORDER BY parent_id DESC NULLS LAST, name)::INT AS pos_desc FROM categories")
def nulls_order(categories: DataFrame) -> DataFrame:
    """Both explicit null orders; the windows run over the few categories."""
    pos = lambda *o: F.row_number().over(Window.orderBy(*o))
    return categories.select("*", pos(F.asc_nulls_first("parent_id"), "name").alias("pos"), pos(F.desc_nulls_last("parent_id"), "name").alias("pos_desc"))


@query("b04_in_list", "SELECT po_id, status, order_date FROM purchase_orders WHERE status IN ('PLACED', 'PARTIALLY_RECEIVED')")
def in_list(purchase_orders: DataFrame, statuses: tuple[str, ...] = ("PLACED", "PARTIALLY_RECEIVED")) -> DataFrame:
    return purchase_orders.where(F.col("status").isin(*statuses)).select("po_id", "status", "order_date")


@query("b05_like", "SELECT supplier_id, contact_email, p.pattern FROM suppliers, (VALUES ('%@supply.example'), ('%.00000000_@%'), ('nobody%')) p(pattern) WHERE contact_email LIKE p.pattern")
def like(suppliers: DataFrame, patterns: tuple[str, ...] = ("%@supply.example", "%.00000000_@%", "nobody%")) -> DataFrame:
    """A value column against a column of patterns: each row is multiplied by the few patterns and filtered."""
    rows = suppliers.select("supplier_id", "contact_email", F.explode(F.array(*map(F.lit, patterns))).alias("pattern"))
    return rows.where(F.expr("contact_email LIKE pattern"))


@query("b06_date_range", "SELECT movement_id, product_id, created_at FROM stock_movements WHERE created_at >= TIMESTAMP '2000-01-01' AND created_at < TIMESTAMP '2000-04-01'")
def date_range(stock_movements: DataFrame, start: str = "2000-01-01", end: str = "2000-04-01") -> DataFrame:
    """Half-open, on the bare column, so that it reaches the scan."""
    return stock_movements.where((F.col("created_at") >= as_of_ts(start)) & (F.col("created_at") < as_of_ts(end))).select("movement_id", "product_id", "created_at")


@query("b07_trailing_days", f"SELECT movement_type, count(*) AS movements FROM stock_movements WHERE created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY AND created_at <= TIMESTAMP '{AS_OF}' GROUP BY 1")
def trailing_days(stock_movements: DataFrame, days: int = 30, as_of: str = AS_OF) -> DataFrame:
    now = as_of_ts(as_of)
    recent = stock_movements.where((F.col("created_at") >= now - F.expr(f"INTERVAL {days} DAYS")) & (F.col("created_at") <= now))
    return recent.groupBy("movement_type").agg(F.count("*").alias("movements"))


@query("b08_point_lookup", "SELECT movement_type, count(*) AS movements, sum(quantity)::BIGINT AS quantity, max(created_at) AS last_at FROM stock_movements WHERE product_id = 42 AND warehouse_id = 3 GROUP BY 1")
def point_lookup(stock_movements: DataFrame, product_id: int = 42, warehouse_id: int = 3) -> DataFrame:
    rows = stock_movements.where((F.col("product_id") == product_id) & (F.col("warehouse_id") == warehouse_id))
    return rows.groupBy("movement_type").agg(F.count("*").alias("movements"), F.sum("quantity").alias("quantity"), F.max("created_at").alias("last_at"))


@query("b09_case", "SELECT product_id, CASE WHEN unit_price < 920 THEN 'low' WHEN unit_price < 960 THEN 'mid' ELSE 'high' END AS band FROM products")
def price_band(products: DataFrame) -> DataFrame:
    return products.select("product_id", F.when(F.col("unit_price") < 920, "low").when(F.col("unit_price") < 960, "mid").otherwise("high").alias("band"))


@query("b10_union_all_signed", "SELECT 'in' AS flow, product_id, quantity FROM stock_movements WHERE movement_type = 'IN' UNION ALL SELECT 'out', product_id, -quantity FROM stock_movements WHERE movement_type = 'OUT'")
def signed_feed(stock_movements: DataFrame) -> DataFrame:
    part = lambda kind, flow, sign: stock_movements.where(F.col("movement_type") == kind).select(F.lit(flow).alias("flow"), "product_id", (F.col("quantity") * sign).alias("quantity"))
    return part("IN", "in", 1).unionByName(part("OUT", "out", -1))


@query("b11_union_distinct", "SELECT product_id, warehouse_id FROM stock_movements WHERE movement_type = 'IN' UNION SELECT product_id, warehouse_id FROM stock_movements WHERE movement_type = 'OUT'")
def union_distinct(stock_movements: DataFrame) -> DataFrame:
    keys = lambda kind: stock_movements.where(F.col("movement_type") == kind).select("product_id", "warehouse_id")
    return keys("IN").union(keys("OUT")).distinct()


def symmetric_difference(a: DataFrame, b: DataFrame, names: tuple[str, str] = ("first", "second")) -> DataFrame:
    """Distinct rows that only one of two tables of the same columns has, with the name of that side in ``only_in``."""
    return a.subtract(b).withColumn("only_in", F.lit(names[0])).unionByName(b.subtract(a).withColumn("only_in", F.lit(names[1])))


@query("b12_symmetric_difference", """WITH i AS (SELECT DISTINCT product_id, warehouse_id FROM stock_movements WHERE movement_type = 'IN'), o AS (SELECT DISTINCT product_id, warehouse_id FROM stock_movements WHERE movement_type = 'OUT')
    SELECT *, 'in' AS only_in FROM (SELECT * FROM i EXCEPT SELECT * FROM o) UNION ALL SELECT *, 'out' FROM (SELECT * FROM o EXCEPT SELECT * FROM i)""")  # fmt: skip
def one_way_stock(stock_movements: DataFrame) -> DataFrame:
    keys = lambda kind: stock_movements.where(F.col("movement_type") == kind).select("product_id", "warehouse_id")
    return symmetric_difference(keys("IN"), keys("OUT"), ("in", "out"))


@query("b13_distinct", "SELECT DISTINCT warehouse_id, movement_type FROM stock_movements")
def distinct_keys(stock_movements: DataFrame) -> DataFrame:
    return stock_movements.select("warehouse_id", "movement_type").distinct()


@query("b14_all_but", "SELECT * EXCLUDE (unit_cost, reorder_quantity) FROM products")
def all_but(products: DataFrame) -> DataFrame:
    return products.drop("unit_cost", "reorder_quantity")


@query("b15_qualify", "SELECT product_id, warehouse_id, movement_id, created_at FROM stock_movements QUALIFY row_number() OVER (PARTITION BY product_id, warehouse_id ORDER BY created_at DESC, movement_id) = 1")
def latest_movement(stock_movements: DataFrame) -> DataFrame:
    """The latest row of each key: one aggregate with map-side combine instead of a window, as no group is ever sorted."""
    last = F.max_by(F.struct("movement_id", "created_at"), F.struct("created_at", F.expr("-conv(substring(movement_id, 1, 15), 16, 10)"))).alias("m")
    return stock_movements.groupBy("product_id", "warehouse_id").agg(last).select("product_id", "warehouse_id", "m.movement_id", "m.created_at")


STATUS_RANK = (("DRAFT", 0), ("PLACED", 1), ("PARTIALLY_RECEIVED", 2), ("RECEIVED", 3), ("CANCELLED", 9))


@query("b16_values", "SELECT po_id, status, v.rank FROM purchase_orders JOIN (VALUES ('DRAFT', 0), ('PLACED', 1), ('PARTIALLY_RECEIVED', 2), ('RECEIVED', 3), ('CANCELLED', 9)) v(s, rank) ON v.s = status")
def ranked_status(purchase_orders: DataFrame) -> DataFrame:
    ranks = purchase_orders.sparkSession.range(1).select(F.inline(F.array(*[F.struct(F.lit(s).alias("status"), F.lit(r).alias("rank")) for s, r in STATUS_RANK])))
    return purchase_orders.join(F.broadcast(ranks), "status").select("po_id", "status", "rank")


@query("b17_cte", "WITH held AS (SELECT product_id, sum(quantity)::BIGINT AS on_hand FROM stock_levels GROUP BY 1), low AS (SELECT * FROM held WHERE on_hand < 400) SELECT count(*) AS products, min(on_hand) AS least, max(on_hand) AS most FROM low")
def low_summary(stock_levels: DataFrame) -> DataFrame:
    held = stock_levels.groupBy("product_id").agg(F.sum("quantity").alias("on_hand"))
    low = held.where("on_hand < 400")
    return low.agg(F.count("*").alias("products"), F.min("on_hand").alias("least"), F.max("on_hand").alias("most"))


# --- C: joins -------------------------------------------------------------------------------------


@query("c01_inner_join", "SELECT sku, p.name, c.name AS category FROM products p JOIN categories c USING (category_id)")
def with_category(products: DataFrame, categories: DataFrame) -> DataFrame:
    return products.join(categories.select("category_id", F.col("name").alias("category")), "category_id").select("sku", "name", "category")


@query("c02_left_join_counts", "SELECT s.supplier_id, s.name, count(po_id) AS orders FROM suppliers s LEFT JOIN purchase_orders USING (supplier_id) GROUP BY 1, 2")
def orders_per_supplier(suppliers: DataFrame, purchase_orders: DataFrame) -> DataFrame:
    counts = purchase_orders.groupBy("supplier_id").agg(F.count("*").alias("orders"))
    return suppliers.select("supplier_id", "name").join(counts, "supplier_id", "left").fillna(0, ["orders"])


@query("c03_star_join", "SELECT w.code, c.name AS category, sum(quantity)::BIGINT AS units FROM stock_levels JOIN products USING (product_id) JOIN categories c USING (category_id) JOIN warehouses w USING (warehouse_id) GROUP BY 1, 2")
def units_by_warehouse_category(stock_levels: DataFrame, products: DataFrame, categories: DataFrame, warehouses: DataFrame) -> DataFrame:
    """The wide join comes after the aggregate: names are joined to a handful of groups."""
    summed = stock_levels.join(products.select("product_id", "category_id"), "product_id").groupBy("warehouse_id", "category_id").agg(F.sum("quantity").alias("units"))
    return summed.join(warehouses.select("warehouse_id", "code"), "warehouse_id").join(categories.select("category_id", F.col("name").alias("category")), "category_id").select("code", "category", "units")


@query("c04_self_join", "SELECT a.name, b.name AS parent FROM categories a LEFT JOIN categories b ON b.category_id = a.parent_id")
def category_parent(categories: DataFrame) -> DataFrame:
    parents = categories.select(F.col("category_id").alias("parent_id"), F.col("name").alias("parent"))
    return categories.select("name", "parent_id").join(parents, "parent_id", "left").select("name", "parent")


@query("c05_full_join", """SELECT warehouse_id, month, coalesce(i.n, 0)::BIGINT AS receipts, coalesce(o.n, 0)::BIGINT AS shipments FROM
    (SELECT warehouse_id, date_trunc('month', created_at)::DATE AS month, count(*) AS n FROM stock_movements WHERE movement_type = 'IN' GROUP BY 1, 2) i FULL JOIN
    (SELECT warehouse_id, date_trunc('month', created_at)::DATE AS month, count(*) AS n FROM stock_movements WHERE movement_type = 'OUT' GROUP BY 1, 2) o USING (warehouse_id, month)""")  # fmt: skip
def flows_by_month(stock_movements: DataFrame) -> DataFrame:
    def part(kind: str, name: str) -> DataFrame:
        rows = stock_movements.where(F.col("movement_type") == kind)
        return rows.groupBy("warehouse_id", F.trunc("created_at", "month").alias("month")).agg(F.count("*").alias(name))

    return part("IN", "receipts").join(part("OUT", "shipments"), ["warehouse_id", "month"], "full").fillna(0, ["receipts", "shipments"])


@query("c06_chained_full_joins", """SELECT day, warehouse_id, a.n AS ins, b.n AS outs, c.n AS returns FROM
    (SELECT created_at::DATE AS day, warehouse_id, count(*) AS n FROM stock_movements WHERE movement_type = 'IN' GROUP BY 1, 2) a FULL JOIN
    (SELECT created_at::DATE AS day, warehouse_id, count(*) AS n FROM stock_movements WHERE movement_type = 'OUT' GROUP BY 1, 2) b USING (day, warehouse_id) FULL JOIN
    (SELECT created_at::DATE AS day, warehouse_id, count(*) AS n FROM stock_movements WHERE movement_type = 'RETURN' GROUP BY 1, 2) c USING (day, warehouse_id)""")  # fmt: skip
def daily_flows(stock_movements: DataFrame) -> DataFrame:
    part = lambda kind, name: stock_movements.where(F.col("movement_type") == kind).groupBy(F.col("created_at").cast("date").alias("day"), "warehouse_id").agg(F.count("*").alias(name))
    on = ["day", "warehouse_id"]
    return part("IN", "ins").join(part("OUT", "outs"), on, "full").join(part("RETURN", "returns"), on, "full")


@query("c07_semi_join", "SELECT product_id, sku FROM products WHERE product_id IN (SELECT product_id FROM stock_levels WHERE quantity = 0)")
def with_empty_shelf(products: DataFrame, stock_levels: DataFrame) -> DataFrame:
    return products.join(stock_levels.where("quantity = 0").select("product_id"), "product_id", "left_semi").select("product_id", "sku")


@query("c08_anti_join", "SELECT product_id, sku FROM products p WHERE NOT EXISTS (SELECT 1 FROM stock_movements m WHERE m.product_id = p.product_id AND movement_type = 'OUT' AND created_at >= TIMESTAMP '2001-01-01')")
def not_shipped_since(products: DataFrame, stock_movements: DataFrame, since: str = "2001-01-01") -> DataFrame:
    shipped = stock_movements.where((F.col("movement_type") == "OUT") & (F.col("created_at") >= as_of_ts(since))).select("product_id")
    return products.join(shipped, "product_id", "left_anti").select("product_id", "sku")


@query("c09_anti_join_null", "SELECT po_id FROM purchase_orders o LEFT JOIN purchase_order_items i USING (po_id) WHERE i.po_id IS NULL")
def empty_orders(purchase_orders: DataFrame, purchase_order_items: DataFrame) -> DataFrame:
    return purchase_orders.join(purchase_order_items, "po_id", "left_anti").select("po_id")


@query("c10_semi_join_struct", "SELECT movement_id FROM stock_movements WHERE (product_id, warehouse_id) IN (SELECT (product_id, warehouse_id) FROM stock_levels WHERE quantity < 5)")
def movements_of_low_keys(stock_movements: DataFrame, stock_levels: DataFrame) -> DataFrame:
    return stock_movements.join(stock_levels.where("quantity < 5"), ["product_id", "warehouse_id"], "left_semi").select("movement_id")


@query("c11_cross_join", "SELECT c.name AS category, w.code FROM categories c CROSS JOIN warehouses w")
def category_warehouse_grid(categories: DataFrame, warehouses: DataFrame) -> DataFrame:
    """Two tables of fixed, tiny size."""
    return categories.select(F.col("name").alias("category")).crossJoin(F.broadcast(warehouses.select("code")))


@query("c12_cross_join_total", "SELECT warehouse_id, sum(quantity)::BIGINT AS units, sum(quantity)::DOUBLE / (SELECT sum(quantity) FROM stock_levels) AS share FROM stock_levels GROUP BY 1")
def warehouse_share(stock_levels: DataFrame) -> DataFrame:
    per = stock_levels.groupBy("warehouse_id").agg(F.sum("quantity").alias("units"))
    return per.crossJoin(F.broadcast(per.agg(F.sum("units").alias("total")))).select("warehouse_id", "units", (F.col("units").cast("double") / F.col("total")).alias("share"))


@query("c13_range_join", """SELECT cost_date, c.source, session_campaign, cost_usd FROM campaign_costs c JOIN
    (SELECT source, min(event_date) AS a, max(event_date) AS b FROM flat_events GROUP BY 1) v ON v.source = c.source AND cost_date BETWEEN a AND b""")  # fmt: skip
def covered_costs(campaign_costs: DataFrame, flat_events: DataFrame) -> DataFrame:
    span = flat_events.groupBy("source").agg(F.min("event_date").alias("a"), F.max("event_date").alias("b"))
    return campaign_costs.join(F.broadcast(span), "source").where(F.col("cost_date").between(F.col("a"), F.col("b"))).select("cost_date", "source", "session_campaign", "cost_usd")


def look_back(events: DataFrame, earlier: DataFrame, on: list[str], at: str, earlier_at: str, days: int) -> DataFrame:
    """Rows of ``events`` with each row of ``earlier`` of the same keys whose time lies in [at - days, at].

    Time is cut into spans of ``days``, so what a row looks back on lies in its own span or the one before: an equi-join on keys and span.
    A key with a long history is spread over its spans, and rows far apart in time are never paired.
    """
    span = lambda c: F.floor(F.datediff(F.col(c).cast("date"), F.lit("1970-01-01").cast("date")) / max(days, 1)).cast("int")
    asked = events.withColumn("__span", F.explode(F.array(span(at), span(at) - 1)))
    pairs = asked.join(earlier.withColumn("__span", span(earlier_at)), [*on, "__span"]).drop("__span")
    return pairs.where((F.col(earlier_at) <= F.col(at)) & (F.col(earlier_at) >= F.col(at) - F.expr(f"INTERVAL {days} DAYS")))


@query("c14_look_back_join", """SELECT p.event_key, e.event_key AS earlier_key FROM flat_events p JOIN flat_events e ON e.source = p.source AND e.user_pseudo_id = p.user_pseudo_id
    AND e.event_timestamp <= p.event_timestamp AND e.event_timestamp >= p.event_timestamp - INTERVAL 2 DAY WHERE p.event_name = 'purchase' AND e.event_name = 'view_item'""")  # fmt: skip
def views_before_purchases(flat_events: DataFrame, days: int = 2) -> DataFrame:
    bought = flat_events.where("event_name = 'purchase'").select("source", "user_pseudo_id", "event_key", "event_timestamp")
    seen = flat_events.where("event_name = 'view_item'").select("source", "user_pseudo_id", F.col("event_key").alias("earlier_key"), F.col("event_timestamp").alias("seen_at"))
    return look_back(bought, seen, ["source", "user_pseudo_id"], "event_timestamp", "seen_at", days).select("event_key", "earlier_key")


@query("c15_or_join", """SELECT DISTINCT p.event_key, e.event_key AS other_key FROM flat_events p JOIN flat_events e ON e.source = p.source AND e.event_name = 'login'
    AND (e.user_id = p.user_id OR e.session_key = p.session_key) WHERE p.event_name = 'purchase'""")  # fmt: skip
def logins_of_purchases(flat_events: DataFrame) -> DataFrame:
    """An OR between two keys as two equi-joins whose pairs are made distinct; as one join it would compare all rows."""
    bought = flat_events.where("event_name = 'purchase'").select("source", "event_key", "user_id", "session_key")
    logins = flat_events.where("event_name = 'login'").select("source", F.col("event_key").alias("other_key"), "user_id", "session_key")
    by = lambda key: bought.select("source", key, "event_key").join(logins.select("source", key, "other_key"), ["source", key]).select("event_key", "other_key")
    return by("user_id").union(by("session_key")).distinct()


@query("c16_pattern_join", """SELECT event_name, r.label, count(*) AS events FROM flat_events LEFT JOIN (VALUES ('view%', 'look'), ('%checkout', 'buy'), ('purchase', 'buy')) r(pattern, label) ON event_name LIKE r.pattern GROUP BY 1, 2""")
def labelled_events(flat_events: DataFrame) -> DataFrame:
    """A few fixed patterns; the join runs on event names already counted."""
    rules = flat_events.sparkSession.sql("SELECT * FROM VALUES ('view%', 'look'), ('%checkout', 'buy'), ('purchase', 'buy') AS r(pattern, label)")
    counted = flat_events.groupBy("event_name").agg(F.count("*").alias("events"))
    return counted.join(F.broadcast(rules), F.expr("event_name LIKE pattern"), "left").select("event_name", "label", "events")


@query("c17_conditional_lookup", "SELECT event_key, f.source, c.item_name FROM flat_events f LEFT JOIN catalog c ON f.source = 'store_a' AND c.item_id = f.k::VARCHAR WHERE event_name = 'view_item'")
def viewed_item_name(flat_events: DataFrame, catalog: DataFrame) -> DataFrame:
    views = flat_events.where("event_name = 'view_item'").select("event_key", "source", F.col("k").cast("string").alias("item_id"))
    return views.join(catalog.select(F.col("item_id").alias("cid"), "item_name"), (F.col("source") == "store_a") & (F.col("cid") == F.col("item_id")), "left").select("event_key", "source", "item_name")


@query("c18_unnest", "SELECT event_key, unnest(generate_series(0, item_count - 1))::INT AS item_index FROM flat_events WHERE item_count > 0")
def unnested(flat_events: DataFrame) -> DataFrame:
    return flat_events.select("event_key", F.posexplode("items").alias("item_index", "item")).drop("item")


@query("c19_update_from", "SELECT s.product_id, s.warehouse_id, s.quantity, coalesce(p.reorder_point, 0)::INT AS reorder_point FROM stock_levels s LEFT JOIN products p ON p.product_id = s.product_id AND p.is_active")
def with_reorder_point(stock_levels: DataFrame, products: DataFrame) -> DataFrame:
    points = products.where("is_active").select("product_id", "reorder_point")
    return stock_levels.join(points, "product_id", "left").select("product_id", "warehouse_id", "quantity", F.coalesce("reorder_point", F.lit(0)).alias("reorder_point"))


def pair_selectivity(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """Shares of rows where a, b, and both hold, and the share of both if they were independent: one pass."""
    n, na, nb, nab = (F.col(c) for c in ("n", "na", "nb", "nab"))
    counts = df.agg(F.count("*").alias("n"), F.count_if(a).alias("na"), F.count_if(b).alias("nb"), F.count_if(a & b).alias("nab"))
    share = lambda x: F.try_divide(x.cast("double"), n)
    return counts.select("n", share(na).alias("share_a"), share(nb).alias("share_b"), share(nab).alias("share_both"), (share(na) * share(nb)).alias("expected_both"))


@query("c20_pair_selectivity", """SELECT count(*) AS n, avg((movement_type = 'OUT')::INT) AS share_a, avg((warehouse_id = 2)::INT) AS share_b, avg((movement_type = 'OUT' AND warehouse_id = 2)::INT) AS share_both,
    avg((movement_type = 'OUT')::INT) * avg((warehouse_id = 2)::INT) AS expected_both FROM stock_movements""")  # fmt: skip
def out_of_two(stock_movements: DataFrame) -> DataFrame:
    return pair_selectivity(stock_movements, F.col("movement_type") == "OUT", F.col("warehouse_id") == 2)


# --- D: aggregates --------------------------------------------------------------------------------


@query("d01_global_aggregates", "SELECT count(*) AS n, avg(unit_price)::DOUBLE AS mean_price, min(unit_price) AS least, max(unit_price) AS most FROM products")
def price_summary(products: DataFrame) -> DataFrame:
    return products.agg(F.count("*").alias("n"), F.avg(F.col("unit_price").cast("double")).alias("mean_price"), F.min("unit_price").alias("least"), F.max("unit_price").alias("most"))


@query("d02_having", "SELECT product_id, count(*) AS movements FROM stock_movements GROUP BY 1 HAVING count(*) > 40")
def busy_products(stock_movements: DataFrame) -> DataFrame:
    return stock_movements.groupBy("product_id").agg(F.count("*").alias("movements")).where("movements > 40")


@query("d03_sum_of_products", "SELECT warehouse_id, sum(quantity * unit_cost)::DECIMAL(18,2) AS value FROM stock_levels JOIN products USING (product_id) GROUP BY 1")
def stock_value(stock_levels: DataFrame, products: DataFrame) -> DataFrame:
    return stock_levels.join(products.select("product_id", "unit_cost"), "product_id").groupBy("warehouse_id").agg(F.sum(F.col("quantity") * F.col("unit_cost")).cast(QTY).alias("value"))


@query("d04_count_distinct", "SELECT movement_type, count(DISTINCT product_id) AS products FROM stock_movements GROUP BY 1")
def distinct_products(stock_movements: DataFrame, approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct if approximate else F.count_distinct
    return stock_movements.groupBy("movement_type").agg(count("product_id").alias("products"))


@query("d05_conditional_count", "SELECT warehouse_id, count(*) FILTER (movement_type = 'IN') AS receipts, count(*) FILTER (movement_type = 'OUT') AS shipments FROM stock_movements GROUP BY 1")
def flow_counts(stock_movements: DataFrame) -> DataFrame:
    return stock_movements.groupBy("warehouse_id").agg(F.count_if(F.col("movement_type") == "IN").alias("receipts"), F.count_if(F.col("movement_type") == "OUT").alias("shipments"))


@query("d06_conditional_sum", "SELECT product_id, sum(CASE WHEN movement_type = 'IN' THEN quantity ELSE 0 END)::BIGINT AS received FROM stock_movements GROUP BY 1")
def received_units(stock_movements: DataFrame) -> DataFrame:
    return stock_movements.groupBy("product_id").agg(F.sum(F.when(F.col("movement_type") == "IN", F.col("quantity")).otherwise(0)).alias("received"))


@query("d07_having_signed", "SELECT product_id, sum(CASE WHEN movement_type = 'IN' THEN quantity WHEN movement_type = 'OUT' THEN -quantity ELSE 0 END)::BIGINT AS net FROM stock_movements GROUP BY 1 HAVING sum(CASE WHEN movement_type = 'IN' THEN quantity WHEN movement_type = 'OUT' THEN -quantity ELSE 0 END) < 0")
def net_drained(stock_movements: DataFrame) -> DataFrame:
    signed = F.when(F.col("movement_type") == "IN", F.col("quantity")).when(F.col("movement_type") == "OUT", -F.col("quantity")).otherwise(0)
    return stock_movements.groupBy("product_id").agg(F.sum(signed).alias("net")).where("net < 0")


@query("d08_logical_aggregates", "SELECT category_id, bool_or(is_active) AS any_active, bool_and(is_active) AS all_active FROM products GROUP BY 1")
def active_flags(products: DataFrame) -> DataFrame:
    return products.groupBy("category_id").agg(F.bool_or("is_active").alias("any_active"), F.bool_and("is_active").alias("all_active"))


@query("d09_first_by_order", "SELECT source, arg_min(event_name, (event_timestamp, event_key)) AS first_event FROM flat_events GROUP BY 1")
def first_event(flat_events: DataFrame) -> DataFrame:
    return flat_events.groupBy("source").agg(F.min_by("event_name", F.struct("event_timestamp", "event_key")).alias("first_event"))


@query("d10_first_non_null", "SELECT user_pseudo_id, arg_min(user_id, (event_timestamp, event_key)) FILTER (user_id IS NOT NULL) AS first_account FROM flat_events WHERE user_pseudo_id IS NOT NULL GROUP BY 1")
def first_account(flat_events: DataFrame) -> DataFrame:
    order = F.when(F.col("user_id").isNotNull(), F.struct("event_timestamp", "event_key"))
    return flat_events.where("user_pseudo_id IS NOT NULL").groupBy("user_pseudo_id").agg(F.min_by("user_id", order).alias("first_account"))


@query("d11_last_non_null", "SELECT user_pseudo_id, arg_max(collected_source, (event_timestamp, event_key)) FILTER (collected_source IS NOT NULL) AS last_source FROM flat_events WHERE user_pseudo_id IS NOT NULL GROUP BY 1")
def last_source(flat_events: DataFrame) -> DataFrame:
    order = F.when(F.col("collected_source").isNotNull(), F.struct("event_timestamp", "event_key"))
    return flat_events.where("user_pseudo_id IS NOT NULL").groupBy("user_pseudo_id").agg(F.max_by("collected_source", order).alias("last_source"))


@query("d12_distinct_sorted_array", "SELECT source, user_pseudo_id, coalesce(array_to_string(list_sort(list_distinct(list(user_id) FILTER (user_id IS NOT NULL))), ','), '') AS accounts FROM flat_events WHERE user_pseudo_id IS NOT NULL GROUP BY 1, 2")
def accounts_of_devices(flat_events: DataFrame) -> DataFrame:
    """Distinct and sorted, nulls left out, and empty rather than null; written out as text."""
    return flat_events.where("user_pseudo_id IS NOT NULL").groupBy("source", "user_pseudo_id").agg(F.array_join(F.array_sort(F.collect_set("user_id")), ",").alias("accounts"))


@query("d13_array_concat", "SELECT source, array_to_string(list_sort(list(DISTINCT ga_session_id)), ',') AS days FROM flat_events WHERE user_pseudo_id IS NOT NULL GROUP BY 1")
def session_days(flat_events: DataFrame) -> DataFrame:
    """Arrays of each day are concatenated and made distinct: partial results can be added up."""
    daily = flat_events.where("user_pseudo_id IS NOT NULL").groupBy("source", "event_date").agg(F.array_sort(F.collect_set("ga_session_id")).alias("ids"))
    merged = daily.groupBy("source").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("ids"))
    return merged.select("source", F.array_join(F.col("ids").cast("array<string>"), ",").alias("days"))


@query("d14_conditional_min", "SELECT user_pseudo_id, min(event_timestamp) FILTER (user_id IS NOT NULL) AS first_signed_in_at FROM flat_events WHERE user_pseudo_id IS NOT NULL GROUP BY 1")
def first_signed_in(flat_events: DataFrame) -> DataFrame:
    return flat_events.where("user_pseudo_id IS NOT NULL").groupBy("user_pseudo_id").agg(F.min(F.when(F.col("user_id").isNotNull(), F.col("event_timestamp"))).alias("first_signed_in_at"))


@query("d15_any_value", "SELECT session_key, any_value(source) AS source FROM flat_events WHERE session_key IS NOT NULL GROUP BY 1")
def session_source_store(flat_events: DataFrame) -> DataFrame:
    """Of a column that is the same throughout a group."""
    return flat_events.where("session_key IS NOT NULL").groupBy("session_key").agg(F.any_value("source").alias("source"))


def exact_sum(value: Column, scale: int = 18) -> Column:
    """A money sum that doesn't depend on the order of the rows: summed as decimals, given as double."""
    return F.sum(value.cast(f"decimal(38,{scale})")).cast("double")


@query("d16_exact_sum", "SELECT event_date, CAST(sum(CAST(purchase_revenue_usd AS DECIMAL(38,9))) AS DOUBLE) AS revenue_usd FROM flat_events WHERE event_name = 'purchase' GROUP BY 1")
def daily_revenue(flat_events: DataFrame) -> DataFrame:
    return flat_events.where("event_name = 'purchase'").groupBy("event_date").agg(exact_sum(F.col("purchase_revenue_usd"), 9).alias("revenue_usd"))


@query("d17_ordered_hash", """WITH r AS (SELECT warehouse_id, product_id // 1000 AS range, md5(string_agg(product_id || ':' || quantity, ',' ORDER BY product_id)) AS hash FROM stock_levels GROUP BY 1, 2)
    SELECT warehouse_id, md5(string_agg(hash, ',' ORDER BY range)) AS hash FROM r GROUP BY 1""")  # fmt: skip
def stock_hash(stock_levels: DataFrame, keys: int = 1_000) -> DataFrame:
    """A hash of each warehouse's stock in the order of its keys: ranges of ``keys`` keys are hashed in order, then the ranges' hashes, so that no group holds more than a range or the list of the ranges."""
    pair = F.struct("product_id", F.concat_ws(":", "product_id", "quantity").alias("pair"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(pair)), lambda x: x["pair"]), ",")
    ranges = stock_levels.groupBy("warehouse_id", F.floor(F.col("product_id") / keys).alias("range")).agg(F.md5(text).alias("hash"))
    hashes = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("range", "hash"))), lambda x: x["hash"]), ",")
    return ranges.groupBy("warehouse_id").agg(F.md5(hashes).alias("hash"))


@query("d18_day_rollup", "SELECT created_at::DATE AS day, movement_type, count(*) AS movements, sum(quantity)::BIGINT AS quantity FROM stock_movements GROUP BY 1, 2")
def daily_rollup(stock_movements: DataFrame) -> DataFrame:
    return stock_movements.groupBy(F.col("created_at").cast("date").alias("day"), "movement_type").agg(F.count("*").alias("movements"), F.sum("quantity").alias("quantity"))


@query("d19_type_profile", "SELECT movement_type, count(*) AS movements, sum(quantity)::BIGINT AS quantity, min(created_at) AS first_at, max(created_at) AS last_at FROM stock_movements GROUP BY 1")
def type_profile(stock_movements: DataFrame) -> DataFrame:
    return stock_movements.groupBy("movement_type").agg(F.count("*").alias("movements"), F.sum("quantity").alias("quantity"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"))


@query("d20_two_level", "SELECT user_pseudo_id, count(DISTINCT event_date) AS days, count(*) AS events, max(n) AS busiest FROM (SELECT *, count(*) OVER (PARTITION BY user_pseudo_id, event_date) AS n FROM flat_events WHERE user_pseudo_id IS NOT NULL) GROUP BY 1")
def device_profile(flat_events: DataFrame) -> DataFrame:
    days = flat_events.where("user_pseudo_id IS NOT NULL").groupBy("user_pseudo_id", "event_date").agg(F.count("*").alias("n"))
    return days.groupBy("user_pseudo_id").agg(F.count("*").alias("days"), F.sum("n").alias("events"), F.max("n").alias("busiest"))


def fingerprint(df: DataFrame) -> DataFrame:
    """A table's multiset fingerprint (rows, xor, total): equal for equal rows in any order; one pass, nothing sorted."""
    h = F.conv(F.substring(F.md5(F.concat_ws("|", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("~")) for c in sorted(df.columns)])), 1, 15), 16, 10).cast("long")
    return df.select(h.alias("h")).agg(F.count("*").alias("rows"), F.bit_xor("h").alias("xor"), F.sum(F.col("h").cast("decimal(38,0)")).cast("string").alias("total"))


@query("d21_fingerprint", "SELECT count(*) AS rows, bit_xor(h) AS xor, sum(h::HUGEINT)::VARCHAR AS total FROM (SELECT ('0x' || substr(md5(concat_ws('|', product_id, quantity, warehouse_id)), 1, 15))::BIGINT AS h FROM stock_levels)")
def stock_fingerprint(stock_levels: DataFrame) -> DataFrame:
    return fingerprint(stock_levels)


@query("d22_array_exists", "SELECT event_key, item_count >= 2 AS has_unnamed FROM flat_events WHERE event_name = 'purchase'")
def has_unnamed_item(flat_events: DataFrame) -> DataFrame:
    return flat_events.where("event_name = 'purchase'").select("event_key", F.exists("items", lambda i: i["item_name"] == "(not set)").alias("has_unnamed"))


@query("d23_array_sum", "SELECT event_key, (item_count * (1 + k % 4))::BIGINT AS units FROM flat_events WHERE event_name = 'purchase'")
def units_of_event(flat_events: DataFrame) -> DataFrame:
    return flat_events.where("event_name = 'purchase'").select("event_key", F.aggregate("items", F.lit(0).cast("long"), lambda n, i: n + i["quantity"]).alias("units"))


@query("d24_rates_from_sums", "SELECT source, round(sum(CASE WHEN event_name = 'purchase' THEN 1.0 ELSE 0 END)::DOUBLE / nullif(sum(CASE WHEN event_name = 'add_to_cart' THEN 1 ELSE 0 END), 0), 6) AS buy_rate FROM flat_events GROUP BY 1")
def buy_rate(flat_events: DataFrame) -> DataFrame:
    """A rate of sums, never a mean of daily rates."""
    daily = flat_events.groupBy("source", "event_date").agg(F.count_if(F.col("event_name") == "purchase").alias("buys"), F.count_if(F.col("event_name") == "add_to_cart").alias("carts"))
    return daily.groupBy("source").agg(F.round(F.try_divide(F.sum("buys").cast("double"), F.sum("carts")), 6).alias("buy_rate"))


# --- E: windows -----------------------------------------------------------------------------------


@query("e01_rank_of_aggregate", "SELECT category_id, product_id, on_hand, rank() OVER (PARTITION BY category_id ORDER BY on_hand DESC)::INT AS rank FROM (SELECT category_id, product_id, sum(quantity)::BIGINT AS on_hand FROM stock_levels JOIN products USING (product_id) GROUP BY 1, 2)")
def rank_in_category(stock_levels: DataFrame, products: DataFrame) -> DataFrame:
    held = stock_levels.groupBy("product_id").agg(F.sum("quantity").alias("on_hand")).join(products.select("product_id", "category_id"), "product_id")
    return held.select("category_id", "product_id", "on_hand", F.rank().over(Window.partitionBy("category_id").orderBy(F.desc("on_hand"))).alias("rank"))


@query("e02_rank_all", "SELECT warehouse_id, units, rank() OVER (ORDER BY units DESC)::INT AS rank FROM (SELECT warehouse_id, sum(quantity)::BIGINT AS units FROM stock_levels GROUP BY 1)")
def rank_warehouses(stock_levels: DataFrame) -> DataFrame:
    """Over all rows, but only after the aggregate: there is a row for each warehouse."""
    return stock_levels.groupBy("warehouse_id").agg(F.sum("quantity").alias("units")).withColumn("rank", F.rank().over(Window.orderBy(F.desc("units"))))


@query("e03_share_of_total", "SELECT category_id, units, round(100.0 * units / sum(units) OVER (), 2)::DOUBLE AS percent FROM (SELECT category_id, sum(quantity)::BIGINT AS units FROM stock_levels JOIN products USING (product_id) GROUP BY 1)")
def share_of_total(stock_levels: DataFrame, products: DataFrame) -> DataFrame:
    per = stock_levels.join(products.select("product_id", "category_id"), "product_id").groupBy("category_id").agg(F.sum("quantity").alias("units"))
    total = F.broadcast(per.agg(F.sum("units").alias("total")))
    return per.crossJoin(total).select("category_id", "units", F.round(100.0 * F.col("units") / F.col("total"), 2).alias("percent"))


@query("e04_top_n_per_group", "SELECT warehouse_id, product_id, units FROM (SELECT warehouse_id, product_id, sum(quantity)::BIGINT AS units FROM stock_movements WHERE movement_type = 'OUT' GROUP BY 1, 2) QUALIFY rank() OVER (PARTITION BY warehouse_id ORDER BY units DESC) <= 10")
def top_shipped(stock_movements: DataFrame, n: int = 10) -> DataFrame:
    units = stock_movements.where("movement_type = 'OUT'").groupBy("warehouse_id", "product_id").agg(F.sum("quantity").alias("units"))
    return units.withColumn("r", F.rank().over(Window.partitionBy("warehouse_id").orderBy(F.desc("units")))).where(F.col("r") <= n).drop("r")


@query("e05_row_number_top", "SELECT source, collected_source, collected_medium, events FROM (SELECT source, collected_source, collected_medium, count(*) AS events FROM flat_events WHERE collected_source IS NOT NULL GROUP BY 1, 2, 3) QUALIFY row_number() OVER (PARTITION BY source ORDER BY events DESC, collected_source, collected_medium) <= 3")
def top_sources(flat_events: DataFrame, n: int = 3) -> DataFrame:
    counts = flat_events.where("collected_source IS NOT NULL").groupBy("source", "collected_source", "collected_medium").agg(F.count("*").alias("events"))
    return counts.withColumn("r", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("events"), "collected_source", "collected_medium"))).where(F.col("r") <= n).drop("r")


@query("e06_dedupe", "SELECT event_id FROM events")
def deduped_ids(web_export: DataFrame) -> DataFrame:
    """Exact copies of an exported row are one event."""
    return web_export.select("source", "event_id", "event_timestamp").dropDuplicates().select("event_id")


@query("e07_multiplicity", "SELECT event_id, CASE WHEN event_id % 50 = 0 THEN 2 ELSE 1 END::BIGINT AS copies FROM events")
def multiplicity(web_export: DataFrame) -> DataFrame:
    return web_export.groupBy("event_id").agg(F.count("*").alias("copies"))


@query("e08_min_max_over", "SELECT event_key, min(coalesce(user_pseudo_id, '')) OVER w <> max(coalesce(user_pseudo_id, '')) OVER w AS collides FROM flat_events WHERE transaction_id IS NOT NULL WINDOW w AS (PARTITION BY source, transaction_id)")
def transaction_collides(flat_events: DataFrame) -> DataFrame:
    w, device = Window.partitionBy("source", "transaction_id"), F.coalesce("user_pseudo_id", F.lit(""))
    return flat_events.where("transaction_id IS NOT NULL").select("event_key", (F.min(device).over(w) != F.max(device).over(w)).alias("collides"))


@query("e09_conditional_min_over", "SELECT event_key, min(CASE WHEN event_name = 'page_view' THEN event_timestamp END) OVER (PARTITION BY session_key) AS landing_at FROM flat_events WHERE session_key IS NOT NULL")
def landing_time(flat_events: DataFrame) -> DataFrame:
    landing = F.min(F.when(F.col("event_name") == "page_view", F.col("event_timestamp"))).over(Window.partitionBy("session_key"))
    return flat_events.where("session_key IS NOT NULL").select("event_key", landing.alias("landing_at"))


@query("e10_conditional_max_over", "SELECT event_key, max(CASE WHEN collected_source <> '(direct)' THEN event_timestamp END) OVER (PARTITION BY session_key) AS last_sourced_at FROM flat_events WHERE session_key IS NOT NULL")
def last_sourced(flat_events: DataFrame) -> DataFrame:
    last = F.max(F.when(F.col("collected_source") != "(direct)", F.col("event_timestamp"))).over(Window.partitionBy("session_key"))
    return flat_events.where("session_key IS NOT NULL").select("event_key", last.alias("last_sourced_at"))


@query("e11_position", "SELECT event_key, row_number() OVER (PARTITION BY session_key ORDER BY event_timestamp, event_name, event_key)::INT AS position FROM flat_events WHERE session_key IS NOT NULL")
def position_in_session(flat_events: DataFrame) -> DataFrame:
    w = Window.partitionBy("session_key").orderBy("event_timestamp", "event_name", "event_key")
    return flat_events.where("session_key IS NOT NULL").select("event_key", F.row_number().over(w).alias("position"))


@query("e12_normalised_weight", "SELECT movement_id, quantity::DOUBLE / sum(quantity) OVER (PARTITION BY product_id, warehouse_id) AS weight FROM stock_movements")
def weight_in_key(stock_movements: DataFrame) -> DataFrame:
    return stock_movements.select("movement_id", (F.col("quantity").cast("double") / F.sum("quantity").over(Window.partitionBy("product_id", "warehouse_id"))).alias("weight"))


@query("e13_first_value", "SELECT warehouse_id, month, n, round(n::DOUBLE / first_value(n) OVER (PARTITION BY warehouse_id ORDER BY month), 4) AS ratio FROM (SELECT warehouse_id, date_trunc('month', created_at)::DATE AS month, count(*) AS n FROM stock_movements GROUP BY 1, 2)")
def ratio_to_first_month(stock_movements: DataFrame) -> DataFrame:
    monthly = stock_movements.groupBy("warehouse_id", F.trunc("created_at", "month").alias("month")).agg(F.count("*").alias("n"))
    first = F.first("n").over(Window.partitionBy("warehouse_id").orderBy("month"))
    return monthly.select("warehouse_id", "month", "n", F.round(F.col("n").cast("double") / first, 4).alias("ratio"))


def ranked_over_all(df: DataFrame, order: str, name: str) -> DataFrame:
    """Row numbers over a whole table without one task for all rows: rows are range-partitioned, and each partition's numbers begin where those before it end."""
    by_range = df.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), order)
    placed = kept(by_range.sortWithinPartitions(order).withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id()))  # read twice: ranges are sampled anew in each run
    counts = placed.groupBy("__p").agg(F.count("*").alias("__n"), F.min("__i").alias("__first"))
    before = counts.select(F.col("__p"), "__first", (F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")).alias("__before"))
    return placed.join(F.broadcast(before), "__p").withColumn(name, F.col("__i") - F.col("__first") + F.col("__before") + 1).drop("__p", "__i", "__first", "__before")


@query("e14_hash_rank", "SELECT product_id, row_number() OVER (ORDER BY md5(product_id::VARCHAR)) AS popularity FROM products")
def popularity(products: DataFrame) -> DataFrame:
    """A fixed random rank: by the hash of the key."""
    hashed = products.select("product_id", F.md5(F.col("product_id").cast("string")).alias("h"))
    return ranked_over_all(hashed, "h", "popularity").select("product_id", "popularity")


@query("e15_concentration", """WITH n AS (SELECT product_id, count(*) AS c FROM stock_movements GROUP BY 1), h AS (SELECT c, count(*) AS keys FROM n GROUP BY 1),
    o AS (SELECT c, keys, sum(keys) OVER (ORDER BY c DESC) - keys AS before, ceil((SELECT count(*) FROM n) * 0.05) AS top FROM h)
    SELECT max(top)::BIGINT AS top_keys, round(sum(c * greatest(least(keys, top - before), 0))::DOUBLE / (SELECT count(*) FROM stock_movements), 6) AS share FROM o""")  # fmt: skip
def concentration(stock_movements: DataFrame, top: float = 0.05) -> DataFrame:
    """What share of the rows the most frequent keys hold. Keys are counted by how many rows they have, so the ordered window runs over distinct counts, not over keys."""
    keys = stock_movements.groupBy("product_id").agg(F.count("*").alias("c"))
    histogram = keys.groupBy("c").agg(F.count("*").alias("keys"))
    totals = F.broadcast(histogram.agg(F.sum("keys").alias("all_keys"), F.sum(F.col("keys") * F.col("c")).alias("all_rows")))
    ranked = histogram.withColumn("before", F.sum("keys").over(Window.orderBy(F.desc("c"))) - F.col("keys")).crossJoin(totals).withColumn("top", F.ceil(F.col("all_keys") * top))
    taken = F.greatest(F.least("keys", F.col("top") - F.col("before")), F.lit(0))
    return ranked.agg(F.max("top").alias("top_keys"), F.round(F.sum(F.col("c") * taken).cast("double") / F.max("all_rows"), 6).alias("share"))


@query("e16_trailing_history", "SELECT warehouse_id, day, n, count(*) OVER w AS history_days, coalesce(sum(n) OVER w, 0)::BIGINT AS history FROM (SELECT warehouse_id, created_at::DATE AS day, count(*) AS n FROM stock_movements GROUP BY 1, 2) WINDOW w AS (PARTITION BY warehouse_id ORDER BY day RANGE BETWEEN INTERVAL 21 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING)")
def trailing_history(stock_movements: DataFrame, days: int = 21) -> DataFrame:
    daily = stock_movements.groupBy("warehouse_id", F.col("created_at").cast("date").alias("day")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("warehouse_id").orderBy(F.unix_date("day")).rangeBetween(-days, -1)
    return daily.select("warehouse_id", "day", "n", F.count("n").over(w).alias("history_days"), F.coalesce(F.sum("n").over(w), F.lit(0)).alias("history"))
