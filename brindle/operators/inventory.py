"""Inventory reports: stock, purchase orders, valuation, movers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.operators.relational import QTY, as_of_ts
from brindle.registry import query, table, whole_table
from brindle.sources.domain import AS_OF


def _value(price: str) -> Column:
    return F.sum(F.col("quantity") * F.col(price)).cast(QTY)


@table("""SELECT s.product_id, sku, p.name AS product, c.name AS category, w.warehouse_id, w.code, quantity, reorder_point, reorder_quantity FROM stock_levels s JOIN products p USING (product_id) JOIN categories c USING (category_id) JOIN warehouses w USING (warehouse_id)""")
def current_stock(stock_levels: DataFrame, products: DataFrame, categories: DataFrame, warehouses: DataFrame) -> DataFrame:
    named = stock_levels.join(products.select("product_id", "sku", F.col("name").alias("product"), "category_id", "reorder_point", "reorder_quantity"), "product_id")
    named = named.join(F.broadcast(categories.select("category_id", F.col("name").alias("category"))), "category_id").join(F.broadcast(warehouses.select("warehouse_id", "code")), "warehouse_id")
    return named.select("product_id", "sku", "product", "category", "warehouse_id", "code", "quantity", "reorder_point", "reorder_quantity")


whole_table("f01_current_stock", "current_stock")


@query("f02_low_stock_items", "SELECT sku, code, quantity, reorder_point, reorder_point - quantity AS deficit, greatest(reorder_quantity, reorder_point - quantity)::INT AS suggested_order_qty FROM current_stock WHERE quantity < reorder_point")
def low_stock_items(current_stock: DataFrame) -> DataFrame:
    deficit = F.col("reorder_point") - F.col("quantity")
    return current_stock.where("quantity < reorder_point").select("sku", "code", "quantity", "reorder_point", deficit.alias("deficit"), F.greatest("reorder_quantity", deficit).alias("suggested_order_qty"))


@table("""SELECT po_id, supplier_id, status, order_date, expected_date, count(product_id) AS lines, coalesce(sum(quantity_ordered), 0)::BIGINT AS ordered, coalesce(sum(quantity_received), 0)::BIGINT AS received, coalesce(sum(quantity_ordered * unit_cost), 0)::DECIMAL(18,2) AS value
    FROM purchase_orders LEFT JOIN purchase_order_items USING (po_id) GROUP BY 1, 2, 3, 4, 5""")  # fmt: skip
def purchase_order_summary(purchase_orders: DataFrame, purchase_order_items: DataFrame) -> DataFrame:
    """Orders with the sums of their lines, aggregated before the join; orders without lines stay."""
    sums = purchase_order_items.groupBy("po_id").agg(F.count("*").alias("lines"), F.sum("quantity_ordered").alias("ordered"), F.sum("quantity_received").alias("received"), F.sum(F.col("quantity_ordered") * F.col("unit_cost")).alias("value"))
    zero = lambda c, kind: F.coalesce(F.col(c), F.lit(0)).cast(kind).alias(c)
    return purchase_orders.join(sums, "po_id", "left").select("po_id", "supplier_id", "status", "order_date", "expected_date", zero("lines", "long"), zero("ordered", "long"), zero("received", "long"), zero("value", QTY))


whole_table("f03_purchase_order_summary", "purchase_order_summary")


@table("SELECT w.warehouse_id, w.code, sum(quantity)::BIGINT AS units, sum(quantity * unit_cost)::DECIMAL(18,2) AS cost_value, sum(quantity * unit_price)::DECIMAL(18,2) AS retail_value FROM warehouses w LEFT JOIN stock_levels USING (warehouse_id) LEFT JOIN products USING (product_id) GROUP BY 1, 2")
def stock_valuation(warehouses: DataFrame, stock_levels: DataFrame, products: DataFrame) -> DataFrame:
    sums = stock_levels.join(products.select("product_id", "unit_cost", "unit_price"), "product_id", "left").groupBy("warehouse_id").agg(F.sum("quantity").alias("units"), _value("unit_cost").alias("cost_value"), _value("unit_price").alias("retail_value"))
    return warehouses.select("warehouse_id", "code").join(sums, "warehouse_id", "left")


whole_table("f04_stock_valuation", "stock_valuation")


@table(f"""SELECT movement_id, created_at, movement_type, m.quantity, sku, code FROM stock_movements m JOIN products USING (product_id) JOIN warehouses USING (warehouse_id)
    WHERE created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY AND created_at <= TIMESTAMP '{AS_OF}'""")  # fmt: skip
def recent_movements(stock_movements: DataFrame, products: DataFrame, warehouses: DataFrame, days: int = 30, as_of: str = AS_OF) -> DataFrame:
    now = as_of_ts(as_of)
    recent = stock_movements.where((F.col("created_at") >= now - F.expr(f"INTERVAL {days} DAYS")) & (F.col("created_at") <= now))
    return recent.join(products.select("product_id", "sku"), "product_id").join(F.broadcast(warehouses.select("warehouse_id", "code")), "warehouse_id").select("movement_id", "created_at", "movement_type", "quantity", "sku", "code")


whole_table("f05_recent_movements", "recent_movements")


@query("f06_below_reorder_anywhere", "SELECT product_id, sku FROM products p WHERE product_id IN (SELECT product_id FROM stock_levels s WHERE s.quantity < p.reorder_point)")
def below_reorder_anywhere(products: DataFrame, stock_levels: DataFrame) -> DataFrame:
    low = stock_levels.alias("s")
    return products.alias("p").join(low, (F.col("p.product_id") == F.col("s.product_id")) & (F.col("s.quantity") < F.col("p.reorder_point")), "left_semi").select("product_id", "sku")


@query("f07_low_stock_listing", "SELECT sku, product, code, quantity, reorder_point FROM current_stock WHERE quantity < reorder_point")
def low_stock_listing(current_stock: DataFrame) -> DataFrame:
    return current_stock.where("quantity < reorder_point").select("sku", "product", "code", "quantity", "reorder_point")


@query("f08_stock_health", "SELECT p.product_id, sum(quantity)::BIGINT AS on_hand, CASE WHEN sum(quantity) = 0 THEN 'OUT_OF_STOCK' WHEN sum(quantity) < p.reorder_point THEN 'LOW' WHEN sum(quantity) < p.reorder_point * 10 THEN 'OK' ELSE 'HEALTHY' END AS health FROM products p LEFT JOIN stock_levels USING (product_id) GROUP BY p.product_id, p.reorder_point")
def stock_health(products: DataFrame, stock_levels: DataFrame, ok_below: int = 10) -> DataFrame:
    """A bucket for each product. A product that no warehouse holds has no sum, which no comparison holds for, and so counts as HEALTHY."""
    held = stock_levels.groupBy("product_id").agg(F.sum("quantity").alias("on_hand"))
    n, point = F.col("on_hand"), F.col("reorder_point")
    health = F.when(n == 0, "OUT_OF_STOCK").when(n < point, "LOW").when(n < point * ok_below, "OK").otherwise("HEALTHY")
    return products.select("product_id", "reorder_point").join(held, "product_id", "left").select("product_id", "on_hand", health.alias("health"))


@query("f09_rank_on_hand", "SELECT category, sku, on_hand, rank() OVER (PARTITION BY category ORDER BY on_hand DESC)::INT AS rank FROM items")
def rank_on_hand(items: DataFrame) -> DataFrame:
    return items.select("category", "sku", "on_hand", F.rank().over(Window.partitionBy("category").orderBy(F.desc("on_hand"))).alias("rank"))


@query("f10_supplier_receipts", f"SELECT s.supplier_id, s.name, count(*) AS receipts, sum(quantity)::BIGINT AS units FROM stock_movements m JOIN suppliers s ON s.supplier_id = m.reference_id WHERE movement_type = 'IN' AND created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 90 DAY AND created_at <= TIMESTAMP '{AS_OF}' GROUP BY 1, 2")
def supplier_receipts(stock_movements: DataFrame, suppliers: DataFrame, days: int = 90, as_of: str = AS_OF) -> DataFrame:
    now = as_of_ts(as_of)
    recent = stock_movements.where((F.col("movement_type") == "IN") & (F.col("created_at") >= now - F.expr(f"INTERVAL {days} DAYS")) & (F.col("created_at") <= now))
    sums = recent.groupBy(F.col("reference_id").alias("supplier_id")).agg(F.count("*").alias("receipts"), F.sum("quantity").alias("units"))
    return sums.join(suppliers.select("supplier_id", "name"), "supplier_id").select("supplier_id", "name", "receipts", "units")


@query("f11_receipt_shipment_feed", "SELECT movement_id, created_at, 'receipt' AS kind, quantity FROM stock_movements WHERE movement_type IN ('IN', 'TRANSFER_IN') UNION ALL SELECT movement_id, created_at, 'shipment', -quantity FROM stock_movements WHERE movement_type IN ('OUT', 'TRANSFER_OUT')")
def receipt_shipment_feed(stock_movements: DataFrame) -> DataFrame:
    part = lambda kinds, name, sign: stock_movements.where(F.col("movement_type").isin(*kinds)).select("movement_id", "created_at", F.lit(name).alias("kind"), (F.col("quantity") * sign).alias("quantity"))
    return part(("IN", "TRANSFER_IN"), "receipt", 1).unionByName(part(("OUT", "TRANSFER_OUT"), "shipment", -1))


@query("f12_warehouse_value_rank", "SELECT code, cost_value, rank() OVER (ORDER BY cost_value DESC)::INT AS rank, round(100.0 * cost_value::DOUBLE / sum(cost_value::DOUBLE) OVER (), 2) AS percent FROM stock_valuation")
def warehouse_value_rank(stock_valuation: DataFrame) -> DataFrame:
    """Ranks and shares over the few warehouses."""
    everything = Window.partitionBy()
    return stock_valuation.select("code", "cost_value", F.rank().over(Window.orderBy(F.desc("cost_value"))).alias("rank"), F.round(100.0 * F.col("cost_value").cast("double") / F.sum(F.col("cost_value").cast("double")).over(everything), 2).alias("percent"))


@query("f13_never_shipped", "SELECT product_id, sku FROM products p WHERE NOT EXISTS (SELECT 1 FROM stock_movements m WHERE m.product_id = p.product_id AND m.movement_type = 'OUT' AND m.warehouse_id = 1)")
def never_shipped_from_first(products: DataFrame, stock_movements: DataFrame) -> DataFrame:
    return products.join(stock_movements.where("movement_type = 'OUT' AND warehouse_id = 1"), "product_id", "left_anti").select("product_id", "sku")


@query("f14_po_fulfilment", "SELECT po_id, round(100.0 * received::DOUBLE / nullif(ordered, 0), 1) AS percent FROM purchase_order_summary")
def po_fulfilment(purchase_order_summary: DataFrame) -> DataFrame:
    """Null where nothing was ordered."""
    return purchase_order_summary.select("po_id", F.round(F.try_divide(100.0 * F.col("received").cast("double"), F.col("ordered")), 1).alias("percent"))


@query("f15_net_change", f"SELECT product_id, sum(CASE WHEN movement_type IN ('IN', 'RETURN', 'TRANSFER_IN') THEN quantity ELSE -quantity END)::BIGINT AS net_change FROM stock_movements WHERE created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 365 DAY AND created_at <= TIMESTAMP '{AS_OF}' GROUP BY 1 HAVING sum(CASE WHEN movement_type IN ('IN', 'RETURN', 'TRANSFER_IN') THEN quantity ELSE -quantity END) <> 0")
def net_change(stock_movements: DataFrame, days: int = 365, as_of: str = AS_OF) -> DataFrame:
    """Here an adjustment counts as negative, unlike in the ledger's signed delta."""
    now = as_of_ts(as_of)
    signed = F.when(F.col("movement_type").isin("IN", "RETURN", "TRANSFER_IN"), F.col("quantity")).otherwise(-F.col("quantity"))
    recent = stock_movements.where((F.col("created_at") >= now - F.expr(f"INTERVAL {days} DAYS")) & (F.col("created_at") <= now))
    return recent.groupBy("product_id").agg(F.sum(signed).alias("net_change")).where("net_change <> 0")


@query("f16_supplier_value", "SELECT s.supplier_id, s.name, coalesce(sum(value), 0)::DECIMAL(18,2) AS value FROM suppliers s LEFT JOIN purchase_order_summary USING (supplier_id) GROUP BY 1, 2")
def supplier_value(suppliers: DataFrame, purchase_order_summary: DataFrame) -> DataFrame:
    sums = purchase_order_summary.groupBy("supplier_id").agg(F.sum("value").alias("value"))
    return suppliers.select("supplier_id", "name").join(sums, "supplier_id", "left").select("supplier_id", "name", F.coalesce("value", F.lit(0)).cast(QTY).alias("value"))


@query("f17_category_stock", "SELECT c.name AS category, count(DISTINCT product_id) AS skus, sum(quantity)::BIGINT AS units, sum(quantity * unit_cost)::DECIMAL(18,2) AS value FROM stock_levels JOIN products USING (product_id) JOIN categories c USING (category_id) GROUP BY 1")
def category_stock(stock_levels: DataFrame, products: DataFrame, categories: DataFrame) -> DataFrame:
    sums = stock_levels.join(products.select("product_id", "category_id", "unit_cost"), "product_id").groupBy("category_id").agg(F.count_distinct("product_id").alias("skus"), F.sum("quantity").alias("units"), _value("unit_cost").alias("value"))
    return sums.join(F.broadcast(categories.select("category_id", F.col("name").alias("category"))), "category_id").select("category", "skus", "units", "value")


@query("f18_top_movers", "SELECT code, sku, units, rank FROM (SELECT *, rank() OVER (PARTITION BY warehouse_id ORDER BY units DESC)::INT AS rank FROM (SELECT warehouse_id, product_id, sum(quantity)::BIGINT AS units FROM stock_movements WHERE movement_type = 'OUT' GROUP BY 1, 2)) JOIN warehouses USING (warehouse_id) JOIN products USING (product_id) WHERE rank <= 10")
def top_movers(stock_movements: DataFrame, warehouses: DataFrame, products: DataFrame, n: int = 10) -> DataFrame:
    """The most shipped products of each warehouse, ties included; names are joined to the few that are left."""
    units = stock_movements.where("movement_type = 'OUT'").groupBy("warehouse_id", "product_id").agg(F.sum("quantity").alias("units"))
    top = units.withColumn("rank", F.rank().over(Window.partitionBy("warehouse_id").orderBy(F.desc("units")))).where(F.col("rank") <= n)
    return top.join(F.broadcast(warehouses.select("warehouse_id", "code")), "warehouse_id").join(products.select("product_id", "sku"), "product_id").select("code", "sku", "units", "rank")


@query("f19_supplier_spend", "SELECT s.name, s.country, count(*) AS orders, sum(value)::DECIMAL(18,2) AS spend FROM purchase_order_summary JOIN suppliers s USING (supplier_id) WHERE status <> 'CANCELLED' GROUP BY 1, 2 ORDER BY spend DESC, s.name LIMIT 20")
def supplier_spend(purchase_order_summary: DataFrame, suppliers: DataFrame, n: int = 20) -> DataFrame:
    sums = purchase_order_summary.where("status <> 'CANCELLED'").groupBy("supplier_id").agg(F.count("*").alias("orders"), F.sum("value").cast(QTY).alias("spend"))
    return sums.join(suppliers.select("supplier_id", "name", "country"), "supplier_id").select("name", "country", "orders", "spend").orderBy(F.desc("spend"), "name").limit(n)


@query("f20_overdue_orders", f"SELECT po_id, status, expected_date, (DATE '{AS_OF}' - expected_date)::INT AS days_late FROM purchase_orders WHERE status IN ('PLACED', 'PARTIALLY_RECEIVED') AND expected_date < DATE '{AS_OF}' ORDER BY expected_date, po_id LIMIT 50")
def overdue_orders(purchase_orders: DataFrame, n: int = 50, as_of: str = AS_OF) -> DataFrame:
    today = F.lit(as_of).cast("date")
    late = purchase_orders.where(F.col("status").isin("PLACED", "PARTIALLY_RECEIVED") & (F.col("expected_date") < today))
    return late.select("po_id", "status", "expected_date", F.date_diff(today, "expected_date").alias("days_late")).orderBy("expected_date", "po_id").limit(n)


@query("f21_valuation_by_cost", "SELECT code, cost_value, row_number() OVER (ORDER BY cost_value DESC, code)::INT AS position FROM stock_valuation")
def valuation_by_cost(stock_valuation: DataFrame) -> DataFrame:
    return stock_valuation.select("code", "cost_value", F.row_number().over(Window.orderBy(F.desc("cost_value"), "code")).alias("position"))


@query("f22_newest_movements", "SELECT * FROM recent_movements ORDER BY created_at DESC, movement_id LIMIT 200")
def newest_movements(recent_movements: DataFrame, n: int = 200) -> DataFrame:
    return recent_movements.orderBy(F.desc("created_at"), "movement_id").limit(n)


@query("f23_sales_by_category", "SELECT category, sum(sales_30d)::BIGINT AS units, sum(sales_30d * unit_price)::DECIMAL(18,2) AS revenue FROM items GROUP BY 1")
def sales_by_category(items: DataFrame) -> DataFrame:
    return items.groupBy("category").agg(F.sum("sales_30d").alias("units"), F.sum(F.col("sales_30d") * F.col("unit_price")).cast(QTY).alias("revenue"))


@query("f24_low_stock_inclusive", "SELECT sku, category, on_hand, reorder_point FROM items WHERE on_hand % 60 <= reorder_point ORDER BY on_hand, sku LIMIT 100")
def low_stock_of_shelf(items: DataFrame) -> DataFrame:
    return low_stock_inclusive(items, F.col("on_hand") % 60)


def low_stock_inclusive(items: DataFrame, on_hand: Column, n: int = 100) -> DataFrame:
    """At or below the reorder point, unlike ``low_stock_items``."""
    return items.where(on_hand <= F.col("reorder_point")).select("sku", "category", "on_hand", "reorder_point").orderBy("on_hand", "sku").limit(n)


@query("f25_inventory_summary", "SELECT category, count(*) AS skus, sum(on_hand)::BIGINT AS units, sum(on_hand * unit_cost)::DECIMAL(18,2) AS cost_value FROM items GROUP BY 1")
def inventory_summary(items: DataFrame) -> DataFrame:
    return items.groupBy("category").agg(F.count("*").alias("skus"), F.sum("on_hand").alias("units"), F.sum(F.col("on_hand") * F.col("unit_cost")).cast(QTY).alias("cost_value"))


@query("f26_urgency", "SELECT sku, on_hand - reorder_point AS urgency FROM items ORDER BY urgency, sku LIMIT 100")
def urgency(items: DataFrame, n: int = 100) -> DataFrame:
    return items.select("sku", (F.col("on_hand") - F.col("reorder_point")).alias("urgency")).orderBy("urgency", "sku").limit(n)


@query("f27_category_tree", "SELECT a.category_id, a.name, b.name AS parent, CASE WHEN b.name IS NULL THEN 0 ELSE 1 END AS depth FROM categories a LEFT JOIN categories b ON b.category_id = a.parent_id")
def category_tree(categories: DataFrame) -> DataFrame:
    parents = categories.select(F.col("category_id").alias("parent_id"), F.col("name").alias("parent"))
    return categories.join(parents, "parent_id", "left").select("category_id", "name", "parent", F.when(F.col("parent").isNull(), 0).otherwise(1).alias("depth"))


@query("f28_low_stock_denormalised", "SELECT product_id, warehouse_id, quantity, reorder_point FROM stock_levels JOIN products USING (product_id) WHERE quantity < reorder_point")
def low_stock_denormalised(stock_levels: DataFrame, products: DataFrame) -> DataFrame:
    """With the reorder point kept in the stock rows, the filter needs no join; here it is filled in first."""
    held = stock_levels.join(products.select("product_id", "reorder_point"), "product_id")
    return held.where("quantity < reorder_point").select("product_id", "warehouse_id", "quantity", "reorder_point")
