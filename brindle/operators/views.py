"""A stored valuation that follows changes of stock and prices instead of being made anew.

A sum over stock times price changes by (stock after - stock before) * price before, plus stock after * (price after - price before). So only the changed rows, the prices of
their products, and the stock of products whose price changed are read. The number of stock rows is kept beside the sums: where none is left the sums are null, as in a rebuild.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.operators.inventory import stock_valuation
from brindle.registry import query

VALUES = {"cost_value": "unit_cost", "retail_value": "unit_price"}
#: Up to so many changed products are named in the filter that reaches the files; more are joined.
NAMED = 1_000


def stored_valuation(warehouses: DataFrame, stock_levels: DataFrame, products: DataFrame) -> DataFrame:
    """The valuation with ``stock_rows``, as it is stored."""
    rows = stock_levels.groupBy("warehouse_id").agg(F.count("*").alias("stock_rows"))
    return stock_valuation(warehouses, stock_levels, products).join(rows, "warehouse_id", "left").withColumn("stock_rows", F.coalesce("stock_rows", F.lit(0)).cast("long"))


def _only(rows: DataFrame, changed: DataFrame) -> DataFrame:
    """The rows of changed products (product_id)."""
    some = [r[0] for r in changed.select("product_id").distinct().limit(NAMED + 1).collect()]
    return rows.where(F.col("product_id").isin(*some)) if len(some) <= NAMED else rows.join(changed.select("product_id").distinct(), "product_id", "left_semi")


def valuation_change(stock_changes: DataFrame, price_changes: DataFrame, stock_levels: DataFrame, products: DataFrame) -> DataFrame:
    """(warehouse_id, stock_rows, units, cost_value, retail_value): what changes add to each warehouse.

    stock_changes: (product_id, warehouse_id, before, after), one row for each shelf that changed, null where it wasn't or isn't there. price_changes: (product_id,
    unit_cost_before, unit_cost_after, unit_price_before, unit_price_after). stock_levels, products: as they are now.
    """
    now = _only(products.select("product_id", *VALUES.values()), stock_changes)
    old = price_changes.select("product_id", *[F.col(f"{p}_before").alias(f"__{p}") for p in VALUES.values()], F.lit(True).alias("__changed"))
    priced = stock_changes.join(now, "product_id", "left").join(old, "product_id", "left")
    count = lambda c: F.when(F.col(c).isNull(), 0).otherwise(1)
    price = lambda p: F.when(F.col("__changed"), F.col(f"__{p}")).otherwise(F.col(p))
    more = F.coalesce("after", F.lit(0)) - F.coalesce("before", F.lit(0))
    moved = priced.select("warehouse_id", (count("after") - count("before")).alias("stock_rows"), more.alias("units"), *[(more * price(p)).cast("decimal(38,4)").alias(v) for v, p in VALUES.items()])
    shelves = _only(stock_levels.select("product_id", "warehouse_id", "quantity"), price_changes).join(price_changes, "product_id")
    dearer = shelves.select("warehouse_id", F.lit(0).alias("stock_rows"), F.lit(0).alias("units"), *[(F.col("quantity") * (F.coalesce(f"{p}_after", F.lit(0)) - F.coalesce(f"{p}_before", F.lit(0)))).cast("decimal(38,4)").alias(v) for v, p in VALUES.items()])
    return moved.unionByName(dearer).groupBy("warehouse_id").agg(*[F.sum(c).alias(c) for c in ("stock_rows", "units", *VALUES)])


def refreshed_valuation(view: DataFrame, change: DataFrame) -> DataFrame:
    """The stored valuation after a change."""
    plus = change.select("warehouse_id", *[F.col(c).alias(f"__{c}") for c in ("stock_rows", "units", *VALUES)])
    both = view.join(F.broadcast(plus), "warehouse_id", "left")  # a row for each warehouse
    rows = (F.col("stock_rows") + F.coalesce("__stock_rows", F.lit(0))).cast("long")

    def after(c: str) -> Column:
        return F.when(rows > 0, F.coalesce(F.col(c), F.lit(0)) + F.coalesce(F.col(f"__{c}"), F.lit(0))).cast(view.schema[c].dataType).alias(c)

    return both.select("warehouse_id", "code", after("units"), *[after(v) for v in VALUES], rows.alias("stock_rows"))


@query("g10_refreshed_valuation", "SELECT v.*, (SELECT count(*) FROM stock_levels s WHERE s.warehouse_id = v.warehouse_id) AS stock_rows FROM stock_valuation v")
def valuation_after_changes(warehouses: DataFrame, stock_levels: DataFrame, products: DataFrame) -> DataFrame:
    """From a snapshot in which every tenth product was missing, every seventh had twice the stock, and every eleventh another price."""
    was = stock_levels.where("product_id % 10 <> 0").withColumn("quantity", F.when(F.col("product_id") % 7 == 0, F.col("quantity") * 2).otherwise(F.col("quantity")))
    cheaper = lambda p: F.when(F.col("product_id") % 11 == 0, (F.col(p) - 1).cast("decimal(12,2)")).otherwise(F.col(p)).alias(p)
    before = products.select("product_id", *[cheaper(p) for p in VALUES.values()])
    view = stored_valuation(warehouses, was, before)
    added = stock_levels.where("product_id % 10 = 0").select("product_id", "warehouse_id", F.lit(None).cast("int").alias("before"), F.col("quantity").alias("after"))
    halved = stock_levels.where("product_id % 10 <> 0 AND product_id % 7 = 0").select("product_id", "warehouse_id", (F.col("quantity") * 2).alias("before"), F.col("quantity").alias("after"))
    prices = products.where("product_id % 11 = 0").select("product_id", *[x for p in VALUES.values() for x in ((F.col(p) - 1).cast("decimal(12,2)").alias(f"{p}_before"), F.col(p).alias(f"{p}_after"))])
    return refreshed_valuation(view, valuation_change(added.unionByName(halved), prices, stock_levels, products))
