"""The two domains' tables, made from the given star-schema and event tables.

Timestamps are without a zone throughout, so that nothing depends on the session's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.registry import table

#: What "now" is for every trailing window, so that results can be repeated.
AS_OF = "2001-08-01"

MONEY = "decimal(12,2)"


@table("""SELECT row_number() OVER (ORDER BY name)::INT AS category_id, name,
    CASE WHEN row_number() OVER (ORDER BY name) BETWEEN 4 AND 6 THEN 1 END AS parent_id FROM (SELECT DISTINCT p_type AS name FROM part)""")
def categories(part: DataFrame) -> DataFrame:
    """The part types, numbered by name; the window runs over the few distinct types."""
    names = part.select(F.col("p_type").alias("name")).distinct()
    ids = names.withColumn("category_id", F.row_number().over(Window.orderBy("name")))
    return ids.select("category_id", "name", F.when(F.col("category_id").between(4, 6), 1).alias("parent_id"))


@table("SELECT s_suppkey AS supplier_id, s_name AS name, n_name AS country, s_suppkey % 9 <> 0 AS is_active, lower(replace(s_name, '#', '.')) || '@supply.example' AS contact_email FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def suppliers(supplier: DataFrame, nation: DataFrame) -> DataFrame:
    joined = supplier.join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"))
    return joined.select(F.col("s_suppkey").alias("supplier_id"), F.col("s_name").alias("name"), F.col("n_name").alias("country"), (F.col("s_suppkey") % 9 != 0).alias("is_active"), F.concat(F.lower(F.replace("s_name", F.lit("#"), F.lit("."))), F.lit("@supply.example")).alias("contact_email"))


@table("SELECT r_regionkey + 1 AS warehouse_id, 'WH0' || (r_regionkey + 1) AS code, r_name AS name FROM region")
def warehouses(region: DataFrame) -> DataFrame:
    key = F.col("r_regionkey") + 1
    return region.select(key.alias("warehouse_id"), F.concat(F.lit("WH0"), key).alias("code"), F.col("r_name").alias("name"))


@table("""SELECT p_partkey AS product_id, 'SKU-' || lpad(p_partkey::VARCHAR, 6, '0') AS sku, p_name AS name, category_id,
    p_retailprice::DECIMAL(12,2) AS unit_price, (p_retailprice::DECIMAL(12,2) * 0.6)::DECIMAL(12,2) AS unit_cost,
    (10 + p_size % 40)::INT AS reorder_point, (25 + p_partkey % 75)::INT AS reorder_quantity, p_partkey % 23 <> 0 AS is_active
    FROM part JOIN categories ON categories.name = p_type""")
def products(part: DataFrame, categories: DataFrame) -> DataFrame:
    price = F.col("p_retailprice").cast(MONEY)
    joined = part.join(F.broadcast(categories.select("category_id", F.col("name").alias("type"))), F.col("p_type") == F.col("type"))
    return joined.select(F.col("p_partkey").alias("product_id"), F.concat(F.lit("SKU-"), F.lpad(F.col("p_partkey").cast("string"), 6, "0")).alias("sku"), F.col("p_name").alias("name"), "category_id",
        price.alias("unit_price"), (price * F.lit("0.6").cast("decimal(2,1)")).cast(MONEY).alias("unit_cost"),
        (10 + F.col("p_size") % 40).cast("int").alias("reorder_point"), (25 + F.col("p_partkey") % 75).cast("int").alias("reorder_quantity"), (F.col("p_partkey") % 23 != 0).alias("is_active"))


@table("SELECT product_id, warehouse_id, ((product_id * 7919 + warehouse_id * 104729) % 200)::INT AS quantity FROM products, warehouses")
def stock_levels(products: DataFrame, warehouses: DataFrame) -> DataFrame:
    """Every product in every warehouse (there are five)."""
    pairs = products.select("product_id").crossJoin(F.broadcast(warehouses.select("warehouse_id")))
    return pairs.withColumn("quantity", ((F.col("product_id") * 7919 + F.col("warehouse_id") * 104729) % 200).cast("int"))


MOVEMENT_TYPES = {"NO": "OUT", "NF": "IN", "RO": "RETURN", "RF": "ADJUSTMENT", "AO": "TRANSFER_IN", "AF": "TRANSFER_OUT"}


@table("""SELECT md5(concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber, round(l_quantity)::BIGINT, round(l_extendedprice * 100)::BIGINT, round(l_discount * 100)::BIGINT, round(l_tax * 100)::BIGINT, l_returnflag, l_linestatus, strftime(l_shipdate, '%Y-%m-%d'))) AS movement_id,
    l_partkey AS product_id, (l_suppkey % 5 + 1)::INT AS warehouse_id,
    CASE l_returnflag || l_linestatus WHEN 'NO' THEN 'OUT' WHEN 'NF' THEN 'IN' WHEN 'RO' THEN 'RETURN' WHEN 'RF' THEN 'ADJUSTMENT' WHEN 'AO' THEN 'TRANSFER_IN' WHEN 'AF' THEN 'TRANSFER_OUT' END AS movement_type,
    l_quantity::INT AS quantity, l_suppkey AS reference_id, l_shipdate AS created_at FROM lineitem""")
def stock_movements(lineitem: DataFrame) -> DataFrame:
    """The ledger. Rows are named by a hash of their columns: a running number would need one order over the whole ledger."""
    cents = lambda c: F.round(F.col(c) * 100).cast("long")
    key = F.md5(F.concat_ws("|", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.round("l_quantity").cast("long"), cents("l_extendedprice"), cents("l_discount"), cents("l_tax"), "l_returnflag", "l_linestatus", F.date_format("l_shipdate", "yyyy-MM-dd")))
    flags = F.concat("l_returnflag", "l_linestatus")
    kind = F.coalesce(*[F.when(flags == k, v) for k, v in MOVEMENT_TYPES.items()])
    return lineitem.select(key.alias("movement_id"), F.col("l_partkey").alias("product_id"), (F.col("l_suppkey") % 5 + 1).cast("int").alias("warehouse_id"), kind.alias("movement_type"),
        F.col("l_quantity").cast("int").alias("quantity"), F.col("l_suppkey").alias("reference_id"), F.col("l_shipdate").alias("created_at"))


@table("""SELECT o_orderkey AS po_id, o_custkey % (SELECT count(*) FROM supplier) AS supplier_id, (o_orderkey % 5 + 1)::INT AS warehouse_id,
    CASE WHEN o_orderkey % 7 = 0 THEN 'DRAFT' WHEN o_orderkey % 7 = 6 THEN 'CANCELLED' WHEN o_orderstatus = 'F' THEN 'RECEIVED' WHEN o_orderstatus = 'O' THEN 'PLACED' ELSE 'PARTIALLY_RECEIVED' END AS status,
    o_orderdate::DATE AS order_date, o_orderdate::DATE + 14 AS expected_date FROM orders""")
def purchase_orders(orders: DataFrame, supplier: DataFrame) -> DataFrame:
    n = F.broadcast(supplier.agg(F.count("*").alias("n")))
    status = F.when(F.col("o_orderkey") % 7 == 0, "DRAFT").when(F.col("o_orderkey") % 7 == 6, "CANCELLED").when(F.col("o_orderstatus") == "F", "RECEIVED").when(F.col("o_orderstatus") == "O", "PLACED").otherwise("PARTIALLY_RECEIVED")
    day = F.col("o_orderdate").cast("date")
    return orders.crossJoin(n).select(F.col("o_orderkey").alias("po_id"), (F.col("o_custkey") % F.col("n")).alias("supplier_id"), (F.col("o_orderkey") % 5 + 1).cast("int").alias("warehouse_id"), status.alias("status"), day.alias("order_date"), F.date_add(day, 14).alias("expected_date"))


@table("""SELECT po_id, l.product_id, quantity_ordered, (CASE status WHEN 'RECEIVED' THEN quantity_ordered WHEN 'PARTIALLY_RECEIVED' THEN quantity_ordered // 2 ELSE 0 END)::INT AS quantity_received, unit_cost
    FROM (SELECT l_orderkey AS po_id, l_partkey AS product_id, sum(l_quantity)::INT AS quantity_ordered FROM lineitem GROUP BY 1, 2) l JOIN purchase_orders USING (po_id) JOIN products USING (product_id)""")
def purchase_order_items(lineitem: DataFrame, purchase_orders: DataFrame, products: DataFrame) -> DataFrame:
    lines = lineitem.groupBy(F.col("l_orderkey").alias("po_id"), F.col("l_partkey").alias("product_id")).agg(F.sum("l_quantity").cast("int").alias("quantity_ordered"))
    received = F.when(F.col("status") == "RECEIVED", F.col("quantity_ordered")).when(F.col("status") == "PARTIALLY_RECEIVED", F.floor(F.col("quantity_ordered") / 2)).otherwise(0)
    return lines.join(purchase_orders.select("po_id", "status"), "po_id").join(products.select("product_id", "unit_cost"), "product_id").select("po_id", "product_id", "quantity_ordered", received.cast("int").alias("quantity_received"), "unit_cost")


@table("""SELECT sku, p.name, c.name AS category, coalesce(sum(quantity), 0)::BIGINT AS on_hand, reorder_point, unit_cost, unit_price, (p.product_id * 31 % 97)::INT AS sales_30d
    FROM products p JOIN categories c USING (category_id) LEFT JOIN stock_levels s USING (product_id) GROUP BY ALL""")
def items(products: DataFrame, categories: DataFrame, stock_levels: DataFrame) -> DataFrame:
    """The dashboard's table: one row for each product."""
    held = stock_levels.groupBy("product_id").agg(F.sum("quantity").alias("on_hand"))
    named = products.join(F.broadcast(categories.select("category_id", F.col("name").alias("category"))), "category_id").join(held, "product_id", "left")
    return named.select("sku", "name", "category", F.coalesce("on_hand", F.lit(0).cast("long")).alias("on_hand"), "reorder_point", "unit_cost", "unit_price", (F.col("product_id") * 31 % 97).cast("int").alias("sales_30d"))


# --- web events -----------------------------------------------------------------------------------

_EVENT_NAME = "CASE event_type WHEN 'view' THEN CASE WHEN k % 2 = 0 THEN 'page_view' ELSE 'view_item' END WHEN 'click' THEN 'add_to_cart' WHEN 'error' THEN 'begin_checkout' WHEN 'signup' THEN 'login' ELSE 'purchase' END"
_ACCOUNT = "CASE WHEN event_type IN ('signup', 'purchase') AND user_id % 5 <> 0 THEN md5(concat('a', cast(CASE WHEN user_id % 7 = 0 AND k % 2 = 1 THEN user_id + 100000 ELSE user_id - user_id % 2 END AS {text}))) END"
_SOURCE = "CASE k % 6 WHEN 0 THEN 'google' WHEN 1 THEN 'google' WHEN 2 THEN 'newsletter' WHEN 3 THEN '(direct)' END"
_MEDIUM = "CASE k % 6 WHEN 0 THEN 'cpc' WHEN 1 THEN 'organic' WHEN 2 THEN 'email' WHEN 3 THEN '(none)' END"
_CAMPAIGN = "CASE k % 6 WHEN 0 THEN 'brand' WHEN 1 THEN '(organic)' WHEN 2 THEN 'nov' WHEN 3 THEN '(direct)' END"
_TRANSACTION = "CASE WHEN event_type = 'purchase' THEN CASE k % 10 WHEN 0 THEN NULL WHEN 1 THEN '(not set)' WHEN 2 THEN concat('T', user_id, '-', cast(floor(day / 3) AS bigint)) WHEN 3 THEN concat('T', user_id, '-', cast(floor(day / 3) AS bigint)) WHEN 4 THEN concat('X', cast(floor(event_id / 200) AS bigint)) ELSE concat('P', event_id) END END"

_TEXT_PARAMS = {
    "page_title": "concat('Page ', k)",
    "page_referrer": "CASE WHEN k % 3 = 1 THEN 'https://search.example/' END",
    "search_term": "CASE WHEN k % 8 = 5 THEN concat('term ', k) END",
    "item_list_id": "CASE WHEN event_type = 'view' THEN concat('l', k % 4) END",
    "item_list_name": "CASE WHEN event_type = 'view' THEN concat('List ', k % 4) END",
    "shipping_tier": "CASE WHEN event_type = 'purchase' THEN CASE WHEN k % 2 = 0 THEN 'Ground' ELSE 'Air' END END",
    "payment_type": "CASE WHEN event_type = 'purchase' THEN 'card' END",
    "currency": "CASE WHEN event_type = 'purchase' THEN CASE WHEN user_id % 3 = 0 THEN 'EUR' ELSE 'USD' END END",
}
_DAY = "replace(cast(cast(ts AS date) AS string), '-', '')"
_ADS_STORAGE = "CASE WHEN event_id % 20 = 0 THEN 'No' WHEN k % 2 = 0 THEN 'Yes' ELSE 'No' END"
_TERM = "CASE WHEN k % 6 = 0 THEN 'shoes' END"
_DEVICE = "CASE user_id % 3 WHEN 0 THEN 'desktop' WHEN 1 THEN 'mobile' ELSE 'tablet' END"
_SYSTEM = "CASE user_id % 3 WHEN 0 THEN 'Linux' ELSE 'Android' END"
_BROWSER = "CASE user_id % 5 WHEN 0 THEN 'Firefox' ELSE 'Chrome' END"
_COUNTRY = "CASE user_id % 4 WHEN 0 THEN 'France' WHEN 1 THEN 'Spain' ELSE 'Canada' END"
_REGION = "CASE WHEN user_id % 4 < 2 THEN concat('Region ', user_id % 7) END"
_STREAM = "CASE WHEN user_id % 3 = 0 THEN '2' ELSE '1' END"


@table("""SELECT *, CAST(floor((micros - 21600000000) / 86400000000) AS BIGINT) AS day FROM (
    SELECT event_id, ts, user_id, event_type, value, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k, epoch_us(ts) AS micros FROM events)""")
def numbered_events(events: DataFrame) -> DataFrame:
    """The given events with the number in their props, microseconds, and the number of their session's day."""
    micros = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    rows = events.select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "value", F.regexp_extract("props", "([0-9]+)", 1).cast("int").alias("k"))
    rows = rows.repartition("event_id")  # narrow rows, dealt to all cores however few row groups their file has: what follows is wide and slow
    return rows.withColumn("micros", micros).withColumn("day", F.floor((F.col("micros") - 21600000000) / 86400000000).cast("long"))


@table()
def web_export(numbered_events: DataFrame, part: DataFrame) -> DataFrame:
    """A nested event export as an analytics service writes it: parameters as an array of typed values, items as an array of records, and every 50th event twice.

    What is nested are columns that stand below the copies: a plan that takes a nested column apart again is left with those that it reads.
    """
    e = numbered_events.crossJoin(F.broadcast(part.agg(F.count("*").alias("parts"))))
    e = e.withColumns({"event_name": F.expr(_EVENT_NAME), "pseudo": F.expr("CASE WHEN event_id % 20 <> 0 THEN concat('d', user_id) END")})
    bought = lambda sql, kind: f"CASE WHEN event_type = 'purchase' THEN cast({sql} AS {kind}) END"
    item = "transform(sequence(0, k % 3), p -> named_struct('item_id', cast((event_id * 7 + p) % parts AS string), 'item_name', CASE WHEN p = 1 THEN '(not set)' ELSE concat(' item ', p, ' ') END, 'quantity', cast(1 + k % 4 AS bigint), 'coupon', CASE WHEN p = 2 THEN '' ELSE 'C1' END, "
    item += "'item_brand', concat('B', p), 'item_variant', CASE WHEN p = 1 THEN ' ' ELSE concat('v', p) END, 'item_category', CASE WHEN p = 2 THEN '(not set)' ELSE concat('cat ', k % 4) END, 'item_list_name', concat('List ', k % 4), 'item_list_index', cast(p + 1 AS string), "
    item += "'price_in_usd', CASE WHEN k % 5 < 3 THEN cast(5 + k % 20 + p AS double) END, 'price', CASE WHEN k % 5 < 4 THEN cast(4 + k % 20 + p AS double) END, 'item_revenue_in_usd', CASE WHEN k % 5 = 0 THEN cast((5 + k % 20 + p) * (1 + k % 4) AS double) END))"
    values = {
        "source": "CASE WHEN user_id % 3 = 0 THEN 'store_b' ELSE 'store_a' END", "event_date": _DAY, "account": _ACCOUNT.format(text="string"),
        "ga_session_number_string": "CASE WHEN event_id % 2 = 1 THEN day % 5 + 1 END", "ga_session_number_int": "CASE WHEN event_id % 2 = 0 THEN day % 5 + 1 END",
        "page_location": "concat('https://shop.example/', event_name, '/', k, '?utm_source=', k % 6)", "engagement": "k * 10", "engaged": "CASE WHEN k % 4 <> 0 THEN '1' ELSE '0' END", "method": "CASE WHEN event_type = 'signup' THEN 'password' END",
        **{name: sql.format(text="string") for name, sql in _TEXT_PARAMS.items()},
        "analytics_storage": "CASE WHEN pseudo IS NULL THEN 'No' ELSE 'Yes' END", "ads_storage": _ADS_STORAGE, "uses_transient_token": "CASE WHEN pseudo IS NULL THEN 'Yes' ELSE 'No' END",
        "category": _DEVICE, "system": _SYSTEM, "browser": _BROWSER, "country": _COUNTRY, "region": _REGION, "stream_id": _STREAM, "export_table": f"concat('events_', {_DAY})", "value_in_usd": "CASE WHEN user_id % 3 <> 0 THEN value END",
        "collected_source": _SOURCE, "collected_medium": _MEDIUM, "collected_campaign": _CAMPAIGN, "collected_term": _TERM, "click_source": "CASE WHEN event_id % 11 = 0 THEN 'ads' END", "click_medium": "CASE WHEN event_id % 11 = 0 THEN 'cpc' END",
        "first_source": "CASE WHEN user_id % 4 = 0 THEN 'partner' END", "first_medium": "CASE WHEN user_id % 4 = 0 THEN 'referral' END", "first_campaign": "CASE WHEN user_id % 4 = 0 THEN 'p1' END",
        "transaction_id": _TRANSACTION, "revenue": "CASE WHEN event_type = 'purchase' THEN CASE WHEN k % 10 = 0 THEN 0.0D ELSE cast(cast(value AS decimal(18,2)) AS double) END END",
        "tax_usd": bought("CASE WHEN k % 2 = 0 THEN k * 0.5D END", "double"), "tax": bought("k * 0.25D", "double"), "shipping": bought("CASE WHEN k % 3 > 0 THEN 4.5D END", "double"),
        "quantity": bought("(k % 3 + 1) * (1 + k % 4)", "bigint"), "unique_items": bought("k % 3 + 1", "bigint"), "items": f"CASE WHEN event_type = 'purchase' THEN {item} ELSE array() END",
    }
    e = e.withColumns({f"e_{name}": F.expr(sql) for name, sql in values.items()})
    e = e.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col("event_id") % 50 == 0, 2).otherwise(1)))).drop("copy")
    param = lambda key, string="NULL", int_="NULL", double="NULL": f"named_struct('key', '{key}', 'value', named_struct('string_value', cast({string} AS string), 'int_value', cast({int_} AS bigint), 'double_value', cast({double} AS double)))"
    params = ", ".join([
        param("ga_session_id", int_="day"), param("ga_session_number", string="e_ga_session_number_string", int_="e_ga_session_number_int"), param("page_location", string="e_page_location"), param("engagement_time_msec", int_="e_engagement"),
        param("session_engaged", string="e_engaged"), param("method", string="e_method"), param("value", double="value"), *[param(name, string=f"e_{name}") for name in _TEXT_PARAMS],
    ])
    record = lambda **fields: F.struct(*[F.col(f"e_{c}").alias(name) for name, c in fields.items()])
    return e.select(
        F.col("e_source").alias("source"), F.col("e_event_date").alias("event_date"), F.col("micros").alias("event_timestamp"), "event_name", "event_id", F.expr(f"array({params})").alias("event_params"), F.col("e_account").alias("user_id"), F.col("pseudo").alias("user_pseudo_id"),
        record(analytics_storage="analytics_storage", ads_storage="ads_storage", uses_transient_token="uses_transient_token").alias("privacy_info"),
        F.struct(F.col("e_category").alias("category"), F.col("e_system").alias("operating_system"), record(browser="browser").alias("web_info")).alias("device"), F.struct(F.col("e_country").alias("country"), F.col("e_region").alias("region"), F.lit("(not set)").alias("city")).alias("geo"),
        F.lit("WEB").alias("platform"), F.col("e_stream_id").alias("stream_id"), F.col("e_export_table").alias("export_table"), F.col("e_value_in_usd").alias("event_value_in_usd"),
        record(manual_source="collected_source", manual_medium="collected_medium", manual_campaign_name="collected_campaign", manual_term="collected_term").alias("collected_traffic_source"),
        F.struct(F.col("e_click_source").alias("source"), F.col("e_click_medium").alias("medium"), F.lit(None).cast("string").alias("campaign")).alias("session_traffic_source_last_click"),
        record(source="first_source", medium="first_medium", name="first_campaign").alias("traffic_source"),
        record(transaction_id="transaction_id", purchase_revenue_in_usd="revenue", tax_value_in_usd="tax_usd", tax_value="tax", shipping_value_in_usd="shipping", total_item_quantity="quantity", unique_items="unique_items").alias("ecommerce"), F.col("e_items").alias("items"),
    )


@table(f"""SELECT CASE WHEN user_id % 3 = 0 THEN 'store_b' ELSE 'store_a' END AS source,
    md5(concat_ws('|', CASE WHEN user_id % 3 = 0 THEN 'store_b' ELSE 'store_a' END, micros, coalesce(CASE WHEN event_id % 20 <> 0 THEN concat('d', user_id) END, ''), {_EVENT_NAME}, event_id)) AS event_key,
    CASE WHEN event_id % 50 = 0 THEN 2 ELSE 1 END AS export_row_count, ts::DATE AS event_date, ts AS event_timestamp, {_EVENT_NAME} AS event_name,
    CASE WHEN event_id % 20 <> 0 THEN concat('d', user_id) END AS user_pseudo_id, {_ACCOUNT.format(text='varchar')} AS user_id, day AS ga_session_id, (day % 5 + 1)::BIGINT AS ga_session_number,
    CASE WHEN event_id % 20 <> 0 THEN concat(CASE WHEN user_id % 3 = 0 THEN 'store_b' ELSE 'store_a' END, ':d', user_id, ':', day) END AS session_key,
    concat('https://shop.example/', {_EVENT_NAME}, '/', k, '?utm_source=', k % 6) AS page_location, concat('/', {_EVENT_NAME}, '/', k) AS page_path,
    k * 10::BIGINT AS engagement_time_msec, k % 4 <> 0 AS session_engaged, CASE WHEN event_type = 'signup' THEN 'password' END AS method, value AS event_value,
    {_SOURCE} AS collected_source, {_MEDIUM} AS collected_medium, {_CAMPAIGN} AS collected_campaign,
    CASE WHEN event_id % 11 = 0 THEN 'ads' END AS last_click_source, CASE WHEN event_id % 11 = 0 THEN 'cpc' END AS last_click_medium, NULL::VARCHAR AS last_click_campaign,
    CASE WHEN user_id % 4 = 0 THEN 'partner' END AS first_user_source, CASE WHEN user_id % 4 = 0 THEN 'referral' END AS first_user_medium, CASE WHEN user_id % 4 = 0 THEN 'p1' END AS first_user_campaign,
    CASE WHEN event_id % 20 <> 0 THEN 'Yes' ELSE 'No' END AS analytics_storage,
    nullif({_TRANSACTION}, '(not set)') AS transaction_id,
    CASE WHEN event_type = 'purchase' THEN CASE WHEN k % 10 = 0 THEN 0.0::DOUBLE ELSE value::DECIMAL(18,2)::DOUBLE END END AS purchase_revenue_usd,
    {', '.join(f'{sql} AS {name}' for name, sql in _TEXT_PARAMS.items())}, {_TERM} AS collected_term, {_ADS_STORAGE} AS ads_storage, CASE WHEN event_id % 20 <> 0 THEN 'No' ELSE 'Yes' END AS uses_transient_token,
    {_DEVICE} AS device_category, {_SYSTEM} AS operating_system, {_BROWSER} AS browser, {_COUNTRY} AS geo_country, {_REGION} AS geo_region, '(not set)' AS geo_city, 'WEB' AS platform, {_STREAM} AS stream_id, 'events_' || strftime(ts, '%Y%m%d') AS export_table,
    CASE WHEN user_id % 3 <> 0 THEN value END AS event_value_in_usd, CASE WHEN event_type = 'purchase' THEN k * CASE WHEN k % 2 = 0 THEN 0.5::DOUBLE ELSE 0.25::DOUBLE END END AS tax_usd, CASE WHEN event_type = 'purchase' AND k % 3 > 0 THEN 4.5::DOUBLE END AS shipping_usd,
    CASE WHEN event_type = 'purchase' THEN ((k % 3 + 1) * (1 + k % 4))::BIGINT END AS total_item_quantity, CASE WHEN event_type = 'purchase' THEN (k % 3 + 1)::BIGINT END AS unique_items,
    CASE WHEN event_type = 'purchase' THEN k % 3 + 1 ELSE 0 END AS item_count, event_id, k FROM numbered_events""")
def flat_events(web_export: DataFrame) -> DataFrame:
    from brindle.operators.staging import flatten

    return flatten(web_export)


@table("""SELECT day::DATE AS cost_date, source, c.session_source, c.session_medium, c.session_campaign, (10 + extract(day FROM day))::DOUBLE AS cost_usd
    FROM (SELECT unnest(generate_series(min(ts)::DATE, max(ts)::DATE + 5, INTERVAL 1 DAY)) AS day FROM events), (VALUES ('store_a'), ('store_b')) s(source),
    (VALUES ('google', 'cpc', 'brand'), ('newsletter', 'email', 'nov'), ('ads', 'cpc', '(not set)')) c(session_source, session_medium, session_campaign)""")
def campaign_costs(events: DataFrame) -> DataFrame:
    """A cost for each day of the events, and five days on, of three paid campaigns and both stores."""
    days = events.agg(F.min(F.col("ts").cast("date")).alias("a"), F.max(F.col("ts").cast("date")).alias("b")).select(F.explode(F.expr("sequence(a, date_add(b, 5), interval 1 day)")).alias("cost_date"))
    campaigns = F.expr("explode(array(named_struct('s', 'google', 'm', 'cpc', 'c', 'brand'), named_struct('s', 'newsletter', 'm', 'email', 'c', 'nov'), named_struct('s', 'ads', 'm', 'cpc', 'c', '(not set)')))")
    rows = days.withColumn("source", F.explode(F.array(F.lit("store_a"), F.lit("store_b")))).withColumn("campaign", campaigns)
    return rows.select("cost_date", "source", F.col("campaign.s").alias("session_source"), F.col("campaign.m").alias("session_medium"), F.col("campaign.c").alias("session_campaign"), (F.dayofmonth("cost_date") + 10).cast("double").alias("cost_usd"))


@table("""SELECT p_partkey::VARCHAR AS item_id, p_name AS item_name, p_type AS item_category, p_retailprice AS price_usd,
    round(p_retailprice * (1 - CASE p_type WHEN 'ECONOMY' THEN 0.2 WHEN 'PROMO' THEN 0.3 WHEN 'STANDARD' THEN 0.4 ELSE 0.5 END), 2)::DOUBLE AS unit_cost_usd FROM part""")
def catalog(part: DataFrame) -> DataFrame:
    from brindle.operators.orders import catalog_cost

    return catalog_cost(part.select(F.col("p_partkey").cast("string").alias("item_id"), F.col("p_name").alias("item_name"), F.col("p_type").alias("item_category"), F.col("p_retailprice").alias("price_usd")))
