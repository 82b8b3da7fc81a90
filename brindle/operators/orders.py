"""Identity, sessions, orders and daily marts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.operators.relational import exact_sum
from brindle.registry import query, table, whole_table

FIELDS = ("source", "medium", "campaign")


def money_rate(a: str, b: str, digits: int = 4) -> Column:
    """A ratio of an amount, rounded half up on the double itself (the shortest decimal text of such a ratio may lie on the other side of a half)."""
    return F.floor(F.try_divide(F.col(a).cast("double"), F.col(b)) * 10**digits + 0.5) / F.lit(float(10**digits))


MARGINS = {"ECONOMY": 0.2, "PROMO": 0.3, "STANDARD": 0.4}


def rate(a, b, digits: int = 4) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.round(F.try_divide(a.cast("double"), b), digits)


def catalog_cost(items: DataFrame, margins: dict[str, float] = MARGINS, otherwise: float = 0.5) -> DataFrame:
    """Catalog items with a unit cost from their category's margin."""
    margin = F.coalesce(*[F.when(F.col("item_category") == c, m) for c, m in margins.items()], F.lit(otherwise))
    return items.withColumn("unit_cost_usd", F.round(F.col("price_usd") * (1 - margin), 2))


@table("""SELECT *, coalesce(user_id, 'anon:' || source || ':' || user_pseudo_id) AS person_id, count(*) OVER (PARTITION BY coalesce(user_id, 'anon:' || source || ':' || user_pseudo_id)) AS person_device_count FROM (
    SELECT source, user_pseudo_id, CASE count(DISTINCT user_id) WHEN 0 THEN 'anonymous_device' WHEN 1 THEN 'user_id' ELSE 'shared_device' END AS identity_rule, CASE WHEN count(DISTINCT user_id) = 1 THEN min(user_id) END AS user_id,
    count(DISTINCT user_id) AS user_id_count, min(event_timestamp) AS first_seen_at, min(event_timestamp) FILTER (user_id IS NOT NULL) AS first_signed_in_at, max(event_timestamp) AS last_seen_at, count(*) AS events, count(DISTINCT ga_session_id) AS sessions
    FROM stg_events WHERE user_pseudo_id IS NOT NULL GROUP BY 1, 2)""", name="int_identity")  # fmt: skip
def identity_of_events(stg_events: DataFrame) -> DataFrame:
    """Which person each device is, from all events at once. The first aggregate leaves a row for each device and account and keeps numbers only, so it hashes where sets and texts would be sorted."""
    device, seen = ["user_pseudo_id", "source"], stg_events.where("user_pseudo_id IS NOT NULL")
    accounts = seen.groupBy(*device, "user_id").agg(F.min("event_timestamp").alias("first_at"), F.max("event_timestamp").alias("last_at"), F.count("*").alias("n"))
    signed = F.when(F.col("user_id").isNotNull(), F.col("first_at"))
    days = accounts.groupBy(*device).agg(F.count("user_id").alias("user_id_count"), F.max("user_id").alias("__one"), F.min("first_at").alias("first_seen_at"), F.min(signed).alias("first_signed_in_at"), F.max("last_at").alias("last_seen_at"), F.sum("n").alias("events"))
    source = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))  # a null one is equal to itself; plain keys let a reader without need of sessions leave the join out
    sessions = seen.select("user_pseudo_id", source.alias("__source"), "ga_session_id").distinct().groupBy("user_pseudo_id", "__source").agg(F.count("ga_session_id").alias("sessions"))
    return _named(days.withColumn("__source", source).join(sessions, ["user_pseudo_id", "__source"], "left"))


def int_identity(int_device_days: DataFrame) -> DataFrame:
    """Which person each device is: its one account, or itself when it had none or several. Adds up the device's days."""
    days = int_device_days.groupBy("user_pseudo_id", "source").agg(F.array_distinct(F.flatten(F.collect_list("user_ids"))).alias("ids"), F.min("first_seen_at").alias("first_seen_at"), F.min("first_signed_in_at").alias("first_signed_in_at"),
        F.max("last_seen_at").alias("last_seen_at"), F.sum("events").alias("events"), F.size(F.array_distinct(F.flatten(F.collect_list("ga_session_ids")))).cast("long").alias("sessions"))
    return _named(days.withColumn("user_id_count", F.size("ids").cast("long")).withColumn("__one", F.element_at("ids", F.when(F.size("ids") > 0, 1))))


def _named(devices: DataFrame) -> DataFrame:
    """Devices with their number of accounts, and one of these, as persons."""
    n = F.col("user_id_count")
    named = devices.select("source", "user_pseudo_id", F.when(n == 0, "anonymous_device").when(n == 1, "user_id").otherwise("shared_device").alias("identity_rule"), F.when(n == 1, F.col("__one")).alias("user_id"), "user_id_count", "first_seen_at", "first_signed_in_at", "last_seen_at", "events", "sessions")
    person = F.coalesce("user_id", F.concat(F.lit("anon:"), "source", F.lit(":"), "user_pseudo_id"))
    return named.withColumn("person_id", person).withColumn("person_device_count", F.count("*").over(Window.partitionBy("person_id")))


def _record(prefix: str) -> Column:
    """A traffic source (null unless some field is known)."""
    fields = [F.col(f"{prefix}_{f}") for f in FIELDS]
    return F.when(F.coalesce(*fields).isNotNull(), F.struct(*[c.alias(f) for c, f in zip(fields, FIELDS)]))


def sessions_of(events: DataFrame) -> DataFrame:
    """One row for each session, in one aggregate; sessions cross midnight and are dated by their first event.

    The source at landing is the first page view's, else the earliest before it; a source first seen after the landing is not the session's. Two candidates decide it once
    the time of landing is known: the earliest page view that has a source, if it is the landing, else the earliest event that has one, if it isn't later.
    """
    keys = ["user_pseudo_id", "ga_session_id", "source"]
    at = F.struct("event_timestamp", "event_key")
    first = lambda value: F.min_by(value, F.when(value.isNotNull(), at))
    last = lambda value: F.max_by(value, F.when(value.isNotNull(), at))
    collected, view = _record("collected"), F.col("event_name") == "page_view"
    with_source = F.struct("event_timestamp", "event_key", collected.alias("record"))
    kept = (F.col("event_name") == "purchase") & ~F.coalesce("is_duplicate_purchase", F.lit(False))
    had = lambda name: F.bool_or(F.col("event_name") == name)
    # hardly any two events of a session come from one task: plain rows are shuffled, and sorted once, instead of sorted aggregates of them
    found = events.where("user_pseudo_id IS NOT NULL AND ga_session_id IS NOT NULL").repartition(*keys).groupBy(*keys).agg(
        F.max("ga_session_number").alias("ga_session_number"), F.min_by("event_date", at).alias("session_date"), F.min("event_timestamp").alias("session_start_at"), F.max("event_timestamp").alias("session_end_at"),
        last(F.col("user_id")).alias("session_user_id"), F.count_distinct("user_id").alias("session_user_id_count"), first(_record("last_click")).alias("last_click"),
        F.min(F.when(view, F.col("event_timestamp"))).alias("__landing"), F.min(F.when(view & collected.isNotNull(), with_source)).alias("__viewed"), F.min(F.when(collected.isNotNull(), with_source)).alias("__any"), first(_record("first_user")).alias("first_user"),
        F.coalesce(first(F.when(view, F.col("page_location"))), first(F.col("page_location"))).alias("landing_page"), last(F.col("analytics_storage")).alias("analytics_storage"),
        F.count("*").alias("events"), F.count_if(view).alias("page_views"), F.sum("engagement_time_msec").alias("engagement_time_msec"), F.bool_or(F.coalesce("session_engaged", F.lit(False))).alias("is_engaged"),
        had("view_item").alias("has_view_item"), had("add_to_cart").alias("has_add_to_cart"), had("begin_checkout").alias("has_begin_checkout"), F.count_if(F.col("event_name") == "purchase").alias("purchase_events"),
        F.count_if(kept & ~F.col("is_zero_value_without_id")).alias("orders"), F.count_if(kept & F.col("is_zero_value_without_id")).alias("zero_value_orders"), exact_sum(F.when(kept, F.col("purchase_revenue_usd")), 9).alias("revenue_usd"),
    )
    landing = F.col("__landing")
    at_landing = F.when(F.col("__viewed.event_timestamp") == landing, F.col("__viewed.record")).when(landing.isNull() | (F.col("__any.event_timestamp") <= landing), F.col("__any.record"))
    return found.withColumn("collected", at_landing).drop("__landing", "__viewed", "__any")


@table("""WITH ev AS (
        SELECT *, source || ':' || user_pseudo_id || ':' || ga_session_id AS sk, (event_timestamp, event_key) AS moment, event_name = 'page_view' AS is_view,
            min(event_timestamp) FILTER (event_name = 'page_view') OVER (PARTITION BY source, user_pseudo_id, ga_session_id) AS landing_at
        FROM stg_events WHERE user_pseudo_id IS NOT NULL AND ga_session_id IS NOT NULL
    ), seen AS (
        SELECT sk, any_value(source) AS source, any_value(user_pseudo_id) AS user_pseudo_id, any_value(ga_session_id) AS ga_session_id, max(ga_session_number) = 1 AS is_first, arg_min(event_date, moment) AS session_date,
            min(event_timestamp) AS starts, max(event_timestamp) AS ends, arg_max(user_id, moment) FILTER (user_id IS NOT NULL) AS account, count(DISTINCT user_id) AS accounts,
            arg_min([last_click_source, last_click_medium, last_click_campaign], moment) FILTER (last_click_source IS NOT NULL) AS clicked,
            arg_min([collected_source, collected_medium, collected_campaign], (NOT is_view OR event_timestamp <> landing_at, moment)) FILTER (collected_source IS NOT NULL AND event_timestamp <= coalesce(landing_at, event_timestamp)) AS landed,
            arg_min([first_user_source, first_user_medium, first_user_campaign], moment) FILTER (first_user_source IS NOT NULL) AS begun,
            arg_min(page_location, (NOT is_view, moment)) FILTER (page_location IS NOT NULL) AS landing_page, arg_max(analytics_storage, moment) AS analytics_storage,
            histogram(event_name) AS n, count(*) AS events, sum(engagement_time_msec)::BIGINT AS engagement_time_msec, bool_or(session_engaged) AS is_engaged
        FROM ev GROUP BY sk
    ), claims AS (
        SELECT sk, 1 AS rank, account AS person, account AS user_id, 'session_account' AS rule FROM seen WHERE account IS NOT NULL
        UNION ALL SELECT sk, 2, i.person_id, i.user_id, 'device:' || i.identity_rule FROM seen JOIN int_identity i USING (source, user_pseudo_id)
    ), who AS (SELECT sk, arg_min({person: person, user_id: user_id, rule: rule}, rank) AS w FROM claims GROUP BY sk
    ), paid AS (
        SELECT session_key AS sk, count(*) FILTER (NOT is_zero_value_without_id) AS orders, count(*) FILTER (is_zero_value_without_id) AS zeros, sum(purchase_revenue_usd::DECIMAL(38,9))::DOUBLE AS revenue
        FROM int_purchases WHERE NOT is_duplicate_purchase GROUP BY 1
    ), traffic AS (
        SELECT sk, list_filter([{basis: 'last_click', r: clicked}, {basis: 'collected_at_landing', r: landed}, {basis: 'first_user', r: CASE WHEN is_first THEN begun END}], lambda x: x.r IS NOT NULL)[1] AS t FROM seen
    )
    SELECT s.source, s.sk AS session_key, s.user_pseudo_id, s.ga_session_id, s.session_date, starts AS session_start_at, ends AS session_end_at, epoch_us(ends - starts) / 1e6 AS duration_seconds,
        w.person AS person_id, w.user_id, coalesce(w.rule, 'none') AS identity_rule, accounts AS session_user_id_count, coalesce(t.basis, 'no_source_collected') AS traffic_source_basis,
        coalesce(t.r[1], '(not set)') AS session_source, coalesce(t.r[2], '(not set)') AS session_medium, coalesce(t.r[3], '(not set)') AS session_campaign,
        landing_page, events, coalesce(n['page_view'], 0)::BIGINT AS page_views, engagement_time_msec, is_engaged, analytics_storage, n['view_item'] IS NOT NULL AS has_view_item, n['add_to_cart'] IS NOT NULL AS has_add_to_cart,
        n['begin_checkout'] IS NOT NULL AS has_begin_checkout, coalesce(n['purchase'], 0)::BIGINT AS purchase_events, coalesce(orders, 0) AS orders, coalesce(zeros, 0) AS zero_value_orders, coalesce(orders, 0) > 0 AS converted, revenue AS revenue_usd
    FROM seen s JOIN traffic USING (sk) LEFT JOIN who USING (sk) LEFT JOIN paid USING (sk)""")  # fmt: skip
def fct_sessions(stg_events: DataFrame, int_identity: DataFrame) -> DataFrame:
    """Sessions with their person and their traffic source: the last click's, else the one at landing, else the user's first in a first session."""
    s = with_person(sessions_of(stg_events), int_identity)
    record = F.when(F.col("traffic_source_basis") == "last_click", F.col("last_click")).when(F.col("traffic_source_basis") == "collected_at_landing", F.col("collected")).when(F.col("traffic_source_basis") == "first_user", F.col("first_user"))
    basis = F.when(F.col("last_click").isNotNull(), "last_click").when(F.col("collected").isNotNull(), "collected_at_landing").when((F.col("ga_session_number") == 1) & F.col("first_user").isNotNull(), "first_user").otherwise("no_source_collected")
    s = s.withColumn("traffic_source_basis", basis).withColumn("record", record)
    return s.select("source", F.concat_ws(":", "source", "user_pseudo_id", "ga_session_id").alias("session_key"), "user_pseudo_id", "ga_session_id", "session_date", "session_start_at", "session_end_at",
        (F.expr("timestampdiff(MICROSECOND, session_start_at, session_end_at)") / 1e6).alias("duration_seconds"), "person_id", "user_id", "identity_rule", "session_user_id_count", "traffic_source_basis",
        *[F.coalesce(F.col(f"record.{f}"), F.lit("(not set)")).alias(f"session_{f}") for f in FIELDS],
        "landing_page", "events", "page_views", "engagement_time_msec", "is_engaged", "analytics_storage", "has_view_item", "has_add_to_cart", "has_begin_checkout", "purchase_events", "orders", "zero_value_orders", (F.col("orders") > 0).alias("converted"), "revenue_usd")


def first_claim(*claims: tuple[Column, Column, Column | str]) -> Column:
    """(person, user, rule) of the first claim whose person is known; claims come in the order of their rank."""
    as_column = lambda rule: F.lit(rule) if isinstance(rule, str) else rule
    return F.coalesce(*[F.when(person.isNotNull(), F.struct(person.alias("person"), user.alias("user"), as_column(rule).alias("rule"))) for person, user, rule in claims])


def with_person(sessions: DataFrame, identity: DataFrame) -> DataFrame:
    """Sessions with person_id, user_id and identity_rule: the session's own last account first, then its device's person."""
    device = identity.select("source", "user_pseudo_id", F.col("person_id").alias("__person"), F.col("user_id").alias("__user"), F.concat(F.lit("device:"), "identity_rule").alias("__rule"))
    account, owner = F.col("session_user_id"), F.col("__person")
    claimed = sessions.join(device, ["user_pseudo_id", "source"], "left").withColumn("__claim", first_claim((account, account, "session_account"), (owner, F.col("__user"), F.col("__rule"))))
    named = {"person_id": F.col("__claim.person"), "user_id": F.col("__claim.user"), "identity_rule": F.coalesce("__claim.rule", F.lit("none"))}
    return claimed.withColumns(named).drop("__person", "__user", "__rule", "__claim")


@table("""WITH placed AS (SELECT source, order_id, arg_min(p, (event_timestamp, event_key)) AS buy, count(*) - 1 AS again FROM int_purchases p GROUP BY ALL
    ), claims AS (
        SELECT source, order_id, 1 AS rank, buy.user_id AS person, 'purchase_account' AS rule FROM placed
        UNION ALL SELECT o.source, order_id, 2, s.person_id, s.identity_rule FROM placed o JOIN fct_sessions s ON s.session_key = o.buy.session_key
        UNION ALL SELECT o.source, order_id, 3, d.person_id, 'device' FROM placed o JOIN int_identity d ON d.source = o.source AND d.user_pseudo_id = o.buy.user_pseudo_id
        UNION ALL SELECT source, order_id, 4, 'cookieless:' || source || ':' || order_id, 'no_device' FROM placed
    ), who AS (SELECT source, order_id, arg_min({person: person, rule: rule}, rank) FILTER (person IS NOT NULL) AS w FROM claims GROUP BY ALL)
    SELECT o.source, order_id, buy.transaction_id, buy.transaction_id IS NOT NULL AS has_transaction_id, buy.is_zero_value_without_id, buy.is_transaction_id_collision, buy.event_key AS purchase_event_key, buy.event_date AS order_date,
        buy.event_timestamp AS ordered_at, buy.session_key, v.session_date, buy.user_pseudo_id, w.person AS person_id, w.rule AS identity_rule, v.session_source, v.session_medium, v.session_campaign,
        buy.purchase_revenue_usd AS revenue_usd, buy.tax_usd, buy.shipping_usd, buy.total_item_quantity AS item_quantity, buy.item_count AS line_count, again AS duplicate_purchase_events
    FROM placed o JOIN who USING (source, order_id) LEFT JOIN fct_sessions v ON v.session_key = o.buy.session_key""")  # fmt: skip
def fct_orders(int_purchases: DataFrame, fct_sessions: DataFrame, int_identity: DataFrame) -> DataFrame:
    """One row for each order, its first purchase, with the person who placed it: the account of the purchase, else the session's person, else the device's, else one of its own."""
    row = F.struct(*[c for c in int_purchases.columns if c not in ("source", "order_id")])
    placed = int_purchases.groupBy("order_id", "source").agg(F.min_by(row, F.struct("event_timestamp", "event_key")).alias("buy"), (F.count("*") - 1).alias("duplicate_purchase_events"))
    placed = placed.select("source", "order_id", "duplicate_purchase_events", "buy.*")
    session = fct_sessions.select("session_key", "session_date", F.col("person_id").alias("__visitor"), F.col("identity_rule").alias("__rule"), "session_source", "session_medium", "session_campaign")
    device = int_identity.select("source", "user_pseudo_id", F.col("person_id").alias("__owner"))
    account, visitor, owner, nobody = F.col("user_id"), F.col("__visitor"), F.col("__owner"), F.concat(F.lit("cookieless:"), "source", F.lit(":"), "order_id")
    claim = first_claim((account, account, "purchase_account"), (visitor, account, F.col("__rule")), (owner, account, "device"), (nobody, account, "no_device"))
    found = placed.join(session, "session_key", "left").join(device, ["user_pseudo_id", "source"], "left").withColumn("__claim", claim)
    return found.select(
        "source", "order_id", "transaction_id", F.col("transaction_id").isNotNull().alias("has_transaction_id"), "is_zero_value_without_id", "is_transaction_id_collision", F.col("event_key").alias("purchase_event_key"),
        F.col("event_date").alias("order_date"), F.col("event_timestamp").alias("ordered_at"), "session_key", "session_date", "user_pseudo_id", F.col("__claim.person").alias("person_id"), F.col("__claim.rule").alias("identity_rule"),
        "session_source", "session_medium", "session_campaign", F.col("purchase_revenue_usd").alias("revenue_usd"), "tax_usd", "shipping_usd", F.col("total_item_quantity").alias("item_quantity"), F.col("item_count").alias("line_count"), "duplicate_purchase_events",
    )


@table("""WITH bought AS (SELECT l.source, o.order_id, l.item_index + 1 AS line_number, o.order_date, o.ordered_at, o.person_id, o.session_key, l.item_id, l.item_name, l.item_brand, l.item_variant, l.item_category, l.quantity, l.price_usd AS asked, l.item_revenue_usd AS told FROM stg_items l JOIN fct_orders o ON o.purchase_event_key = l.event_key AND o.source = l.source),
    known AS (SELECT bought.*, coalesce(asked, c.price_usd) AS price_usd, source = 'store_a' AND c.price_usd IS NOT NULL AS ours, CASE WHEN source = 'store_a' THEN c.unit_cost_usd END AS unit_cost FROM bought LEFT JOIN catalog c USING (item_id)),
    priced AS (SELECT *, coalesce(told, price_usd * quantity) AS paid FROM known),
    earned AS (SELECT *, unit_cost * quantity AS spent, paid - unit_cost * quantity AS left_over FROM priced)
    SELECT source, order_id, line_number, order_date, ordered_at, person_id, session_key, item_id, item_name, item_brand, item_variant, item_category, quantity, price_usd, paid AS line_revenue_usd, ours AS is_catalog_product, unit_cost AS unit_cost_usd, round(spent, 2) AS line_cost_usd, round(left_over, 2) AS gross_margin_usd, floor(left_over / nullif(paid, 0) * 10000 + 0.5) / 10000.0 AS gross_margin_rate FROM earned""")  # fmt: skip
def fct_order_items(fct_orders: DataFrame, stg_items: DataFrame, catalog: DataFrame) -> DataFrame:
    """Order lines, at the price that the item was sold for, else the catalog's; cost and margin only where the store's items are the catalog's."""
    lines = fct_orders.select("source", "order_id", "order_date", "ordered_at", "person_id", "session_key", F.col("purchase_event_key").alias("event_key")).join(stg_items.drop("event_date"), ["event_key", "source"])
    listed = lines.join(catalog.select("item_id", F.col("price_usd").alias("__listed"), "unit_cost_usd"), "item_id", "left")
    priced = listed.withColumn("price_usd", F.coalesce("price_usd", "__listed"))
    own = F.col("source") == "store_a"
    revenue, cost = F.col("line_revenue_usd"), F.col("unit_cost_usd") * F.col("quantity")
    rows = priced.select(
        "source", "order_id", (F.col("item_index") + 1).alias("line_number"), "order_date", "ordered_at", "person_id", "session_key", "item_id", "item_name", "item_brand", "item_variant", "item_category", "quantity", "price_usd",
        F.coalesce("item_revenue_usd", F.col("price_usd") * F.col("quantity")).alias("line_revenue_usd"), (own & F.col("__listed").isNotNull()).alias("is_catalog_product"), F.when(own, F.col("unit_cost_usd")).alias("unit_cost_usd"),
    )
    rows = rows.withColumn("__left", revenue - cost)
    return rows.select("*", F.round(cost, 2).alias("line_cost_usd"), F.round("__left", 2).alias("gross_margin_usd"), money_rate("__left", "line_revenue_usd").alias("gross_margin_rate")).drop("__left")


@table("""SELECT date, source, session_source, session_medium, session_campaign, coalesce(sessions, 0)::BIGINT AS sessions, coalesce(engaged_sessions, 0)::BIGINT AS engaged_sessions, coalesce(orders, 0)::BIGINT AS orders, coalesce(revenue_usd, 0) AS revenue_usd, cost_usd,
    floor(coalesce(revenue_usd, 0) / nullif(cost_usd, 0) * 10000 + 0.5) / 10000.0 AS roas, floor(cost_usd / nullif(orders, 0) * 100 + 0.5) / 100.0 AS cost_per_order FROM
    (SELECT session_date AS date, source, session_source, session_medium, session_campaign, count(*) AS sessions, count(*) FILTER (is_engaged) AS engaged_sessions, sum(orders) AS orders, coalesce(sum(revenue_usd::DECIMAL(38,9))::DOUBLE, 0) AS revenue_usd FROM fct_sessions GROUP BY ALL) s
    FULL JOIN (SELECT cost_date AS date, c.source, session_source, session_medium, session_campaign, sum(cost_usd::DECIMAL(38,9))::DOUBLE AS cost_usd FROM campaign_costs c JOIN (SELECT source, min(session_date) AS a, max(session_date) AS b FROM fct_sessions GROUP BY 1) v ON v.source = c.source AND cost_date BETWEEN a AND b GROUP BY ALL) c
    USING (date, source, session_source, session_medium, session_campaign)""")  # fmt: skip
def mart_campaign_daily(fct_sessions: DataFrame, campaign_costs: DataFrame) -> DataFrame:
    """Sessions and spend of each campaign and day, those without the other included; spend only on days that have sessions' dates around them."""
    keys = ["date", "source", "session_source", "session_medium", "session_campaign"]
    s = fct_sessions.withColumnRenamed("session_date", "date").groupBy(*keys).agg(F.count("*").alias("sessions"), F.count_if("is_engaged").alias("engaged_sessions"), F.sum("orders").alias("orders"), exact_sum(F.col("revenue_usd"), 9).alias("revenue_usd"))
    span = fct_sessions.groupBy("source").agg(F.min("session_date").alias("a"), F.max("session_date").alias("b"))
    c = campaign_costs.withColumnRenamed("cost_date", "date").join(F.broadcast(span), "source").where("date BETWEEN a AND b").groupBy(*keys).agg(exact_sum(F.col("cost_usd"), 9).alias("cost_usd"))
    j = s.join(c, keys, "full").fillna(0, ["sessions", "engaged_sessions", "orders", "revenue_usd"])
    return j.select(*keys, "sessions", "engaged_sessions", "orders", "revenue_usd", "cost_usd", money_rate("revenue_usd", "cost_usd").alias("roas"), money_rate("cost_usd", "orders", 2).alias("cost_per_order"))


@table("""SELECT *, round(view_item_sessions / nullif(sessions, 0), 4) AS view_item_rate, round(add_to_cart_sessions / nullif(view_item_sessions, 0), 4) AS add_to_cart_rate, round(begin_checkout_sessions / nullif(add_to_cart_sessions, 0), 4) AS begin_checkout_rate,
    round(purchase_sessions / nullif(begin_checkout_sessions, 0), 4) AS purchase_rate, round(converted_sessions / nullif(sessions, 0), 4) AS session_conversion_rate FROM (
    SELECT session_date AS date, source, count(*) AS sessions, count(*) FILTER (has_view_item) AS view_item_sessions, count(*) FILTER (has_view_item AND has_add_to_cart) AS add_to_cart_sessions, count(*) FILTER (has_view_item AND has_add_to_cart AND has_begin_checkout) AS begin_checkout_sessions,
    count(*) FILTER (has_view_item AND has_add_to_cart AND has_begin_checkout AND converted) AS purchase_sessions, count(*) FILTER (converted) AS converted_sessions FROM fct_sessions GROUP BY 1, 2)""")  # fmt: skip
def mart_funnel_daily(fct_sessions: DataFrame) -> DataFrame:
    """A closed funnel: a session counts at a step only if it has all earlier ones."""
    steps, so_far, aggs = ("view_item", "add_to_cart", "begin_checkout"), F.lit(True), []
    for step in steps:
        so_far = so_far & F.col(f"has_{step}")
        aggs.append(F.count_if(so_far).alias(f"{step}_sessions"))
    days = fct_sessions.groupBy(F.col("session_date").alias("date"), "source").agg(F.count("*").alias("sessions"), *aggs, F.count_if(so_far & F.col("converted")).alias("purchase_sessions"), F.count_if("converted").alias("converted_sessions"))
    pairs = {"view_item_rate": ("view_item_sessions", "sessions"), "add_to_cart_rate": ("add_to_cart_sessions", "view_item_sessions"), "begin_checkout_rate": ("begin_checkout_sessions", "add_to_cart_sessions"), "purchase_rate": ("purchase_sessions", "begin_checkout_sessions"), "session_conversion_rate": ("converted_sessions", "sessions")}
    return days.select("*", *[rate(a, b).alias(n) for n, (a, b) in pairs.items()])


@table("""SELECT date, source, coalesce(s.sessions, 0)::BIGINT AS sessions, coalesce(s.engaged_sessions, 0)::BIGINT AS engaged_sessions, round(s.engaged_sessions / nullif(s.sessions, 0), 6) AS engaged_session_rate, coalesce(s.converted_sessions, 0)::BIGINT AS converted_sessions, round(s.converted_sessions / nullif(s.sessions, 0), 6) AS conversion_rate,
    coalesce(s.add_to_cart_sessions, 0)::BIGINT AS add_to_cart_sessions, round(s.add_to_cart_sessions / nullif(s.sessions, 0), 6) AS add_to_cart_rate, coalesce(s.checkout_sessions, 0)::BIGINT AS checkout_sessions, round(s.checkout_converted / nullif(s.checkout_sessions, 0), 6) AS checkout_to_purchase_rate,
    coalesce(o.orders, 0)::BIGINT AS orders, coalesce(o.revenue_usd, 0) AS revenue_usd, floor(o.revenue_usd / nullif(o.orders, 0) * 100 + 0.5) / 100.0 AS aov_usd, coalesce(o.cookieless_orders, 0)::BIGINT AS cookieless_orders, round(o.cookieless_orders / nullif(o.orders, 0), 6) AS cookieless_order_share, c.events, c.consented_events, round(c.consented_events / nullif(c.events, 0), 6) AS consent_accept_share
    FROM (SELECT session_date AS date, source, count(*) AS sessions, count(*) FILTER (is_engaged) AS engaged_sessions, count(*) FILTER (converted) AS converted_sessions, count(*) FILTER (has_add_to_cart) AS add_to_cart_sessions, count(*) FILTER (has_begin_checkout) AS checkout_sessions, count(*) FILTER (has_begin_checkout AND converted) AS checkout_converted FROM fct_sessions GROUP BY 1, 2) s
    FULL JOIN (SELECT order_date AS date, source, count(*) FILTER (NOT is_zero_value_without_id) AS orders, sum(CASE WHEN NOT is_zero_value_without_id THEN revenue_usd::DECIMAL(38,9) END)::DOUBLE AS revenue_usd, count(*) FILTER (NOT is_zero_value_without_id AND session_key IS NULL) AS cookieless_orders FROM fct_orders GROUP BY 1, 2) o USING (date, source)
    FULL JOIN (SELECT event_date AS date, source, count(*) AS events, count(*) FILTER (analytics_storage = 'Yes') AS consented_events FROM stg_events GROUP BY 1, 2) c USING (date, source)""")  # fmt: skip
def mart_kpi_daily(fct_sessions: DataFrame, fct_orders: DataFrame, stg_events: DataFrame) -> DataFrame:
    on = ["date", "source"]
    count = lambda c, n: F.count_if(c).alias(n)
    s = fct_sessions.groupBy(F.col("session_date").alias("date"), "source").agg(F.count("*").alias("sessions"), count("is_engaged", "engaged_sessions"), count("converted", "converted_sessions"), count("has_add_to_cart", "add_to_cart_sessions"), count("has_begin_checkout", "checkout_sessions"), count(F.col("has_begin_checkout") & F.col("converted"), "checkout_converted"))
    real = ~F.col("is_zero_value_without_id")
    o = fct_orders.groupBy(F.col("order_date").alias("date"), "source").agg(count(real, "orders"), exact_sum(F.when(real, F.col("revenue_usd")), 9).alias("revenue_usd"), count(real & F.col("session_key").isNull(), "cookieless_orders"))
    c = stg_events.groupBy(F.col("event_date").alias("date"), "source").agg(F.count("*").alias("events"), count(F.col("analytics_storage") == "Yes", "consented_events"))
    zero = lambda n: F.coalesce(F.col(n), F.lit(0)).alias(n)
    j = s.join(o, on, "full").join(c, on, "full")
    return j.select(*on, zero("sessions"), zero("engaged_sessions"), rate("engaged_sessions", "sessions", 6).alias("engaged_session_rate"), zero("converted_sessions"), rate("converted_sessions", "sessions", 6).alias("conversion_rate"), zero("add_to_cart_sessions"), rate("add_to_cart_sessions", "sessions", 6).alias("add_to_cart_rate"),
        zero("checkout_sessions"), rate("checkout_converted", "checkout_sessions", 6).alias("checkout_to_purchase_rate"), zero("orders"), zero("revenue_usd"), money_rate("revenue_usd", "orders", 2).alias("aov_usd"), zero("cookieless_orders"), rate("cookieless_orders", "orders", 6).alias("cookieless_order_share"), "events", "consented_events", rate("consented_events", "events", 6).alias("consent_accept_share"))


# --- queries ---------------------------------------------------------------------------------------

query("i01_identity", "SELECT source, user_pseudo_id, person_id, identity_rule, user_id, user_id_count, first_seen_at, first_signed_in_at, last_seen_at, events, sessions FROM int_identity")(lambda int_identity: int_identity.drop("person_device_count"))
query("i02_person_size", "SELECT DISTINCT person_id, person_device_count FROM int_identity")(lambda int_identity: int_identity.select("person_id", "person_device_count").distinct())
query("i03_sessions", "SELECT session_key, session_date, session_start_at, session_end_at, duration_seconds, landing_page FROM fct_sessions")(lambda fct_sessions: fct_sessions.select("session_key", "session_date", "session_start_at", "session_end_at", "duration_seconds", "landing_page"))
query("i05_traffic_source", "SELECT session_key, traffic_source_basis, session_source, session_medium, session_campaign FROM fct_sessions")(lambda fct_sessions: fct_sessions.select("session_key", "traffic_source_basis", "session_source", "session_medium", "session_campaign"))
query("i06_session_person", "SELECT session_key, person_id, user_id, identity_rule, session_user_id_count FROM fct_sessions")(lambda fct_sessions: fct_sessions.select("session_key", "person_id", "user_id", "identity_rule", "session_user_id_count"))
query("i07_session_metrics", "SELECT session_key, events, page_views, engagement_time_msec, is_engaged, analytics_storage, has_view_item, has_add_to_cart, has_begin_checkout, purchase_events, orders, zero_value_orders, converted, revenue_usd FROM fct_sessions")(
    lambda fct_sessions: fct_sessions.select("session_key", "events", "page_views", "engagement_time_msec", "is_engaged", "analytics_storage", "has_view_item", "has_add_to_cart", "has_begin_checkout", "purchase_events", "orders", "zero_value_orders", "converted", "revenue_usd")
)
whole_table("i08_orders", "fct_orders")
whole_table("i09_order_items", "fct_order_items")
whole_table("i10_campaign_mart", "mart_campaign_daily")
whole_table("i11_funnel", "mart_funnel_daily")
whole_table("i12_kpi_mart", "mart_kpi_daily")
query("i15_catalog_cost", "SELECT item_id, unit_cost_usd FROM catalog")(lambda catalog: catalog.select("item_id", "unit_cost_usd"))


@query("i04_landing_source", """SELECT session_key, arg_min(collected_source, (NOT (event_name = 'page_view' AND event_timestamp = landing_at), event_timestamp, event_key)) FILTER (collected_source IS NOT NULL AND (landing_at IS NULL OR event_timestamp <= landing_at)) AS landing_source
    FROM (SELECT *, min(CASE WHEN event_name = 'page_view' THEN event_timestamp END) OVER (PARTITION BY session_key) AS landing_at FROM stg_events WHERE session_key IS NOT NULL) GROUP BY 1""")  # fmt: skip
def landing_source(stg_events: DataFrame) -> DataFrame:
    return sessions_of(stg_events).select(F.concat_ws(":", "source", "user_pseudo_id", "ga_session_id").alias("session_key"), F.col("collected.source").alias("landing_source"))
