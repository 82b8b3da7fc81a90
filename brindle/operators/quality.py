"""Data-quality checks: each gives the rows that violate it, and none when all is well.

The registered queries run them over tables in which the given data, or a stated fault, has violations to find.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.operators.folds import ordered_fold
from brindle.operators.staging import EMAIL
from brindle.registry import query, table, whole_table


def violations(df: DataFrame, key: str, rules: dict[str, str]) -> DataFrame:
    """(rule, key): rows for which a rule's condition isn't true, null included. One pass for all rules."""
    bad = F.array(*[F.when(F.expr(f"NOT coalesce({condition}, false)"), F.lit(name)) for name, condition in rules.items()])
    return df.select(F.explode(F.array_compact(bad)).alias("rule"), F.col(key).cast("string").alias("key"))


@query("j01_constraints", """SELECT * FROM (SELECT 'received_within_ordered' AS rule, count(*) AS n FROM purchase_order_items WHERE NOT quantity_received * 2 <= quantity_ordered UNION ALL SELECT 'positive_stock', count(*) FROM stock_levels WHERE NOT quantity > 0
    UNION ALL SELECT 'email_shape', count(*) FROM suppliers WHERE NOT contact_email LIKE '%00_@%' UNION ALL SELECT 'status_domain', count(*) FROM purchase_orders WHERE status NOT IN ('PLACED', 'RECEIVED', 'PARTIALLY_RECEIVED') UNION ALL SELECT 'price_above_cost', count(*) FROM products WHERE NOT unit_price < 1000) WHERE n > 0""")  # fmt: skip
def constraints(purchase_order_items: DataFrame, stock_levels: DataFrame, suppliers: DataFrame, purchase_orders: DataFrame, products: DataFrame) -> DataFrame:
    """Declared rules that Spark doesn't enforce, counted by rule; some are set so tight that the given data breaks them."""
    every = violations(purchase_order_items, "po_id", {"received_within_ordered": "quantity_received * 2 <= quantity_ordered"})
    every = every.union(violations(stock_levels, "product_id", {"positive_stock": "quantity > 0"})).union(violations(suppliers, "supplier_id", {"email_shape": "contact_email LIKE '%00_@%'"}))
    every = every.union(violations(purchase_orders, "po_id", {"status_domain": "status IN ('PLACED', 'RECEIVED', 'PARTIALLY_RECEIVED')"})).union(violations(products, "product_id", {"price_above_cost": "unit_price < 1000"}))
    return every.groupBy("rule").agg(F.count("*").alias("n"))


def orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str | None = None) -> DataFrame:
    """Rows whose key the parent lacks; a null key is no violation."""
    keys = parent.select(F.col(parent_key or key).alias(key)).distinct()
    return child.where(F.col(key).isNotNull()).join(keys, key, "left_anti")


@query("j02_foreign_keys", "SELECT 'orders.o_custkey' AS reference, o_custkey AS key, count(*) AS rows FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 20) GROUP BY 2")
def order_customers(orders: DataFrame, customer: DataFrame) -> DataFrame:
    lost = orphans(orders, customer.where("c_nationkey < 20"), "o_custkey", "c_custkey")
    return lost.groupBy(F.lit("orders.o_custkey").alias("reference"), F.col("o_custkey").alias("key")).agg(F.count("*").alias("rows"))


def key_problems(df: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """(table, problem, n): how many keys are repeated, and how many rows have a null in their key."""
    null = F.lit(False)
    for k in keys:
        null = null | F.col(k).isNull()
    per = df.withColumn("__null", null).groupBy("__null", *keys).agg(F.count("*").alias("__n"))
    counts = per.agg(F.count_if(~F.col("__null") & (F.col("__n") > 1)).alias("repeated key"), F.coalesce(F.sum(F.when(F.col("__null"), F.col("__n"))), F.lit(0)).alias("null in key"))
    return counts.withColumn("table", F.lit(name)).unpivot("table", ["repeated key", "null in key"], "problem", "n").where("n > 0")


@query("j03_keys", """SELECT 'lineitem' AS "table", 'repeated key' AS problem, count(*) AS n FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) UNION ALL SELECT 'stg_events', 'null in key', count(*) FROM stg_events WHERE session_key IS NULL
    UNION ALL SELECT 'stg_events', 'repeated key', count(*) FROM (SELECT 1 FROM stg_events WHERE session_key IS NOT NULL GROUP BY session_key HAVING count(*) > 1)""")  # fmt: skip
def keys(lineitem: DataFrame, stg_events: DataFrame, purchase_orders: DataFrame) -> DataFrame:
    """Of three tables, of which purchase orders are clean."""
    return key_problems(lineitem, "lineitem", ["l_orderkey", "l_linenumber"]).union(key_problems(stg_events, "stg_events", ["session_key"])).union(key_problems(purchase_orders, "purchase_orders", ["po_id"]))


@query("j04_orders_linked", "SELECT order_id, CASE WHEN session_key IS NULL THEN 'no session' ELSE 'session unknown' END AS problem FROM fct_orders o WHERE session_key IS NULL OR session_key NOT IN (SELECT session_key FROM fct_sessions WHERE session_date <> DATE '2024-01-15')")
def orders_linked(fct_orders: DataFrame, fct_sessions: DataFrame) -> DataFrame:
    """Against sessions of which one day is missing."""
    known = fct_sessions.where("session_date <> DATE'2024-01-15'").select("session_key", F.lit(True).alias("known"))
    return fct_orders.join(known, "session_key", "left").where("known IS NULL").select("order_id", F.when(F.col("session_key").isNull(), "no session").otherwise("session unknown").alias("problem"))


def reconciled(a: DataFrame, b: DataFrame, on: list[str], values: list[str], tolerance: float = 0.005) -> DataFrame:
    """Keys at which two tables' values differ by more than the tolerance, or that only one has."""
    left, right = a.select(*on, *[F.col(v).alias(f"{v}_a") for v in values]), b.select(*on, *[F.col(v).alias(f"{v}_b") for v in values])
    differs = F.lit(False)
    for v in values:
        x, y = F.col(f"{v}_a").cast("double"), F.col(f"{v}_b").cast("double")
        differs = differs | ~F.coalesce(F.abs(x - y) <= tolerance, x.isNull() & y.isNull())
    return left.join(right, on, "full").where(differs)


@query("j05_layers_reconcile", "SELECT source, a.orders AS orders_a, b.orders AS orders_b FROM (SELECT source, count(*) FILTER (NOT is_duplicate_purchase) AS orders FROM int_purchases GROUP BY 1) a JOIN (SELECT source, count(*) AS orders FROM fct_orders WHERE session_key IS NOT NULL GROUP BY 1) b USING (source) WHERE a.orders <> b.orders")
def layers_reconcile(int_purchases: DataFrame, fct_orders: DataFrame) -> DataFrame:
    """Orders of the staged purchases against those that have a session: cookieless ones are the difference."""
    a = int_purchases.where("NOT is_duplicate_purchase").groupBy("source").agg(F.count("*").alias("orders"))
    b = fct_orders.where("session_key IS NOT NULL").groupBy("source").agg(F.count("*").alias("orders"))
    return reconciled(a, b, ["source"], ["orders"])


@query("j06_funnel_monotonic", "SELECT date, source FROM mart_funnel_daily WHERE NOT (sessions >= view_item_sessions AND view_item_sessions >= add_to_cart_sessions AND add_to_cart_sessions >= converted_sessions)")
def funnel_monotonic(mart_funnel_daily: DataFrame) -> DataFrame:
    """Steps of a closed funnel never rise; conversions outside it may, and do."""
    return mart_funnel_daily.where("NOT (sessions >= view_item_sessions AND view_item_sessions >= add_to_cart_sessions AND add_to_cart_sessions >= converted_sessions)").select("date", "source")


@query("j07_row_accounting", "SELECT source, sum(export_row_count)::BIGINT AS exported, count(*) AS staged, sum(export_row_count - 1)::BIGINT AS duplicates, sum(export_row_count) = count(*) + sum(export_row_count - 1) AS balanced FROM flat_events GROUP BY 1")
def row_accounting(web_export: DataFrame, flat_events: DataFrame) -> DataFrame:
    exported = web_export.groupBy("source").agg(F.count("*").alias("exported"))
    staged = flat_events.groupBy("source").agg(F.count("*").alias("staged"), F.sum(F.col("export_row_count") - 1).alias("duplicates"))
    return exported.join(staged, "source").select("source", "exported", "staged", "duplicates", (F.col("exported") == F.col("staged") + F.col("duplicates")).alias("balanced"))


@query("j08_sessions_cover_events", "SELECT source, count(*) FILTER (session_key IS NULL) AS outside, count(*) AS events, (SELECT sum(events) FROM fct_sessions s WHERE s.source = e.source)::BIGINT AS in_sessions FROM stg_events e GROUP BY 1")
def sessions_cover_events(stg_events: DataFrame, fct_sessions: DataFrame) -> DataFrame:
    a = stg_events.groupBy("source").agg(F.count_if(F.col("session_key").isNull()).alias("outside"), F.count("*").alias("events"))
    return a.join(fct_sessions.groupBy("source").agg(F.sum("events").alias("in_sessions")), "source")


@query("j09_identity_invariants", "SELECT 'shared with one account' AS rule, count(*) AS n FROM int_identity WHERE identity_rule = 'shared_device' AND NOT coalesce(user_id_count > 2, false) UNION ALL SELECT 'account missing', count(*) FROM int_identity WHERE user_id IS NULL")
def identity_invariants(int_identity: DataFrame) -> DataFrame:
    """Conditions that are null count as broken; both rules are tighter than what holds."""
    rules = {"shared with one account": "identity_rule <> 'shared_device' OR user_id_count > 2", "account missing": "user_id IS NOT NULL"}
    return violations(int_identity, "user_pseudo_id", rules).groupBy("rule").agg(F.count("*").alias("n"))


def pii_counts(df: DataFrame, columns: list[str], pattern: str = EMAIL) -> DataFrame:
    """(column, rows): how many values of each column look like an e-mail address; never the values."""
    counts = df.agg(*[F.count_if(F.col(f"`{c}`").rlike(pattern)).alias(c) for c in columns])
    return counts.unpivot([], columns, "column", "rows")


@query("j10_pii_scan", f"""SELECT 'text' AS "column", count(*) FILTER (regexp_matches(text, '{EMAIL}')) AS rows FROM documents UNION ALL SELECT 'source', count(*) FILTER (regexp_matches(source, '{EMAIL}')) FROM documents""")
def documents_pii(documents: DataFrame) -> DataFrame:
    return pii_counts(documents, ["text", "source"])


@query("j11_synthetic_flagged", "SELECT supplier_id, contact_email FROM suppliers WHERE contact_email LIKE '%.example' AND NOT is_active")
def synthetic_flagged(suppliers: DataFrame) -> DataFrame:
    """Rows that look made up and lack the flag that says so."""
    return suppliers.where("contact_email LIKE '%.example' AND NOT is_active").select("supplier_id", "contact_email")


@query("j12_kpi_reconciles", "SELECT date, source, k.orders AS orders_a, o.n AS orders_b FROM mart_kpi_daily k FULL JOIN (SELECT order_date AS date, source, count(*) AS n FROM fct_orders GROUP BY 1, 2) o USING (date, source) WHERE k.orders IS DISTINCT FROM o.n")
def kpi_reconciles(mart_kpi_daily: DataFrame, fct_orders: DataFrame) -> DataFrame:
    """Against all orders, zero-value ones included, which the mart leaves out."""
    return reconciled(mart_kpi_daily, fct_orders.groupBy(F.col("order_date").alias("date"), "source").agg(F.count("*").alias("orders")), ["date", "source"], ["orders"])


# --- the contract ---------------------------------------------------------------------------------


@dataclass(frozen=True)
class FieldRule:
    """What an event must hold. kind: required, format (a pattern, a length, listed values), or value_math (bounds and steps of a number)."""

    event: str
    kind: str
    field: str
    condition: str = ""  # SQL that holds for a good value; MATCHES stands for the engine's regular expression test

    @property
    def name(self) -> str:
        return f"{self.kind}:{self.field}"

    def violated(self, matches: str = "regexp_like") -> str:
        if self.kind == "required":
            return f"({self.field} IS NULL)"
        return f"({self.field} IS NOT NULL AND NOT ({self.condition.replace('MATCHES', matches)}))"


#: A JSON schema of each event: what its fields must be.
CONTRACT_SCHEMA = """{
  "purchase": {
    "required": ["transaction_id"],
    "properties": {
      "transaction_id": {"type": "string", "minLength": 1, "maxLength": 5},
      "purchase_revenue_usd": {"type": "number", "exclusiveMinimum": 0, "exclusiveMaximum": 200},
      "currency": {"type": "string", "pattern": "^[A-Z]{3}$", "enum": ["USD"]},
      "shipping_usd": {"type": "number", "minimum": 0, "multipleOf": 0.01}
    }
  },
  "login": {"required": ["user_id", "method"], "properties": {"method": {"enum": ["password", "link"]}}},
  "page_view": {"required": ["collected_source", "page_title"], "properties": {"page_location": {"type": "string", "pattern": "^https://"}}},
  "view_item": {"required": ["user_pseudo_id", "item_list_id"]}
}"""


def _value(v) -> str:
    return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)


def field_conditions(field: str, spec: dict) -> list[tuple[str, str]]:
    """(kind, condition) for what a JSON schema says of one field: its text in one check, its number in another."""
    text = {
        "minLength": lambda v: f"length({field}) >= {v}",
        "maxLength": lambda v: f"length({field}) <= {v}",
        "pattern": lambda v: f"MATCHES({field}, {_value(v)})",
        "enum": lambda v: f"{field} IN ({', '.join(map(_value, v))})",
        "const": lambda v: f"{field} = {_value(v)}",
    }
    number = {
        "minimum": lambda v: f"{field} >= {v}",
        "maximum": lambda v: f"{field} <= {v}",
        "exclusiveMinimum": lambda v: f"{field} > {v}",
        "exclusiveMaximum": lambda v: f"{field} < {v}",
        "multipleOf": lambda v: f"abs({field} / {v} - round({field} / {v})) < 1e-6",
    }
    unknown = set(spec) - set(text) - set(number) - {"type", "description"}
    if unknown:
        raise ValueError(f"the contract says {sorted(unknown)} of {field}, which is not known here")
    found = [(kind, " AND ".join(says[k](v) for k, v in spec.items() if k in says)) for kind, says in (("format", text), ("value_math", number))]
    return [(kind, condition) for kind, condition in found if condition]


def rules_of(schema: str) -> tuple[FieldRule, ...]:
    """The checks that a contract asks for: each required field, and each field's text and number."""
    rules = []
    for event, spec in json.loads(schema).items():
        rules += [FieldRule(event, "required", field) for field in spec.get("required", ())]
        rules += [FieldRule(event, kind, field, condition) for field, says in spec.get("properties", {}).items() for kind, condition in field_conditions(field, says)]
    return tuple(rules)


CONTRACT = rules_of(CONTRACT_SCHEMA)
CONTRACT_SOURCES = ("store_a",)
#: (source, event pattern, check pattern, reason): violations that are known and accepted.
EXPECTATIONS = (("store_b", "%", "required:%", "not tagged to the contract"), ("store_a", "(session)", "attribution:%", "sessions without a source"), ("store_b", "(session)", "attribution:%", "sessions without a source"))


def contract_checks(rules=CONTRACT) -> Column:
    """An array with a struct (check_name, check_kind, field, violated) for each rule of a row's event."""
    row = lambda r: F.struct(F.lit(r.name).alias("check_name"), F.lit(r.kind).alias("check_kind"), F.lit(r.field).alias("field"), F.expr(r.violated()).alias("violated"))
    return F.array_compact(F.array(*[F.when(F.col("event_name") == r.event, row(r)) for r in rules]))


_CHECKS_SQL = " UNION ALL ".join(f"SELECT event_date AS date, source, event_name, '{r.name}' AS check_name, '{r.kind}' AS check_kind, '{r.field}' AS field, {r.violated('regexp_matches')} AS violated, event_key FROM stg_events WHERE event_name = '{r.event}'" for r in CONTRACT)


@query("j18_contract_checks", f"SELECT event_key, check_name, violated FROM ({_CHECKS_SQL})")
def checked_events(stg_events: DataFrame) -> DataFrame:
    return stg_events.select("event_key", F.inline(contract_checks())).select("event_key", "check_name", "violated")


@table(f"""SELECT c.date, c.source, event_name, check_name, check_kind, field, events, violations, round(violations / events, 6) AS violation_rate, CASE WHEN violations = 0 THEN 'pass' WHEN reason IS NOT NULL THEN 'expected' ELSE 'violation' END AS status, CASE WHEN violations > 0 THEN reason END AS expectation FROM (
    SELECT date, source, event_name, check_name, check_kind, field, count(*) AS events, count(*) FILTER (violated) AS violations FROM ({_CHECKS_SQL}) WHERE check_kind = 'required' OR source = 'store_a' GROUP BY ALL
    UNION ALL SELECT event_date, source, event_name, 'pii:email', 'pii', 'page_location', count(*), count(*) FILTER (regexp_matches(page_location, '{EMAIL}')) FROM stg_events GROUP BY 1, 2, 3
    UNION ALL SELECT event_date, source, event_name, 'dedupe:duplicate_transaction_id', 'dedupe', 'transaction_id', count(*), count(*) FILTER (is_duplicate_purchase) FROM stg_events WHERE event_name = 'purchase' GROUP BY 1, 2, 3
    UNION ALL SELECT event_date, source, event_name, 'dedupe:transaction_id_collision', 'dedupe', 'transaction_id', count(*), count(*) FILTER (is_transaction_id_collision) FROM stg_events WHERE event_name = 'purchase' GROUP BY 1, 2, 3
    UNION ALL SELECT session_date, source, '(session)', 'attribution:source_not_set', 'attribution', 'session_source', count(*), count(*) FILTER (session_source = '(not set)') FROM fct_sessions GROUP BY 1, 2
    UNION ALL SELECT session_date, source, '(session)', 'attribution:source_obfuscated', 'attribution', 'session_source, session_medium', count(*), sum(len(list_intersect(['<Other>', '(data deleted)'], [session_source, session_medium])) > 0)::BIGINT FROM fct_sessions GROUP BY 1, 2) c
    LEFT JOIN (VALUES {', '.join(str(e) for e in EXPECTATIONS)}) x(source, event_pattern, check_pattern, reason) ON x.source = c.source AND event_name LIKE event_pattern AND check_name LIKE check_pattern""")  # fmt: skip
def mart_tag_health_daily(stg_events: DataFrame, fct_sessions: DataFrame) -> DataFrame:
    """How many events of each day pass each check. All checks of an event come from one pass: its contract rules, and the other families as further entries of the same array."""
    entry = lambda name, kind, field, bad: F.struct(F.lit(name).alias("check_name"), F.lit(kind).alias("check_kind"), F.lit(field).alias("field"), F.coalesce(bad, F.lit(False)).alias("violated"))
    bought = F.col("event_name") == "purchase"
    contract = F.filter(contract_checks(), lambda c: (c["check_kind"] == "required") | F.col("source").isin(*CONTRACT_SOURCES))
    more = F.array_compact(F.array(entry("pii:email", "pii", "page_location", F.col("page_location").rlike(EMAIL)), F.when(bought, entry("dedupe:duplicate_transaction_id", "dedupe", "transaction_id", F.col("is_duplicate_purchase"))), F.when(bought, entry("dedupe:transaction_id_collision", "dedupe", "transaction_id", F.col("is_transaction_id_collision")))))
    of_events = stg_events.select(F.col("event_date").alias("date"), "source", "event_name", F.inline(F.concat(contract, more)))
    hidden = F.arrays_overlap(F.array("session_source", "session_medium"), F.array(F.lit("<Other>"), F.lit("(data deleted)")))
    of_sessions = fct_sessions.select(F.col("session_date").alias("date"), "source", F.lit("(session)").alias("event_name"), F.inline(F.array(entry("attribution:source_not_set", "attribution", "session_source", F.col("session_source") == "(not set)"), entry("attribution:source_obfuscated", "attribution", "session_source, session_medium", hidden))))
    counts = of_events.unionByName(of_sessions).groupBy("date", "source", "event_name", "check_name", "check_kind", "field").agg(F.count("*").alias("events"), F.count_if("violated").alias("violations"))
    rules = counts.sparkSession.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(e, ("x_source", "event_pattern", "check_pattern", "reason"))]) for e in EXPECTATIONS])))
    known = counts.join(F.broadcast(rules), (F.col("source") == F.col("x_source")) & F.expr("event_name LIKE event_pattern AND check_name LIKE check_pattern"), "left")
    status = F.when(F.col("violations") == 0, "pass").when(F.col("reason").isNotNull(), "expected").otherwise("violation")
    return known.select("date", "source", "event_name", "check_name", "check_kind", "field", "events", "violations", F.round(F.col("violations") / F.col("events"), 6).alias("violation_rate"), status.alias("status"), F.when(F.col("violations") > 0, F.col("reason")).alias("expectation"))


whole_table("i13_tag_health", "mart_tag_health_daily")


@query("j13_tag_health_coverage", "SELECT date, source, event_name, sum(events)::BIGINT AS checked, max(n) AS present FROM mart_tag_health_daily m JOIN (SELECT event_date AS date, source, event_name, count(*) AS n FROM stg_events GROUP BY 1, 2, 3) e USING (date, source, event_name) WHERE check_kind <> 'pii' GROUP BY 1, 2, 3 HAVING sum(events) <> max(n) * 2")
def tag_health_coverage(mart_tag_health_daily: DataFrame, stg_events: DataFrame) -> DataFrame:
    """Event days that weren't checked exactly twice by rules other than the scan for personal data."""
    present = stg_events.groupBy(F.col("event_date").alias("date"), "source", "event_name").agg(F.count("*").alias("present"))
    checked = mart_tag_health_daily.where("check_kind <> 'pii'").groupBy("date", "source", "event_name").agg(F.sum("events").alias("checked"))
    return checked.join(present, ["date", "source", "event_name"]).where("checked <> present * 2")


@query("j14_weights_sum", "SELECT source, order_id, model, round(sum(weight), 6) AS weight FROM fct_attribution WHERE touches <> 5 OR position <> 2 GROUP BY 1, 2, 3 HAVING abs(sum(weight) - 1) > 1e-6")
def weights_sum(fct_attribution: DataFrame) -> DataFrame:
    """On an attribution that lacks the second touch of five."""
    per = fct_attribution.where("touches <> 5 OR position <> 2").groupBy("order_id", "source", "model").agg(F.sum("weight").alias("w"))
    return per.where("abs(w - 1) > 1e-6").select("source", "order_id", "model", F.round("w", 6).alias("weight"))


@query("j15_revenue_conserved", "SELECT model, round(sum(weight * revenue), 2) AS attributed, (SELECT round(sum(revenue), 2) FROM attributable_orders) AS placed FROM fct_attribution GROUP BY 1")
def revenue_conserved(fct_attribution: DataFrame, attributable_orders: DataFrame) -> DataFrame:
    placed = F.broadcast(attributable_orders.agg(F.round(F.sum(F.col("revenue").cast("decimal(38,9)")).cast("double"), 2).alias("placed")))
    given = fct_attribution.groupBy("model").agg(F.round(F.sum(F.round(F.col("weight") * F.col("revenue"), 9).cast("decimal(38,9)")).cast("double"), 2).alias("attributed"))
    return given.crossJoin(placed)


@query("j16_last_click_matches", "SELECT o.source, o.order_id FROM fct_orders o JOIN fct_attribution a ON a.source = o.source AND a.order_id = o.order_id AND model = 'last_click' AND weight = 1 WHERE a.session_source IS DISTINCT FROM o.session_source OR a.session_source = 'ads'")
def last_click_matches(fct_orders: DataFrame, fct_attribution: DataFrame) -> DataFrame:
    """Orders whose last click isn't their session's source, or is one that mustn't occur."""
    last = fct_attribution.where("model = 'last_click' AND weight = 1").select("source", "order_id", F.col("session_source").alias("clicked"))
    return fct_orders.join(last, ["source", "order_id"]).where(~F.col("clicked").eqNullSafe(F.col("session_source")) | (F.col("clicked") == "ads")).select("source", "order_id")


@query("j17_check_runner", "SELECT 'funnel_monotonic' AS check_name, (SELECT count(*) FROM mart_funnel_daily WHERE NOT (sessions >= view_item_sessions AND view_item_sessions >= add_to_cart_sessions AND add_to_cart_sessions >= converted_sessions)) AS failures, (SELECT count(*) FROM mart_funnel_daily WHERE NOT (sessions >= view_item_sessions AND view_item_sessions >= add_to_cart_sessions AND add_to_cart_sessions >= converted_sessions)) = 0 AS passed UNION ALL SELECT 'synthetic_flagged', (SELECT count(*) FROM suppliers WHERE NOT is_active), (SELECT count(*) FROM suppliers WHERE NOT is_active) = 0")
def two_checks(mart_funnel_daily: DataFrame, suppliers: DataFrame) -> DataFrame:
    return run_checks({"funnel_monotonic": funnel_monotonic(mart_funnel_daily), "synthetic_flagged": synthetic_flagged(suppliers)}).select("check_name", "failures", "passed")


def run_checks(checks: dict[str, DataFrame], examples: int = 10) -> DataFrame:
    """(check_name, failures, passed, examples): each check's count and, as JSON, its first few failing rows."""
    out = None
    for name, rows in checks.items():
        counted = rows.agg(F.count("*").alias("failures")).select(F.lit(name).alias("check_name"), "failures", (F.col("failures") == 0).alias("passed"))
        some = rows.limit(examples).agg(F.collect_list(F.to_json(F.struct(*rows.columns))).alias("examples"))
        one = counted.crossJoin(F.broadcast(some))
        out = one if out is None else out.unionByName(one)
    return out


@query("j20_contract_pii", f"SELECT event_key, regexp_matches(concat_ws(' ', page_location, transaction_id, method), '{EMAIL}') AS has_pii FROM stg_events")
def contract_pii(stg_events: DataFrame, columns: tuple[str, ...] = ("page_location", "transaction_id", "method")) -> DataFrame:
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.col(c).rlike(EMAIL), F.lit(False))
    return stg_events.select("event_key", found.alias("has_pii"))


@query("j21_expected_checks", "SELECT e.event_name, n AS expected, coalesce(m.k, 0) AS present FROM (VALUES ('purchase', 5), ('login', 3), ('page_view', 3), ('view_item', 2)) e(event_name, n) LEFT JOIN (SELECT event_name, count(DISTINCT check_name) AS k FROM mart_tag_health_daily WHERE check_kind IN ('required', 'format', 'value_math') AND source = 'store_b' GROUP BY 1) m USING (event_name) WHERE n <> coalesce(m.k, 0)")
def expected_checks(mart_tag_health_daily: DataFrame, source: str = "store_b") -> DataFrame:
    """Rules of the contract that no event of a source was checked by; a check that stops running would be found here."""
    counts: dict[str, int] = {}
    for r in CONTRACT:
        counts[r.event] = counts.get(r.event, 0) + 1
    expected = mart_tag_health_daily.sparkSession.range(1).select(F.inline(F.array(*[F.struct(F.lit(e).alias("event_name"), F.lit(n).alias("expected")) for e, n in counts.items()])))
    present = mart_tag_health_daily.where(F.col("check_kind").isin("required", "format", "value_math") & (F.col("source") == source)).groupBy("event_name").agg(F.count_distinct("check_name").alias("present"))
    return expected.join(present, "event_name", "left").fillna(0, ["present"]).where("expected <> present")


@query("j22_purchase_once", "SELECT source, transaction_id, count(*) AS purchases FROM int_purchases WHERE transaction_id IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1")
def purchase_once(int_purchases: DataFrame) -> DataFrame:
    return int_purchases.where("transaction_id IS NOT NULL").groupBy("source", "transaction_id").agg(F.count("*").alias("purchases")).where("purchases > 1")


@query("j23_value_math", "SELECT source, order_id, sum(round(price_usd * 100)::BIGINT * quantity)::BIGINT AS line_cents, round(max(revenue_usd) * 100)::BIGINT AS order_cents FROM fct_order_items JOIN fct_orders USING (source, order_id) GROUP BY 1, 2 HAVING sum(round(price_usd * 100)::BIGINT * quantity) <> round(max(revenue_usd) * 100)::BIGINT")
def value_math(fct_order_items: DataFrame, fct_orders: DataFrame) -> DataFrame:
    """Orders whose revenue isn't their lines' price times quantity, in whole cents."""
    cents = lambda c: F.round(F.col(c) * 100).cast("long")
    lines = fct_order_items.groupBy("source", "order_id").agg(F.sum(cents("price_usd") * F.col("quantity")).alias("line_cents"))
    return lines.join(fct_orders.select("source", "order_id", cents("revenue_usd").alias("order_cents")), ["source", "order_id"]).where("line_cents <> order_cents")


_IN_ORDER = "PARTITION BY session_key ORDER BY event_timestamp, event_key"


def _in_session() -> Window:
    return Window.partitionBy("session_key").orderBy("event_timestamp", "event_key")


@query("j24_repeated_page_view", f"SELECT event_key FROM (SELECT event_key, event_name, lag(event_name) OVER ({_IN_ORDER}) AS before FROM stg_events WHERE session_key IS NOT NULL) WHERE event_name = before")
def repeated_event(stg_events: DataFrame) -> DataFrame:
    """Events that repeat the one before them in their session."""
    rows = stg_events.where("session_key IS NOT NULL").select("event_key", "event_name", F.lag("event_name").over(_in_session()).alias("before"))
    return rows.where("event_name = before").select("event_key")


@query("j25_purchase_follows_checkout", f"SELECT event_key, checkout_key FROM (SELECT event_key, event_name, last_value(CASE WHEN event_name = 'begin_checkout' THEN event_key END IGNORE NULLS) OVER ({_IN_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS checkout_key FROM stg_events WHERE session_key IS NOT NULL) WHERE event_name = 'purchase'")
def purchase_checkout(stg_events: DataFrame) -> DataFrame:
    """Each purchase with the latest checkout before it in its session; null where it follows none."""
    earlier = _in_session().rowsBetween(Window.unboundedPreceding, -1)
    rows = stg_events.where("session_key IS NOT NULL").select("event_key", "event_name", F.last(F.when(F.col("event_name") == "begin_checkout", F.col("event_key")), ignorenulls=True).over(earlier).alias("checkout_key"))
    return rows.where("event_name = 'purchase'").select("event_key", "checkout_key")


#: A session's expected course: each step's event, and whether it may come again before the next one.
COURSE = (("page_view", False), ("view_item", False), ("add_to_cart", False))
_COURSE_SQL = ", ".join(f"({i}, '{name}', {str(again).lower()})" for i, (name, again) in enumerate(COURSE))


def transitions(course: tuple[tuple[str, bool], ...]) -> dict[tuple[int, str], int]:
    """The automaton of a course: from how many steps are done, by the next event, to how many are done then. What isn't in it is a mismatch, but for a done course, after which anything may follow."""
    out = {}
    for done, (name, _) in enumerate(course):
        if done and course[done - 1][1]:
            out[done, course[done - 1][0]] = done
        out[done, name] = done + 1
    return out


@query("j26_sequence", f"""SELECT * FROM (WITH RECURSIVE course AS (SELECT * FROM (VALUES {_COURSE_SQL}) c(i, name, again)), numbered AS MATERIALIZED (SELECT session_key, event_name, row_number() OVER ({_IN_ORDER}) AS n, count(*) OVER (PARTITION BY session_key) AS last FROM stg_events WHERE session_key IS NOT NULL),
    walk AS (
        SELECT DISTINCT session_key, 0::BIGINT AS n, 0 AS done, last, NULL::VARCHAR AS got, false AS failed FROM numbered
        UNION ALL
        SELECT w.session_key, w.n + 1, CASE WHEN e.event_name = want.name THEN w.done + 1 ELSE w.done END, w.last, e.event_name, NOT coalesce(e.event_name = want.name OR (e.event_name = had.name AND had.again), false)
        FROM walk w JOIN numbered e ON e.session_key = w.session_key AND e.n = w.n + 1 JOIN course want ON want.i = w.done LEFT JOIN course had ON had.i = w.done - 1 WHERE NOT w.failed AND w.done < {len(COURSE)}
    ), ended AS (SELECT session_key, max(n) AS n, arg_max(done, n) AS done, arg_max(failed, n) AS failed, arg_max(got, n) AS got FROM walk GROUP BY 1)
    SELECT session_key, (CASE WHEN failed THEN n ELSE n + 1 END)::INT AS first_mismatch, name AS expected, CASE WHEN failed THEN got END AS got FROM ended JOIN course ON i = done WHERE done < {len(COURSE)})""")  # fmt: skip
def sequence_mismatch(stg_events: DataFrame, course: tuple[tuple[str, bool], ...] = COURSE) -> DataFrame:
    """(session_key, first_mismatch, expected, got): sessions that depart from the course, and at which of their events. A session that ends before the course does departs behind its last event; got is null then.

    The automaton is run over a session's events as they stream by in order; its state is a number, however long the session is.
    """
    moves, steps = transitions(course), len(course)

    def step(state: list, row: tuple) -> tuple:
        """state: events seen, steps done, whether it is over."""
        state[0] += 1
        if not state[2] and state[1] < steps:
            done = moves.get((state[1], row[0]))
            if done is None:
                state[2] = True
                return state[0], state[1], row[0], True
            state[1] = done
        return state[0], state[1], None, False

    kind = pa.schema([("n", pa.int32()), ("done", pa.int32()), ("got", pa.string()), ("failed", pa.bool_())])
    events = stg_events.where("session_key IS NOT NULL").select("session_key", "event_timestamp", "event_key", "event_name")
    judged = ordered_fold(events, ["session_key"], ["event_timestamp", "event_key"], ["event_name"], lambda row: [0, 0, False], step, kind)
    # the failure if there is one, else the last event
    last = judged.groupBy("session_key").agg(F.max(F.struct("failed", "n", "done", "got")).alias("e")).where(F.col("e.failed") | (F.col("e.done") < steps))
    at = F.when(F.col("e.failed"), F.col("e.n")).otherwise(F.col("e.n") + 1).alias("first_mismatch")
    return last.select("session_key", at, F.get(F.array(*[F.lit(name) for name, _ in course]), F.col("e.done")).alias("expected"), F.col("e.got").alias("got"))


@query("j27_first_event", "SELECT session_key, arg_min(event_name, (event_timestamp, event_key)) AS first_event, count(*) FILTER (event_name = 'page_view') AS page_views FROM stg_events WHERE session_key IS NOT NULL GROUP BY 1 HAVING arg_min(event_name, (event_timestamp, event_key)) <> 'page_view' OR count(*) FILTER (event_name = 'page_view') <> 1")
def first_event_once(stg_events: DataFrame, name: str = "page_view") -> DataFrame:
    per = stg_events.where("session_key IS NOT NULL").groupBy("session_key").agg(F.min_by("event_name", F.struct("event_timestamp", "event_key")).alias("first_event"), F.count_if(F.col("event_name") == name).alias("page_views"))
    return per.where((F.col("first_event") != name) | (F.col("page_views") != 1))


@query("j28_opaque_ids", "SELECT DISTINCT s.user_id, known FROM stg_events s JOIN (SELECT DISTINCT 'a' || unnest([user_id, user_id + 100000]) AS known FROM events) ON s.user_id IN (md5(known), sha256(known))")
def hashed_ids(stg_events: DataFrame, events: DataFrame) -> DataFrame:
    """Ids that are hashes of known values, here of the account numbers that the events give: each known value's hashes are joined by equality."""
    accounts = events.select(F.explode(F.array(F.col("user_id").cast("long"), F.col("user_id") + F.lit(100_000).cast("long"))).alias("account")).distinct()
    values = accounts.select(F.concat(F.lit("a"), F.col("account")).alias("known")).where("known IS NOT NULL")
    hashes = values.select("known", F.explode(F.array(F.md5("known"), F.sha1("known"), F.sha2("known", 256), F.sha2("known", 512))).alias("user_id"))
    return stg_events.where("user_id IS NOT NULL").select("user_id").distinct().join(hashes, "user_id")


@query("j29_encoded_pii", "SELECT doc_id FROM documents WHERE regexp_matches(text, '[A-Za-z0-9._+-]+@[A-Za-z0-9-]+[.][A-Za-z]')")
def encoded_pii(documents: DataFrame) -> DataFrame:
    """Texts that hold an address once their @ signs have been encoded twice: found after up to three decodings."""
    hidden = documents.select("doc_id", F.regexp_replace(F.regexp_replace("text", "%", "%25"), "@", "%2540").alias("text"))
    return with_encoded_email(hidden).where("found").select("doc_id")


def with_encoded_email(df: DataFrame, column: str = "text", decodings: int = 3) -> DataFrame:
    """``df`` with ``found``: whether the column holds an address as it is or after URL decodings; a % that begins no escape and signs of + stay as they are."""
    shape = r"[A-Za-z0-9._+-]+@[A-Za-z0-9-]+[.][A-Za-z]"
    text = F.col(f"`{column}`")
    found = text.rlike(shape)
    for _ in range(decodings):
        whole = F.regexp_replace(F.replace(text, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25")
        text = F.coalesce(F.try_url_decode(whole), text)
        found = found | text.rlike(shape)
    return df.withColumn("found", F.coalesce(found, F.lit(False)))
