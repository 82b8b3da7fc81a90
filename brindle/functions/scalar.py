"""Scalar functions by family, each over a given table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.registry import query


@query("n01_string", "SELECT p_partkey, concat(p_brand, '-', p_type) AS label, nullif(trim(p_name), '') AS name, lpad(p_partkey::VARCHAR, 8, '0') AS padded, strpos(p_name, 'r')::INT AS r_at, length(p_name)::INT AS n, p_name LIKE 'red%' AS is_red FROM part")
def string_functions(part: DataFrame) -> DataFrame:
    return part.select("p_partkey", F.concat("p_brand", F.lit("-"), "p_type").alias("label"), F.nullif(F.trim("p_name"), F.lit("")).alias("name"), F.lpad(F.col("p_partkey").cast("string"), 8, "0").alias("padded"), F.instr("p_name", "r").alias("r_at"), F.char_length("p_name").alias("n"), F.col("p_name").like("red%").alias("is_red"))


@query("n02_regex", "SELECT p_partkey, nullif(regexp_extract(p_brand, '#([0-9]+)', 1), '') AS brand_no, regexp_matches(p_name, '(?i)^RED ') AS is_red FROM part")
def regex_functions(part: DataFrame) -> DataFrame:
    return part.select("p_partkey", F.nullif(F.regexp_extract("p_brand", "#([0-9]+)", 1), F.lit("")).alias("brand_no"), F.col("p_name").rlike("(?i)^RED ").alias("is_red"))


@query("n03_conditional", "SELECT event_id, coalesce(nullif(event_type, 'error'), 'failed') AS kind, greatest(value, 50) AS least_50, least(value, 50) AS most_50, (nullif(user_id, 3) IS DISTINCT FROM 4) AS not_four, CASE WHEN value > 100 THEN 'big' ELSE 'small' END AS size FROM events")
def conditional_functions(events: DataFrame) -> DataFrame:
    return events.select("event_id", F.coalesce(F.nullif("event_type", F.lit("error")), F.lit("failed")).alias("kind"), F.greatest("value", F.lit(50.0)).alias("least_50"), F.least("value", F.lit(50.0)).alias("most_50"),
        (~F.nullif("user_id", F.lit(3)).eqNullSafe(F.lit(4))).alias("not_four"), F.when(F.col("value") > 100, "big").otherwise("small").alias("size"))


@query("n04_safe_arithmetic", "SELECT event_id, round(value / nullif(user_id % 3, 0), 6) AS ratio, TRY_CAST(props AS BIGINT) AS not_a_number, TRY_CAST(event_id::VARCHAR AS BIGINT) AS number FROM events")
def safe_functions(events: DataFrame) -> DataFrame:
    return events.select("event_id", F.round(F.try_divide("value", F.col("user_id") % 3), 6).alias("ratio"), F.col("props").try_cast("bigint").alias("not_a_number"), F.col("event_id").cast("string").try_cast("bigint").alias("number"))


@query("n05_math", "SELECT event_id, round(value, 1) AS rounded, abs(value - 100) AS distance, pow(2, user_id % 10)::DOUBLE AS power, round(ln(value + 1), 6) AS log, floor(value)::BIGINT AS down, ceil(value)::BIGINT AS up, event_id % 7 AS rest FROM events")
def math_functions(events: DataFrame) -> DataFrame:
    return events.select("event_id", F.round("value", 1).alias("rounded"), F.abs(F.col("value") - 100).alias("distance"), F.pow(F.lit(2.0), F.col("user_id") % 10).alias("power"), F.round(F.log(F.col("value") + 1), 6).alias("log"), F.floor("value").alias("down"), F.ceil("value").alias("up"), (F.col("event_id") % 7).alias("rest"))


@query("n06_time", "SELECT event_id, date_trunc('day', ts)::DATE AS day, epoch_us(ts) AS micros, strptime(strftime(ts, '%Y%m%d'), '%Y%m%d')::DATE AS parsed, isodow(ts)::INT AS weekday, extract(hour FROM ts)::INT AS hour FROM events")
def time_functions(events: DataFrame) -> DataFrame:
    ts = F.col("ts").cast("timestamp_ntz")
    return events.select("event_id", ts.cast("date").alias("day"), F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts AS timestamp_ntz))").alias("micros"),
        F.to_date(F.date_format(ts, "yyyyMMdd"), "yyyyMMdd").alias("parsed"), (F.weekday(ts) + 1).alias("weekday"), F.hour(ts).alias("hour"))


@query("n07_hash", "SELECT c_custkey, md5(c_name) AS md5, sha1(c_name) AS sha1, sha256(c_name) AS sha256 FROM customer")
def hash_functions(customer: DataFrame) -> DataFrame:
    return customer.select("c_custkey", F.md5("c_name").alias("md5"), F.sha1("c_name").alias("sha1"), F.sha2("c_name", 256).alias("sha256"))


@query("n08_array", "SELECT p_partkey, len(string_split(p_name, ' '))::INT AS words, list_extract(string_split(p_name, ' '), -1) AS last_word, i::INT AS i, w AS word FROM (SELECT *, unnest(string_split(p_name, ' ')) AS w, generate_subscripts(string_split(p_name, ' '), 1) - 1 AS i FROM part)")
def array_functions(part: DataFrame) -> DataFrame:
    words = part.withColumn("ws", F.split("p_name", " "))
    return words.select("p_partkey", F.size("ws").alias("words"), F.element_at("ws", -1).alias("last_word"), F.posexplode("ws").alias("i", "word"))


@query("n09_url", "SELECT page_id, nullif(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1), '') AS host, nullif(regexp_extract(url, '[?&]utm_source=([^&#]*)', 1), '') AS utm_source FROM pages")
def url_functions(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", F.try_parse_url("url", F.lit("HOST")).alias("host"), F.try_parse_url("url", F.lit("QUERY"), F.lit("utm_source")).alias("utm_source"))
