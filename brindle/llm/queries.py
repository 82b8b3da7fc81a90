"""One query for each operator, over whole tables, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import chat_format, decontamination, hard_negatives, language_id, licenses, pii, quality, sentencepiece_bpe, simhash, toxicity, vector_codes, vector_search, warc_fixity
from brindle.llm.common import table


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_hits(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return got.withColumn("spans", F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"], s["end"])), ","))


def model_path() -> str:
    """The public tokenizer's file; a parameter of the operator."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.token_digests(table(spark, sf_dir, "documents"), model_path())


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_fixity.audited_pages(table(spark, sf_dir, "pages"))


def op7_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.nearest(table(spark, sf_dir, "embeddings"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"SELECT -1L AS conv_id, turn, role, text FROM VALUES (0L, 'user', '{said}'), (1L, 'assistant', '{said}') AS t(turn, role, text)")
    return chat_format.digests(chat_format.formatted(rows.unionByName(extra)))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: The key of the registered query; a deployment passes its own secret.
PII_KEY = b"a key for tests and reports only"


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = pii.replaced(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)
    return got.withColumn("n_entities", sum(F.col(f"n_{t}") for t in pii.TYPES))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    changed = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mined(rows.withColumn("label", changed))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(table(spark, sf_dir, "embeddings")).drop("label")


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_licenses": op1_licenses,
    "op2_quality": op2_quality,
    "op3_decontamination": op3_decontamination,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_simhash": op5_simhash,
    "op6_warc_fixity": op6_warc_fixity,
    "op7_vector_search": op7_vector_search,
    "op8_chat_format": op8_chat_format,
    "op9_toxicity": op9_toxicity,
    "op10_pii": op10_pii,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_vector_codes": op12_vector_codes,
    "op13_language_id": op13_language_id,
}

#: A vector that takes part in op11 and op12.
_FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def _codes_sql(rounds: int = vector_codes.ROUNDS) -> str:
    """Plain rounds: every part is compared with every entry each time."""
    steps = [
        f"""rows AS MATERIALIZED (
            SELECT vec_id, label, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS i, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings WHERE {_FINITE}
        )""",
        "parts AS MATERIALIZED (SELECT i, p, v[p * len(v) // 4 + 1 : (p + 1) * len(v) // 4] AS x FROM rows, range(4) AS t(p))",
        "book0 AS MATERIALIZED (SELECT p, i - 1 AS e, x AS c FROM parts WHERE i <= 256)",
    ]
    for r in range(rounds + 1):
        steps.append(f"""near{r} AS MATERIALIZED (
            SELECT i, p, min(struct_pack(d := list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, e := e)) AS best FROM parts JOIN book{r} USING (p) GROUP BY i, p
        )""")
        if r < rounds:
            steps.append(f"""book{r + 1} AS MATERIALIZED (
                SELECT p, e, coalesce(n.c, b.c) AS c FROM book{r} b LEFT JOIN (
                    SELECT p, e, list(m ORDER BY k) AS c FROM (
                        SELECT p, best.e AS e, k, floor(sum(x[k]) / count(*)) AS m FROM near{r} JOIN parts USING (i, p), range(1, 1 + (SELECT max(len(v)) // 4 FROM rows)) AS t(k) GROUP BY 1, 2, 3
                    ) GROUP BY p, e
                ) n USING (p, e)
            )""")
    return f"""
        WITH {", ".join(steps)}, coded AS (
            SELECT i, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM near{rounds} GROUP BY i
        )
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
            (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda y: y::BIGINT), ','), ',' ORDER BY p, e)) FROM book{rounds}) AS codebooks_sha256
        FROM coded JOIN rows USING (i)
    """


#: A control string, escaped or not, in a text; the formatter escapes texts that hold one.
_CONTROL = r"([<\[])(\\*)(/?s>|/?INST\]|OUT\]|/?R:)"

ORACLE_SQL: dict[str, str] = {
    "op1_licenses": licenses.oracle(),
    "op6_warc_fixity": warc_fixity.ORACLE,
    "op8_chat_format": rf"""
        WITH rows AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
            UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
        ), parts AS (
            SELECT *, length(regexp_replace(text, '{_CONTROL}', '\1\\\2\3', 'g'))
                + CASE role WHEN 'user' THEN 23 WHEN 'assistant' THEN 13
                  ELSE 19 + CASE WHEN regexp_full_match(role, '[A-Za-z_-]+') THEN length(role) ELSE 1 + 2 * strlen(role) END END AS chars
            FROM rows
        )
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
            coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
            sum(chars)::BIGINT AS formatted_chars
        FROM parts GROUP BY conv_id
    """,
    "op11_hard_negatives": f"""
        WITH rows AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
            FROM embeddings WHERE label IS NOT NULL AND {_FINITE}
        ), scores AS MATERIALIZED (
            SELECT a.vec_id AS anchor_id, r.vec_id, r.label = a.label AS same, list_dot_product(a.v, r.v)::BIGINT AS score
            FROM rows a JOIN rows r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id
        ), positives AS (
            SELECT * FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
        )
        SELECT anchor_id, p.vec_id AS positive_id, (row_number() OVER (PARTITION BY anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id))::INT AS rank,
            n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
        FROM positives p JOIN scores n USING (anchor_id) WHERE NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score QUALIFY rank <= 5
    """,
    "op12_vector_codes": _codes_sql(),
}
