"""Each operator against a brute-force version, and on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
import sentencepiece
import xxhash
import zlib
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from brindle.llm import chat_format, components, decontamination, licenses, pii, quality, queries, sentencepiece_bpe, simhash, toxicity, vector_search, warc_fixity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, *texts, first=0):
    return spark.createDataFrame([(i + first, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCS)


@pytest.fixture(scope="module")
def model():
    return sentencepiece_bpe.model_of(sentencepiece_bpe.read_model(queries.model_path()))


# --- licenses -------------------------------------------------------------------------------------


def test_licenses(spark):
    mit = "MIT Licence\n\nCopyright (c) 2020 Someone\n\n" + licenses.TEXTS["MIT"].replace(". ", ".\n")
    d = docs(spark, mit, "text.\nLicensed under the Apache License,  Version 2.0.", "Released under the MIT Licence. And more text.", "no license here", None, "", "x" * 200_000)
    got = {(r["doc_id"], r["license_id"], r["whole_text"]) for r in licenses.license_hits(d.withColumn("digest", F.lit("clash"))).collect()}
    assert {(1, "Apache-2.0", False), (2, "MIT", False)} <= got and any(i == 0 and w for i, _, w in got) and not {i for i, _, _ in got} & {3, 4, 5, 6}
    assert licenses.license_hits(d.limit(0)).count() == 0
    bsd = "BSD 3-Clause License\n\nCopyright (c) 2021, A. Person\nAll rights reserved.\n\n" + licenses.TEXTS["BSD-3-Clause"]
    e = docs(spark, bsd, "Copyright (c) 2020 Some Body. Licensed under the MIT License.", "x\nSPDX-License-Identifier: MIT\ny", "# " + licenses.HEADERS["GPL-3.0"].replace("\n", "\n# "), "We organise\nThe whole text of ours", "We organise\nThe whole text of ours")
    ours = spark.createDataFrame([("Ours", "we ORGANIZE the whole text - of ours")], "license_id string, text string")
    got = sorted(tuple(r) for r in licenses.license_hits(e, more=ours).collect())
    assert got == [(0, "BSD-3-Clause", 1, True, "text"), (1, "MIT", 1, True, "notice"), (2, "MIT", 1, False, "identifier"), (3, "GPL-3.0", 2, True, "notice"), (4, "Ours", 1, True, "text"), (5, "Ours", 1, True, "text")]


# --- quality --------------------------------------------------------------------------------------


def test_quality_rules_compile_to_what_they_say(spark):
    forest = "Tree 0 (weight 1.0):\n  If (feature 1 <= 2.5)\n   If (feature 0 <= 1.0)\n    Predict: 0.0\n   Else (feature 0 > 1.0)\n    Predict: 1.0\n  Else (feature 1 > 2.5)\n   Predict: 1.0\n"
    rules = quality.rules_of(forest, ("a", "b"))
    assert len(rules) == 4
    rows = spark.createDataFrame([(0.5, 2.0), (1.5, 2.0), (0.5, 3.0)], "a double, b double").select(F.array(*[r.column() for r in rules]).alias("x")).collect()
    assert [sum(r["x"]) for r in rows] == [2, 2, 1]


def test_quality_on_held_out_rows(spark):
    rnd = random.Random(1)
    good = ["".join(rnd.choice("abcdefgh ") for _ in range(200)) + "." for _ in range(120)]
    bad = ["##$$ " * rnd.randint(20, 60) for _ in range(120)]
    d = docs(spark, *good, *bad, None, "")
    labels = spark.createDataFrame([(i, int(i < 120), 0) for i in range(240)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.quality(d, labels).collect()}
    assert len(got) == 242 and all(0 <= r["score"] <= 1 for r in got.values())
    held = [i for i in range(240) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i]["held_out"] for i in held) and np.mean([got[i]["predicted"] == (i < 120) for i in held]) > 0.95
    assert quality.quality(d.limit(0), labels).count() == 0
    assert {r["score"] for r in quality.quality(d.limit(3), labels.limit(0)).collect()} == {0.5}


# --- decontamination ------------------------------------------------------------------------------


def brute_contamination(texts, items, n=10):
    windows = {}
    for i, t in items:
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        for j in range(max(len(w) - n, 0) + 1 if w else 0):
            windows.setdefault(tuple(w[j : j + n]), set()).add(str(i))
    out = []
    for t in texts:
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        hit, found = [False] * len(w), set()
        for size in {len(x) for x in windows}:
            for j in range(len(w) - size + 1):
                if tuple(w[j : j + size]) in windows:
                    hit[j : j + size] = [True] * size
                    found |= windows[tuple(w[j : j + size])]
        out.append((len(w), sum(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), any(hit)))
    return out


def test_contamination(spark):
    rnd = random.Random(3)
    word = lambda: rnd.choice(["Alpha", "beta", "ГАММА", "d4", "ñu", "x"])
    items = [(i, " ".join(word() for _ in range(rnd.randint(0, 16)))) for i in range(30)] + [(30, None), (31, ""), (32, "one two"), (33, "one two")]
    texts = [" - ".join(word() for _ in range(rnd.randint(0, 300))) for _ in range(40)] + [None, "", "One, TWO!", "word " * 50_000]
    bench = spark.createDataFrame(items, "item_id long, text string")
    d = docs(spark, *texts)
    for block in (400_000, 20):  # in one automaton, and in several
        got = sorted(decontamination.contamination(d.withColumn("found", F.lit(1)), bench, block_pairs=block).collect())
        assert [tuple(r)[1:-1] for r in got] == brute_contamination(texts, items)
        for r in got:  # the spans hold just the hit words, in the original text
            text = texts[r["doc_id"]] or ""
            assert sum(len(decontamination.words(text[a:b])) for a, b in r["spans"]) == r["n_hit"] and all(text[a:b].strip(" -,!") == text[a:b] for a, b in r["spans"])
    assert decontamination.contamination(d, bench.limit(0)).where("contaminated").count() == 0
    clean = decontamination.clean(d.withColumn("row", F.lit(7)), bench)
    assert {r["doc_id"] for r in clean.collect()} == {i for i, x in enumerate(brute_contamination(texts, items)) if not x[4]} and "row" in clean.columns
    assert decontamination.spans_of("One, TWO! é3", [(0, 2), (2, 3)]) == [(0, 8), (10, 12)]
    plan = decontamination.contamination(d, bench)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("scan(") == 1  # each text is scanned once


def test_scanner_of_very_many_words():
    n = 1_200_000  # more than there are characters
    pairs = [(" ".join(f"w{i + k}" for k in range(4)), str(i)) for i in range(0, n, 4)] + [("w7 w8", "x"), ("w8", "y")]
    scanner = decontamination.Scanner(pairs)
    assert scanner.scan(decontamination.words("w0 w1 w2 w3 w4 no w1199996 w1199997 w1199998 w1199999 w7 w8 w7")) == ([(0, 4), (6, 12)], {"0", "1199996", "x", "y"})


# --- sentencepiece --------------------------------------------------------------------------------


def test_tokens_equal_the_library(spark, model):
    sp = sentencepiece.SentencePieceProcessor(model_file=queries.model_path())
    rnd, pieces = random.Random(5), list(model.id)
    texts = ["", " ", "  a  b\n\n c\t", "▁▁ x▁y", "😀漢字\x00\n \n", "<s> </s> <0x41>", "a" * 3_000, " " * 70 + "x\n", "é́ ﬁ ﷺ", "-" * 500]
    texts += ["".join(rnd.choice(pieces).replace("▁", rnd.choice(" ▁")) for _ in range(rnd.randint(1, 8))) for _ in range(1_500)]
    for t in texts:
        ids = sp.encode(t)
        assert model.encode(t) == ids and model.decode(ids) == sp.decode(ids)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    d = docs(spark, None, *texts[:50])
    for r in sentencepiece_bpe.tokenized(d, queries.model_path()).collect():
        ids = sp.encode(([""] + texts)[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], r["ids"]) == (len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids)), ids)
    assert sentencepiece_bpe.token_digests(d.limit(0), queries.model_path()).count() == 0


def test_decoding_of_broken_bytes(model):
    sp = sentencepiece.SentencePieceProcessor(model_file=queries.model_path())
    rnd = random.Random(2)
    for _ in range(500):
        ids = [rnd.randrange(1, 260) if rnd.random() < 0.7 else rnd.randrange(260, 32_000) for _ in range(rnd.randint(0, 6))]
        assert model.decode(ids) == sp.decode(ids)


# --- simhash --------------------------------------------------------------------------------------


def brute_components(prints):
    ids, parent = list(prints), {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in ids}


def test_simhash_equals_brute_force(spark):
    rnd = random.Random(4)
    base = [rnd.choice(["alpha", "beta", "gamma", "delta", "eps"]) + str(rnd.randrange(50)) for _ in range(400)]
    texts = []
    for _ in range(120):
        w = list(base)
        for _ in range(rnd.randint(0, 4)):
            w[rnd.randrange(len(w))] = "new" + str(rnd.randrange(9))
        texts.append(" ".join(w))
    texts += [None, "", " \n", "one", "ONE", "one two", "A b C", "a  b\tc", texts[0], "w " * 60_000]

    def print_of(t):
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        if not w:
            return 0
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(len(w) - 2, 1))]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = {i: print_of(t) for i, t in enumerate(texts)}
    expected = brute_components(prints)
    got = {r["doc_id"]: (r["fp"] % (1 << 64), r["component_id"]) for r in simhash.near_duplicates(docs(spark, *texts)).collect()}
    assert got == {i: (prints[i], expected[i]) for i in prints}
    kept = simhash.deduplicated(docs(spark, *texts).union(docs(spark, *texts[:2])))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(expected.values())) and kept.columns == docs(spark).columns
    clash = simhash.deduplicated(docs(spark, *texts).withColumn("fp", F.lit(1)).withColumn("row", F.lit(2)).withColumn("at", F.lit(3)))
    assert clash.columns[-3:] == ["fp", "row", "at"] and sorted(r["doc_id"] for r in clash.collect()) == sorted(set(expected.values()))
    assert simhash.near_duplicates(docs(spark, "a").limit(0)).count() == 0 and simhash.deduplicated(docs(spark, "a").limit(0)).count() == 0
    unnamed = docs(spark, "a b c d", "a b c d", None).withColumn("doc_id", F.lit(None).cast("long"))
    assert simhash.deduplicated(unnamed).count() == 2


def test_a_hot_fingerprint_meets_in_no_task(spark):
    d = docs(spark, *["same text here"] * 500, *[f"other {i} words of it" for i in range(200)])
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(d).collect()}
    assert [got[i] for i in range(500)] == [0] * 500 and [r["doc_id"] for r in simhash.deduplicated(d).where("doc_id < 500").collect()] == [0]


def test_crowded_variants_lose_no_link(spark):
    rnd = random.Random(6)
    center = rnd.getrandbits(64)
    prints = {center ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) ^ (rnd.getrandbits(64) if rnd.random() < 0.2 else 0) for _ in range(150)}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    expected = brute_components({signed(p): p for p in prints})
    for paired in (2, 5, 32):
        roots = {r["node"]: r["root"] for r in components.components(simhash.links(df, paired)).collect()}
        groups = lambda m: {frozenset(x for x in m if m[x] == r) for r in set(m.values())}
        assert groups({signed(p): roots.get(signed(p), signed(p)) for p in prints}) == groups(expected)


def test_every_pair_of_bits_is_linked_with_few_variants(spark):
    rnd = random.Random(9)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    pairs = [(x, x ^ (1 << i) ^ (1 << j)) for i in range(64) for j in range(i, 64) for x in [rnd.getrandbits(64)]]
    df = spark.createDataFrame([(signed(p),) for pair in pairs for p in pair], "fp long").distinct()
    assert {frozenset((r["a"], r["b"])) for r in simhash.links(df).collect()} == {frozenset(map(signed, p)) for p in pairs if p[0] != p[1]}
    assert simhash._variants(df).count() == 33 * df.count()


def test_removed_rows_are_written_before_rows_are_read(spark):
    plan = simhash.deduplicated(docs(spark, *["same text here"] * 50, *[f"other {i} words of it" for i in range(20)]))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_components_of_a_long_chain(spark):
    n = 300
    order = random.Random(7).sample(range(n), n)
    chain = spark.createDataFrame(list(zip(order, order[1:])) + [(5, 5), (None, 1)], "a long, b long")
    assert {(r["node"], r["root"]) for r in components.components(chain).collect()} == {(i, 0) for i in range(n)}


# --- warc -----------------------------------------------------------------------------------------


def test_audit_finds_just_the_damage(spark):
    rnd = random.Random(8)
    first = [(f, o * 7_000, 6_900, f"{f}-{o}") for f in range(3) for o in range(200)]
    second = {(a, o): (a, o, n, d) for a, o, n, d in first}
    del second[0, 7_000]
    second[1, 14_000] = (1, 14_000, 6_900, "bad")
    second[2, 9_999_999] = (2, 9_999_999, 5, "more")
    kind = "archive long, offset long, length long, digest string"
    a, b = spark.createDataFrame(first, kind), spark.createDataFrame(rnd.sample(list(second.values()), len(second)), kind)
    assert {(r["archive"], r["offset"], r["status"]) for r in warc_fixity.audit(a, b).collect()} == {(0, 7_000, "missing"), (1, 14_000, "changed"), (2, 9_999_999, "extra")}
    assert warc_fixity.audit(a, a).count() == 0 and warc_fixity.audit(a.limit(0), b.limit(0)).count() == 0


def test_pages_with_nulls_and_repeats(spark):
    pages = spark.createDataFrame([(None, None, None), (13, "u", "<p>x</p>" * 20), (13, "u", "<p>x</p>" * 20), (7, "u", ""), (8, None, "y" * 300_000)], "page_id long, url string, html string")
    assert sorted((r["page_id"], r["status"]) for r in warc_fixity.audited_pages(pages).collect()) == [(7, "missing"), (13, "changed"), (13, "changed")]


# --- vectors --------------------------------------------------------------------------------------


def test_search_against_brute_force(spark):
    rnd = np.random.default_rng(9)
    x = rnd.normal(size=(1_500, 16)).astype(np.float32)
    x[100:160] = x[100]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(5_000, None), (5_020, []), (5_040, [0.0] * 16), (5_060, [float("nan")] * 16), (5_080, [None] * 16), (None, [1.0] * 16), (0, [float(v) for v in x[0]])]
    got = vector_search.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))).collect()
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append(r)
    assert set(by) == set(range(0, 1_500, 20))
    recall = []
    for q, answer in by.items():
        s = (x.astype(float) * x[q].astype(float)).sum(1)
        best = sorted((-s[i], i) for i in range(1_500) if i != q)[:20]
        answer = sorted(answer, key=lambda r: r["rank"])
        assert [r["rank"] for r in answer] == list(range(1, 21)) and all(abs(r["score"] - s[r["vec_id"]]) < 1e-9 for r in answer)
        assert [(-r["score"], r["vec_id"]) for r in answer] == sorted((-r["score"], r["vec_id"]) for r in answer)
        recall.append(len({i for _, i in best} & {r["vec_id"] for r in answer}) / 20)
    assert np.mean(recall) > 0.95


def test_search_over_many_shards_and_blocks(spark):
    rnd = np.random.default_rng(11)
    x = rnd.normal(size=(2_400, 24))
    x[:40] *= 1e200  # of another order of length
    rows = vector_search.valid(spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>"))
    graph, members = vector_search.index(rows, 10, rows=400)
    assert graph.select("band", "shard").distinct().count() > 6 and graph.count() == 2_400
    queries = rows.where("vec_id >= 1200 AND vec_id % 3 = 0").selectExpr("vec_id AS query_id", "embedding")
    got = vector_search.search(graph, members, queries, 10, block_rows=150)
    found = {}
    for r in got.collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert set(found) == set(range(1_200, 2_400, 3))
    best = {q: set(sorted((i for i in range(2_400) if i != q), key=lambda i: -(x[i] @ x[q]))[:10]) for q in found}  # noqa: B023
    assert np.mean([len(best[q] & found[q]) / 10 for q in found]) > 0.95
    small = vector_search.index(rows.where("vec_id >= 40"), 10, rows=400)
    near = vector_search.search(*small, queries, 10)
    best = {q: set(sorted((i for i in range(40, 2_400) if i != q), key=lambda i: -(x[i] @ x[q]))[:10]) for q in found}  # noqa: B023
    assert np.mean([r["vec_id"] in best[r["query_id"]] for r in near.collect()]) > 0.95


def test_search_over_few_and_none(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert [(r["vec_id"], r["score"]) for r in vector_search.nearest(few).orderBy("rank").collect()] == [(2, 1.0), (1, 0.5)]
    assert vector_search.nearest(few.limit(0)).count() == 0


# --- chat -----------------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    r, parts = random.Random(3), ["<", "s>", "</s>", "\\", "[INST] ", " [/INST]", "/", "INST]", "[", "[OUT]", "ok", " ", "\n", "[R:", "[/R:]", "]"]
    rows = [(c, t, r.choice(["user", "assistant", "system", "", "a]b", "</s>", None]), r.choice([None, "".join(r.choice(parts) for _ in range(r.randint(0, 9)))])) for c in (1, 2, None) for t in range(40)]
    rows += [(3, 1, "user", "x"), (3, 1, "user", "x"), (3, None, "assistant", "first"), (4, 0, "assistant", "long " * 50_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {x["conv_id"]: x for x in chat_format.digests(chat_format.formatted(df.withColumn("rendered", F.lit(0)))).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for c in (1, 2, 3, 4, None):
        turns = sorted(((t if t is not None else -1, role or "", text or "") for k, t, role, text in rows if k == c))
        said = "".join(text for _, role, text in turns if role == "assistant")
        assert (got[c]["n_turns"], got[c]["turns_sha256"]) == (len(turns), sha("".join(f"{role}\n{text}\n" for _, role, text in turns)))
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(said), sha(said))
    for x in chat_format.formatted(df).collect():  # the mask covers just what the assistant says
        assert [chat_format.unescape(x["rendered"][a:b]) for a, b in x["loss_spans"]] == ([x["text"] or ""] if x["role"] == "assistant" else [])
    assert chat_format.digests(chat_format.formatted(df.limit(0))).count() == 0


# --- toxicity -------------------------------------------------------------------------------------


def test_toxicity_on_held_out_rows(spark):
    rnd = random.Random(10)
    plain = lambda: "".join(rnd.choice("aeiourstln") for _ in range(rnd.randint(2, 8)))
    insult = ["scoundrel", "dimwit", "blockhead", "nincompoop"]
    text = lambda bad: " ".join(rnd.choice(insult) if bad and rnd.random() < 0.12 else plain() for _ in range(80))
    d = docs(spark, *[text(i % 3 == 0) for i in range(360)], None, "")
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(360)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(d, labels).collect()}
    held = [i for i in range(360) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(got) == 362 and all(got[i]["held_out"] for i in held) and np.mean([got[i]["predicted"] == (i % 3 == 0) for i in held]) > 0.9
    assert {r["score"] for r in toxicity.toxicity(d.limit(3), labels.limit(0)).collect()} == {0.0}
    assert toxicity.toxicity(d.limit(0), labels).count() == 0


def plain_toxicity(model, text):
    """The score of one text, with nothing kept or compressed together."""
    how = zstandard.ZstdCompressionParameters.from_level(3, min_match=5, write_content_size=False, write_checksum=False, write_dict_id=False)
    size = lambda content, w: len(zstandard.ZstdCompressor(compression_params=how, dict_data=zstandard.ZstdCompressionDict(content)).compress(w))
    saved = []
    for w in (text or "").lower().split():
        each = [size(o, f" {w} ".encode("utf-16-le")) - size(t, f" {w} ".encode("utf-16-le")) for t, o in model.dictionaries]
        saved.append(sum(each) / len(each))
    n = len(saved)
    over = [sum(round(x - sum(saved) / n, 6) >= t for x in saved) for t in toxicity.SAVINGS]
    x = [*map(math.log1p, over), *(k / n for k in over), sum(saved) / n, math.log1p(n)] if n else [0.0] * toxicity.FEATURES
    return 1 / (1 + math.exp(-sum((v - m) / s * w for v, m, s, w in zip(x, model.mean, model.scale, model.weights)) - model.weights[-1]))


def test_toxicity_equals_a_plain_version(spark, sf_dir):
    d, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    some = d.where("length(text) < 2000").limit(25).union(docs(spark, None, "", " ", "w" * 5_000, "same same", "same same", first=-6)).withColumn("score", F.lit("clash"))
    model = toxicity.fit(d, labels)
    assert model.weights and len(model.dictionaries) > 1
    got = toxicity.scored(some, model).collect()
    assert len(got) == 31 and all(abs(r["score"] - plain_toxicity(model, r["text"])) < 1e-6 for r in got)


def test_toxicity_sample_counts_documents_once_and_is_not_shrunk(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_TOXIC", 2)
    monkeypatch.setattr(toxicity, "SAMPLE_ORDINARY", 2)
    taken = []
    real = toxicity._trained
    monkeypatch.setattr(toxicity, "_trained", lambda texts, toxic, ordinary: taken.append((len(toxic), len(ordinary))) or real(texts, toxic, ordinary))
    few = [(i, f"{'bad awful nasty' if i % 2 else 'calm kind green'} words {i} " * 5, "en", "s", 0) for i in range(1000, 1040)]
    d = spark.createDataFrame(few * 5 + [(i, "long " * 5_000, "en", "s", 0) for i in range(40)], DOCS)
    labels = spark.createDataFrame([(i, i % 2) for i in [*range(40), *range(1000, 1040), *range(9000, 9900)]], "doc_id long, toxic int")
    assert toxicity.fit(d, labels).weights and taken == [(2, 2)]


# --- pii ------------------------------------------------------------------------------------------


def test_permutations_are_permutations():
    s = pii.Surrogates(b"key")
    for bases in ([7], [1, 5], [10, 10, 10], [26, 10, 3]):
        size = int(np.prod(bases))
        every = [list(np.unravel_index(i, bases)) for i in range(size)]
        assert len({tuple(s.permuted("t", [int(v) for v in x], bases)) for x in every}) == size


def test_surrogates_keep_type_and_tell_entities_apart(spark):
    text = "Mrs. Anna Schmidt and Mr John Smith (JOHN) wrote from Ab.1@mail.example.com, ab.1@MAIL.example.com and b@x.org; call +1 (377) 555-0271 or +1-377-555-0271, 4111 1111 1111 1111, 10.1.2.3, DE89370400440532013000. token = \"0b96a8c8d79c4a50\" г-н Иван Петров"
    d = docs(spark, text, text, None, "", "nothing here", "word " * 60_000)
    got = {r["doc_id"]: r for r in pii.replaced(d.withColumn("n_email", F.lit(9)), b"key").collect()}
    new = got[0]["text"]
    assert new == got[1]["text"] and got[2]["text"] is None and got[4]["text"] == "nothing here"
    assert (got[0]["n_email"], got[0]["n_phone"], got[0]["n_card"], got[0]["n_ip"], got[0]["n_iban"], got[0]["n_secret"], got[0]["n_name"]) == (3, 2, 1, 1, 1, 1, 3)
    kinds = [(k, new[a:b]) for k, a, b in pii.entities(new)]
    assert [k for k, _ in kinds] == [k for k, _, _ in pii.entities(text)]
    emails = [e.lower() for k, e in kinds if k == "email"]
    phones = ["".join(c for c in e if c.isdigit()) for k, e in kinds if k == "phone"]
    assert emails[0] == emails[1] != emails[2] and phones[0] == phones[1]
    for old in ("Schmidt", "ab.1@", "555-0271", "4111 1111", "10.1.2.3", "0b96a8c8", "Петров"):
        assert old not in new
    first = new.split()[1]
    assert first in pii.NAMES["latin", "f"] and pii._luhn([c for k, e in kinds if k == "card" for c in e if c.isdigit()])
    assert pii.collisions(pii.mapping(d, b"key")).count() == 0
    assert pii.collisions(spark.createDataFrame([("ip", "a", "x"), ("ip", "b", "x")], "type string, entity string, surrogate string")).count() == 1


def surrogate_text(s, text):
    for kind, a, b in reversed(list(pii.entities(text))):
        text = text[:a] + s.of(kind, text[a:b]) + text[b:]
    return text


def test_secrets_phones_and_addresses_are_found_to_their_ends():
    jwt = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.dozjgNryP4J3jVmNHl0w5N_XgL0n3I9PlFUP0THsR8U"
    values = {"token=": "a1B2c3" * 50, "token: ": jwt, "API_TOKEN=": "abcd1234efgh", "db_password=": "hunter2hunter2", "AWS_SECRET_ACCESS_KEY=": "wJalrXUtnFEMI/K7MDENG+bPxRfiCYEXAMPLEKEY", "password: ": "P@ssw0rd!xyz", "clientSecret = ": "Zx8Zx8Zx8Zx8", "pwd: ": "пароль12"}
    for before, value in values.items():
        assert [(k, (before + value + ".")[a:b]) for k, a, b in pii.entities(before + value + ".")] == [("secret", value)]
    quoted = "password = \"a, b;c's & d.e!\" x"
    assert [(k, quoted[a:b]) for k, a, b in pii.entities(quoted)] == [("secret", "a, b;c's & d.e!")]
    for phone in ("+33 6 12 34 56 78", "06 12 34 56 78", "0171 2345678", "555.123.4567", "030/1234567", "612 345 678", "+49 171 2345678", "8 (495) 123-45-67", "0033 6 12 34 56 78"):
        assert [(k, f"Tel {phone}, x"[a:b]) for k, a, b in pii.entities(f"Tel {phone}, x")] == [("phone", phone)]
    for phone in ("+1 (826) 555-4081", "+33 6 12 34 56 78", "0171 2345678", "(377) 555-0271", "+49 171 2345678"):
        for kind, other in (("ip", "190.137.223.204"), ("card", "4111 1111 1111 1111"), ("card", "4111111111111111"), ("ssn", "123-45-6789")):
            assert [(k, f"{phone} {other} x"[a:b]) for k, a, b in pii.entities(f"{phone} {other} x")] == [("phone", phone), (kind, other)]
    for ip in ("2001:db8::ff00:42:8329", "fe80::1", "2001:0DB8:0:0:0:0:0:1", "::ffff:102:304"):
        assert [(k, f"at {ip}, x"[a:b]) for k, a, b in pii.entities(f"at {ip}, x")] == [("ip", ip)]
    assert not [k for t in ("on 01.02.2024 at 10:30:45", "std::add a::b", "password: ********", "_@-.com", "in 2024-01-02 10 of 12") for k, _, _ in pii.entities(t)]
    s = pii.Surrogates(b"key")
    assert s.canonical("ip", s.of("ip", "2001:db8::1")) == s.canonical("ip", s.of("ip", "2001:0DB8:0:0:0:0:0:1"))
    for text in ("password: пароль12", "at fe80::1", "Tel 06 12 34 56 78", "Tel 612 345 678"):
        new = surrogate_text(s, text)
        assert new != text and [k for k, _, _ in pii.entities(new)] == [k for k, _, _ in pii.entities(text)]
    assert not set("пароль") <= set(surrogate_text(s, "password: пароль12"))


def test_no_entity_is_its_own_surrogate(spark):
    for key in (queries.PII_KEY, *(b"key %d" % i for i in range(50))):
        s = pii.Surrogates(key)
        for names in pii.NAMES.values():
            new = [s.name(n) for n in names]
            assert sorted(new) == sorted(names) and not any(a == b for a, b in zip(new, names))
        assert len({s.email(f"{c}@x.org") for c in "abcdefghijklmnopqrstuvwxyz"}) == 26 and all(s.email(f"{c}@x.org")[0] != c for c in "abcdefghijklmnopqrstuvwxyz")
        assert s.name("Éé") != "Éé" and s.ip("10.1.2.3") != "10.1.2.3" and s.ip("192.168.0.1") != "192.168.0.1"
    every = [[a, b, c] for a in range(15) for b in range(10) for c in range(10)]
    new = [s.permuted("t", x, [15, 10, 10]) for x in every]
    assert sorted(new) == every and not any(a == b for a, b in zip(new, every))
    assert [b - a for (a, *_), (b, *_) in zip(every[::100], new[::100])] != [0] * 15
    steps = {(pii.NAMES["latin", "f"].index(s.name(n)) - i) % 30 for i, n in enumerate(pii.NAMES["latin", "f"])}
    assert len(steps) > 1  # no rotation
    pairs = "type string, entity string, surrogate string"
    assert pii.collisions(spark.createDataFrame([("name", "мария", "мария"), ("name", "анна", "вера")], pairs)).count() == 1


def test_names_without_titles_and_their_later_mentions(spark):
    for before, name, after in (("Contact ", "Maria Garcia", ", please"), ("then ", "John Smith", " went"), ("Dr ", "J. Smith", " said"), ("Mr ", "SMITH", " said"), ("Mr ", "O'Brien", " said"), ("Mr ", "McDonald", " said"),
                                ("Herr ", "Ludwig van Beethoven", " und"), ("Frau ", "Ana Belén López García", " y"), ("the ", "JOHN SMITH", " x"), ("Herr ", "von Bismarck", " und"), ("и ", "Мария Петрова", " там")):
        text = before + name + after
        assert [(k, text[a:b]) for k, a, b in pii.entities(text)] == [("name", name)]
    text = "Earlier, Smith. Mr John Smith (JOHN) and Mr O'Brien met; then O'Brien told Smith's friend Blacksmith, and smith."
    assert [(k, text[a:b]) for k, a, b in pii.entities(text)] == [("mention", "Smith"), ("name", "John Smith"), ("mention", "JOHN"), ("name", "O'Brien"), ("mention", "O'Brien"), ("mention", "Smith")]
    s = pii.Surrogates(b"key")
    new = surrogate_text(s, text)
    smith, john = s.name("Smith"), s.name("John")
    assert new == f"Earlier, {smith}. Mr {john} {smith} ({john.upper()}) and Mr {s.name("O'Brien")} met; then {s.name("O'Brien")} told {smith}'s friend Blacksmith, and smith."
    assert [k for k, _, _ in pii.entities(new)] == [k for k, _, _ in pii.entities(text)] and s.name("Ludwig van Beethoven").split(" ")[1] == "van"
    got = pii.replaced(docs(spark, text), b"key").collect()[0]
    assert (got["text"], got["n_name"], got["n_mention"]) == (new, 2, 4)


# --- pipeline -------------------------------------------------------------------------------------


def test_pipeline_equals_its_stages_one_by_one(spark, sf_dir, model):
    given = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels, bench = spark.read.parquet(f"{sf_dir}/labels.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    texts = {r["doc_id"]: r["text"] for r in given.collect()}
    fitted = toxicity.fit(given, labels)
    windows = toxicity.Windows(fitted.dictionaries)
    p = toxicity._probability((windows.features(list(texts.values())) - fitted.mean) / fitted.scale, np.array(fitted.weights))
    kept = {i: t for (i, t), s in zip(texts.items(), p) if s < 0.5}
    roots = brute_components({i: simhash.fingerprint(t) for i, t in kept.items()})
    kept = {i: t for i, t in kept.items() if roots[i] == i}
    hit = brute_contamination(list(kept.values()), [(r["item_id"], r["text"]) for r in bench.collect()])
    kept = {i: t for (i, t), h in zip(kept.items(), hit) if not h[4]}
    s = pii.Surrogates(queries.PII_KEY)

    def replaced(t):
        for kind, a, b in reversed(list(pii.entities(t))):
            t = t[:a] + s.of(kind, t[a:b]) + t[b:]
        return t

    got = {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got == {i: model.encode(replaced(t)) for i, t in kept.items()}
    assert len(corpus_pipeline.STAGES) == 5


def test_stages_with_nulls_copies_and_clashing_columns(spark, sf_dir):
    given = docs(spark, None, "", "write to jo.doe@mail.example about the seven green boats", "write to jo.doe@mail.example about the seven green boats", "a quite different text of its own words here")
    given = given.withColumns({c: F.col("doc_id") + 100 for c in ("__r", "__fp", "fp", "n_hit", "component_id", "counts")})
    left = corpus_pipeline.drop_near_copies(spark, given, sf_dir)
    assert left.columns == given.columns and {r["doc_id"] for r in left.collect()} == {0, 2, 4}
    clean = corpus_pipeline.drop_contaminated(spark, left, sf_dir)
    assert clean.columns == given.columns and {r["doc_id"] for r in clean.collect()} == {0, 2, 4}
    got = corpus_pipeline.replace_personal_data(spark, clean, sf_dir)
    assert got.columns == given.columns
    by_id = {r["doc_id"]: r for r in got.collect()}
    assert by_id[0]["text"] is None and "jo.doe@" not in by_id[2]["text"] and by_id[4]["text"] == "a quite different text of its own words here"
    assert all(r["__r"] == i + 100 and r["__fp"] == i + 100 and r["n_hit"] == i + 100 for i, r in by_id.items())
    assert corpus_pipeline.replace_personal_data(spark, corpus_pipeline.drop_near_copies(spark, given.limit(0), sf_dir), sf_dir).count() == 0
