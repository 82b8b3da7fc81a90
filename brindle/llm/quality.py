"""Quality classifier: a sparse ensemble of rules.

A forest of shallow trees is grown over statistics of the text. Each path from a root to a node is a rule: a conjunction
of bounds on statistics. A logistic regression with a lasso penalty weighs the rules and drops most of
them; what is left is compiled into one Spark column expression over the statistics. Trees and
regression are Spark ML's, fitted on all labelled rows outside the held-out fold.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import arrow_function, bounded_batches, checkpointed, crc_mod

TREES, DEPTH, SEED = 24, 4, 7
LASSO = 2e-3
GOOD_FROM = 0.7

STATISTICS = (
    "n_chars n_words word_length short_words long_words letters upper digits punctuation marks newlines beyond_ascii distinct_words "
    "top_word same_as_last upper_words marked_words plain_words ending_words repeated_lines line_words repeated_pairs squeezed"
).split()
_CLASS = np.zeros(256, np.int64)  # 0 control, 1 space, 2 upper, 3 lower, 4 digit, 5 usual punctuation, 6 other marks, 7 beyond ASCII
for _c in range(256):
    _CLASS[_c] = 7 if _c > 127 else 1 if _c in (9, 10, 11, 12, 13, 32) else 2 if 65 <= _c <= 90 else 3 if 97 <= _c <= 122 else 4 if 48 <= _c <= 57 else 5 if chr(_c) in ".,;:?!'\"()-" else 6 if _c > 32 else 0


def statistics(text: str | None) -> list[float]:
    """The statistics of a whole text; all zero for null and empty texts."""
    raw = (text or "").encode()
    if not raw:
        return [0.0] * len(STATISTICS)
    histogram = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    by_class = np.bincount(_CLASS, histogram, 8)
    n = len(raw)
    words = raw.split()
    k = max(len(words), 1)
    counts = Counter(words)
    lengths = np.array([len(w) for w in words] or [0])
    pairs = len(set(zip(words, words[1:])))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return [
        math.log1p(n),
        math.log1p(len(words)),
        float(lengths.mean()),
        float((lengths <= 3).mean()),
        float((lengths >= 12).mean()),
        (by_class[2] + by_class[3] + by_class[7]) / n,
        by_class[2] / n,
        by_class[4] / n,
        by_class[5] / n,
        by_class[6] / n,
        histogram[10] / n,
        by_class[7] / n,
        len(counts) / k,
        max(counts.values(), default=0) / k,
        sum(map(bytes.__eq__, words, words[1:])) / k,
        sum(map(bytes.isupper, words)) / k,
        sum([w[-1] in _MARKS for w in words]) / k,
        sum(map(bytes.isalpha, words)) / k,
        sum([w[-1] in b".!?" for w in words]) / k,
        1 - len(set(lines)) / max(len(lines), 1),
        math.log1p(len(words) / max(len(lines), 1)),
        1 - pairs / max(len(words) - 1, 1),
        len(zlib.compress(raw, 1)) / n,
    ]


_MARKS = frozenset(b"#$%&*|@^~=+<>_\\/!")
_KIND = pa.list_(pa.float64())


@arrow_function(_KIND)
def _statistics(texts: pa.Array) -> pa.Array:
    return pa.array([statistics(t) for t in texts.to_pylist()], _KIND)


def with_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, and a double for each of STATISTICS) for every row of ``docs``."""
    bounded_batches(docs.sparkSession)
    got = docs.select("doc_id", _statistics("text").alias("s"))
    return got.select("doc_id", *[F.col("s")[i].alias(name) for i, name in enumerate(STATISTICS)])


@dataclass(frozen=True)
class Rule:
    """lower[i] < statistic <= upper[i] for each bound."""

    bounds: tuple[tuple[str, float, float], ...]

    def column(self) -> Column:
        parts = [F.col(name) > F.lit(low) for name, low, _ in self.bounds if low > -math.inf]
        parts += [F.col(name) <= F.lit(high) for name, _, high in self.bounds if high < math.inf]
        out = parts[0]
        for p in parts[1:]:
            out = out & p
        return out.cast("double")


_SPLIT = re.compile(r"( *)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)")


def rules_of(forest: str, names=STATISTICS) -> list[Rule]:
    """Every path of a forest's trees, given as their description, from the root to any node; each once."""
    found: dict[Rule, None] = {}
    path: list[tuple[int, str, bool, float]] = []
    for line in forest.splitlines():
        m = _SPLIT.match(line)
        if not m:
            continue
        depth = len(m[1])
        path = [p for p in path if p[0] < depth] + [(depth, names[int(m[2])], m[3] == ">", float(m[4]))]
        bounds: dict[str, list[float]] = {}
        for _, name, above, value in path:
            b = bounds.setdefault(name, [-math.inf, math.inf])
            b[0], b[1] = (max(b[0], value), b[1]) if above else (b[0], min(b[1], value))
        found[Rule(tuple(sorted((n, lo, hi) for n, (lo, hi) in bounds.items())))] = None
    return list(found)


@dataclass(frozen=True)
class Model:
    rules: tuple[tuple[Rule, float], ...]
    intercept: float

    def column(self) -> Column:
        """The score as an expression over the statistics."""
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + rule.column() * F.lit(weight)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def fit(stats: DataFrame, labels: DataFrame, fold_modulus: int = 4, held_out: int = 2) -> Model:
    """A model from all rows of ``labels`` outside the held-out fold whose label is 0 or 1; ids with both labels are left out.

    Without labels or with only one class the score is that class (0.5 without any).
    """
    rows = labels.select("doc_id", F.col("quality").cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
    rows = rows.where(crc_mod("doc_id", fold_modulus) != held_out)
    rows = rows.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("__other")).where("label = __other").drop("__other")
    known = checkpointed(stats.join(rows, "doc_id").select("label", array_to_vector(F.array(*STATISTICS)).alias("features"), *STATISTICS))
    classes = {r["label"] for r in known.select("label").distinct().collect()}
    if len(classes) < 2:
        return Model((), 30.0 if classes == {1} else -30.0 if classes else 0.0)
    forest = RandomForestClassifier(labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED, minInstancesPerNode=5, subsamplingRate=0.7, featureSubsetStrategy="onethird").fit(known.select("label", "features"))
    rules = rules_of(forest.toDebugString)
    if not rules:
        share = known.agg(F.avg("label")).first()[0]
        return Model((), math.log(share / (1 - share)))
    held = known.select("label", array_to_vector(F.array(*[r.column() for r in rules])).alias("features"))
    lasso = LogisticRegression(labelCol="label", elasticNetParam=1.0, regParam=LASSO, maxIter=60, tol=1e-5).fit(held)
    weights = lasso.coefficients.toArray()
    return Model(tuple((r, float(w)) for r, w in zip(rules, weights) if w), float(lasso.intercept))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``, null and empty texts included; a null doc_id is not held out.

    The texts are read once: their statistics are written to the shared folder, and both the fit and the scores take them from there.
    """
    stats = checkpointed(with_statistics(docs))
    score = fit(stats, labels).column()
    return stats.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), score.alias("score")).withColumn("predicted", (F.col("score") >= GOOD_FROM).cast("int"))
