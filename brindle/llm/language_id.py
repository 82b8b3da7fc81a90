"""Language by words first: a word that the model knows is scored by its frequency in each language, another one by its character n-grams.

A word, lower-cased, is a run of letters. A known word adds, for each language, the logarithm of its smoothed frequency there. An unknown
word is written between marks for its ends and looked up by its n-grams, the longest first: of the greatest length at which the model knows any, the mean
of the logarithms of their frequencies is what the word adds. A word without any known letter adds nothing. All words of a text count, each as often as it stands there.

The score is the share that the predicted language has of exp(sum / sqrt(words)): words of one text depend on each other, so
the sum of their logarithms overstates what is known. Texts that are null or without a letter, and all texts if nothing could be learnt, are ``und`` with a score of 0.
Ties go to the first language in order. A text's rows don't depend on other texts' rows; repeated ids and texts are scored each.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.common import arrow_function, bounded_batches, crc_mod, worker_slot

#: A model learns from at most so many labelled texts of at most so many characters, drawn by a hash and spread evenly over the languages (at most as many). SAMPLE_SPARE times as many are ranked.
SAMPLE_DOCS, SAMPLE_CHARS, SAMPLE_PARTS = 4_000, 10_000, 32
SAMPLE_SPARE = 3
LONGEST = 4
#: A word or n-gram that the sample has fewer times isn't known: what was seen once says little, and unseen words are like words seen once.
LEAST_WORD, LEAST_GRAM = 3, 2
SMOOTHING = 0.5
#: Words that a worker keeps the scores of.
KEPT_WORDS = 100_000
UNKNOWN = "und"
_RUN = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> list[str]:
    """The runs of letters of a whole text, lower-cased."""
    runs = _RUN.findall((text or "").lower())
    return runs if all(map(str.isalpha, runs)) else [w for r in runs for w in "".join(c if c.isalpha() else " " for c in r).split()]


def grams(word: str, n: int) -> list[str]:
    """The n-grams of a word between marks for its ends; of length 1 its letters."""
    marked = f"^{word}$" if n > 1 else word
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


@dataclass(frozen=True)
class Model:
    """languages; for words (n = 0) and for each length of n-gram, what is known and its count in each language."""

    languages: tuple[str, ...] = ()
    known: tuple[tuple[str, ...], ...] = ()
    counts: tuple[np.ndarray, ...] = ()

    def digest(self) -> bytes:
        return hashlib.sha256(b"".join([repr(self.languages).encode(), *("\0".join(k).encode("utf-8", "surrogatepass") + c.tobytes() for k, c in zip(self.known, self.counts))])).digest()

    def logarithms(self) -> list[np.ndarray]:
        """Of smoothed frequencies, among all that is known of one length."""
        return [np.log(c + SMOOTHING) - np.log(c.sum(0) + SMOOTHING * len(c)) for c in self.counts]


class Scorer:
    """Scores texts; the scores of a bounded number of words are kept as rows of one matrix."""

    def __init__(self, model: Model):
        self.languages = model.languages
        self.places = [{g: i for i, g in enumerate(k)} for k in model.known]
        self.tables = [np.vstack([t, np.zeros((1, len(self.languages)))]) for t in model.logarithms()]
        self._forget()

    def _forget(self) -> None:
        self.kept: dict[str, int] = {}
        self.rows = np.zeros((KEPT_WORDS, len(self.languages)))

    def of_words(self, new: list[str]) -> np.ndarray:
        """What each word adds for each language."""
        out = np.zeros((len(new), len(self.languages)))
        found: list[list[list[int]]] = [[] for _ in self.places]
        owners: list[list[int]] = [[] for _ in self.places]
        for i, w in enumerate(new):
            known = self.places[0].get(w)
            if known is not None:
                found[0].append([known])
                owners[0].append(i)
                continue
            for n in range(len(self.places) - 1, 0, -1):
                places = self.places[n]
                at = [places[g] for g in grams(w, n) if g in places]
                if at:
                    found[n].append(at)
                    owners[n].append(i)
                    break
        for table, at, own in zip(self.tables, found, owners):
            if at:
                sizes = np.array([len(x) for x in at])
                out[own] = np.add.reduceat(table[np.fromiter(chain.from_iterable(at), np.int64)], np.cumsum(sizes) - sizes, axis=0) / sizes[:, None]
        return out

    def _keep(self, found: set[str]) -> None:
        """Scores of all these words, at most KEPT_WORDS, are kept from here on; others are given up if there is no room."""
        new = [w for w in found if w not in self.kept]
        if len(self.kept) + len(new) > KEPT_WORDS:
            self._forget()
            new = list(found)
        if new:
            self.rows[len(self.kept) : len(self.kept) + len(new)] = self.of_words(new)
            self.kept.update(zip(new, range(len(self.kept), len(self.kept) + len(new))))

    def texts(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, score) of each text."""
        split = [words(t) for t in texts]
        if len(all_ := set().union(*split)) <= KEPT_WORDS:
            self._keep(all_)
        return [self._one(found) for found in split]

    def _one(self, found: list[str]) -> tuple[str, float]:
        if not found or not self.languages:
            return UNKNOWN, 0.0
        total = np.zeros(len(self.languages))
        for i in range(0, len(found), KEPT_WORDS):
            part = found[i : i + KEPT_WORDS]
            try:
                at = [self.kept[w] for w in part]
            except KeyError:
                self._keep(set(part))
                at = [self.kept[w] for w in part]
            total += self.rows[at].sum(0)
        best = int(total.argmax())
        share = np.exp((total - total[best]) / math.sqrt(len(found)))
        return self.languages[best], float(1 / share.sum())


_COUNTS = pa.schema([("n", pa.int32()), ("gram", pa.string()), ("lang", pa.string()), ("count", pa.int64())])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words (n = 0) and n-grams of the sample's texts in this partition, counted for each language."""
    of: dict[str, Counter] = {}
    for batch in batches:
        for text, lang in zip(batch["text"].to_pylist(), batch["lang"].to_pylist()):
            of.setdefault(lang, Counter()).update(words(text))
    for lang, counts in of.items():
        kinds = [counts, *(Counter() for _ in range(LONGEST))]
        for w, times in counts.items():
            for n in range(1, LONGEST + 1):
                kind = kinds[n]
                for g in grams(w, n):
                    kind[g] += times
        for n, kind in enumerate(kinds):
            if kind:
                yield pa.RecordBatch.from_arrays([pa.array([n] * len(kind), pa.int32()), pa.array(list(kind)), pa.array([lang] * len(kind)), pa.array(list(kind.values()), pa.int64())], schema=_COUNTS)


def sample(docs: DataFrame, fold_modulus: int = 5, held_out: int = 0) -> DataFrame:
    """(lang, text): the texts that a model learns from. Only rows with a language and an id outside the held-out fold; a text that many rows of a language share counts once.

    A share of each language's texts, by their hash, is a few times what is wanted of it; only that is ranked, so no language's texts meet in one task.
    """
    fold = crc_mod("doc_id", fold_modulus)
    rows = docs.where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL").where((fold >= 0) & (fold != held_out)).where(F.length("text") <= SAMPLE_CHARS).select("lang", "text", F.xxhash64("text").alias("__h"))
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct("__h").alias("n")).orderBy(F.xxhash64("lang"), "lang").limit(SAMPLE_DOCS).collect()
    each = SAMPLE_DOCS // max(1, len(sizes))
    shares = rows.sparkSession.createDataFrame([(r["lang"], int(min(1.0, SAMPLE_SPARE * each / max(r["n"], 1)) * 2**32)) for r in sizes], "lang string, __share long")
    drawn = rows.join(F.broadcast(shares), "lang").where(F.pmod("__h", F.lit(2**32)) < F.col("__share")).groupBy("lang", "__h", "text").agg(F.count("*"))
    order = Window.partitionBy("lang").orderBy("__h", "text")
    return drawn.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= each).select("lang", "text")


def fit(docs: DataFrame, fold_modulus: int = 5, held_out: int = 0) -> Model:
    """A model of the sample. What it knows comes to the driver, at most as large as the sample's bound allows."""
    bounded_batches(docs.sparkSession)
    counts = sample(docs, fold_modulus, held_out).repartition(SAMPLE_PARTS).mapInArrow(_counted, "n int, gram string, lang string, count long").groupBy("n", "gram", "lang").agg(F.sum("count").alias("count"))
    known = counts.groupBy("n", "gram").agg(F.collect_list(F.struct("lang", "count")).alias("of"), F.sum("count").alias("all"))
    known = known.where(F.col("all") >= F.when(F.col("n") == 0, LEAST_WORD).otherwise(LEAST_GRAM)).select("n", "gram", F.map_from_entries("of").alias("of")).toArrow().sort_by([("n", "ascending"), ("gram", "ascending")])
    of = [dict(x) for x in known["of"].to_pylist()]
    found = tuple(sorted({lang for x in of for lang in x}))
    matrix = np.array([[x.get(lang, 0) for lang in found] for x in of], np.int64).reshape(len(of), len(found))
    n, names = known["n"].to_numpy(), known["gram"].to_pylist()
    places = [np.flatnonzero(n == k) for k in range(LONGEST + 1)]
    return Model(found, tuple(tuple(names[i] for i in at) for at in places), tuple(matrix[at] for at in places))


def languages(docs: DataFrame, model: Model) -> DataFrame:
    """docs' doc_id, with lang_pred and score."""
    bounded_batches(docs.sparkSession)
    key = model.digest()
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])

    @arrow_function(kind)
    def predict(texts: pa.Array) -> pa.Array:
        got = worker_slot("language_id", key, lambda: Scorer(model)).texts(texts.to_pylist())
        return pa.array([{"lang_pred": lang, "score": score} for lang, score in got], kind)

    return docs.select("doc_id", predict("text").alias("__p")).select("doc_id", "__p.lang_pred", "__p.score")


def language_id(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of ``docs``; a null doc_id is not held out, and isn't learnt from."""
    got = languages(docs, fit(docs))
    return got.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")
