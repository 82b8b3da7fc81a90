"""Toxicity by compression distance: windows of a text are compressed with zstandard dictionaries of toxic and of ordinary text.

The labelled sample is dealt into parts, and in each part one dictionary is trained on the toxic and one on the ordinary
documents. What a window saves under the toxic one is how many bytes shorter it comes out than under the ordinary one. Text that only chance
put into one document is in one part's dictionary alone, while text that toxic documents have in common is in all of them, so the
mean over the parts is compared with thresholds. A window is a word between its spaces, two bytes a character: sizes are whole
bytes, and one saved character must show. How well the dictionaries know a document's language is in all its windows, so a window's saving is
compared with the document's mean. A document is told by how many of its windows save more than each threshold beyond it, and by
a logistic calibration of these counts on the sample, where a document is never judged by the part that it is in. Every window is compressed under every part.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import arrow_function, bounded_batches, crc_mod, worker_slot

#: The labelled sample that a model is fitted on: so many documents of each class, of at most so many characters: 40 million in all.
SAMPLE_TOXIC, SAMPLE_ORDINARY, SAMPLE_CHARS = 2_000, 2_000, 10_000
REJECT_FROM = 0.5
#: Parts of the sample, each with its two dictionaries of at most so many bytes; a part has at least PART_DOCS toxic documents, if there are two parts.
PARTS, PART_DOCS, DICTIONARY_BYTES = 24, 6, 65_536
#: Dictionaries are trained on runs of so many words, by segments of SEGMENT bytes that are chosen for the strings of MATCH bytes that they hold.
RUN_WORDS, SEGMENT, MATCH = 8, 32, 8
SAVINGS = np.array((1, 1.5, 2, 2.5, 3, 3.5, 4, 4.5, 5, 5.5, 6, 7))
KEPT_WORDS, KEPT_LENGTH = 400_000, 40


def _windows(text: str | None, words: int = 1) -> list[str]:
    w = (text or "").lower().split()
    return [f" {' '.join(w[i : i + words])} " for i in range(0, len(w), words)]


def _bytes(window: str) -> bytes:
    return window.encode("utf-16-le", "surrogatepass")


def _dictionary(texts: list[str]) -> bytes:
    """A dictionary trained on texts; where they are too few or too short to train one, their last bytes."""
    samples = [_bytes(w) for t in texts for w in _windows(t, RUN_WORDS)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=SEGMENT, d=MATCH, level=3).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


@dataclass(frozen=True)
class Model:
    """What is sent to the workers: (toxic, ordinary) dictionaries of each part, at most 3 MB, and the calibration."""

    dictionaries: tuple[tuple[bytes, bytes], ...] = ()
    mean: tuple[float, ...] = ()
    scale: tuple[float, ...] = ()
    weights: tuple[float, ...] = ()
    prior: float = 0.0

    def digest(self) -> bytes:
        return hashlib.sha256(b"".join(d for pair in self.dictionaries for d in pair)).digest()


def _sizes(content: bytes):
    """A function from windows to their compressed sizes."""
    how = zstandard.ZstdCompressionParameters.from_level(3, min_match=5, write_content_size=False, write_checksum=False, write_dict_id=False)
    known = zstandard.ZstdCompressionDict(content)
    known.precompute_compress(compression_params=how)
    compressor = zstandard.ZstdCompressor(compression_params=how, dict_data=known)

    def sizes(windows: list[bytes]) -> np.ndarray:
        return np.array([len(x) for x in compressor.multi_compress_to_buffer(windows)], np.float64)

    return sizes


class Windows:
    """Compresses windows with the dictionaries of a model."""

    def __init__(self, dictionaries):
        self.parts = [(_sizes(toxic), _sizes(ordinary)) for toxic, ordinary in dictionaries]
        self.kept: dict[str, float] = {}

    def savings(self, windows: list[str]) -> np.ndarray:
        """What each window saves under each part."""
        given = [_bytes(w) for w in windows]
        return np.array([ordinary(given) - toxic(given) for toxic, ordinary in self.parts]).T

    def features(self, texts: list[str | None]) -> np.ndarray:
        """The features of each text. Each distinct window is compressed once; a bounded number of them is kept."""
        split, kept = [_windows(t) for t in texts], self.kept
        if len(kept) > KEPT_WORDS:
            kept.clear()
        new = list(dict.fromkeys(w for windows in split for w in windows if w not in kept))
        if new:
            kept.update(zip(new, self.savings(new).mean(1).tolist()))
        out = np.array([summary(np.array([kept[w] for w in windows])) for windows in split]).reshape(-1, FEATURES)
        for w in new:
            if len(w) > KEPT_LENGTH:
                del kept[w]
        return out


FEATURES = 2 * len(SAVINGS) + 2


def summary(saved: np.ndarray) -> np.ndarray:
    """How many windows, and which share, save each of SAVINGS or more beyond the mean, the mean, and the number of windows; zeros without any."""
    n = len(saved)
    if not n:
        return np.zeros(FEATURES)
    over = n - np.bincount(np.searchsorted(SAVINGS, np.round(saved - saved.mean(), 6), "right"), minlength=len(SAVINGS) + 1).cumsum()[:-1]
    return np.concatenate([np.log1p(over), over / n, [saved.mean(), np.log1p(n)]])


def _scorer(model: Model):
    key = model.digest()

    @arrow_function(pa.float64())
    def score(texts: pa.Array) -> pa.Array:
        if not model.weights:
            return pa.array([model.prior] * len(texts), pa.float64())
        x = worker_slot("toxicity", key, lambda: Windows(model.dictionaries)).features(texts.to_pylist())
        return pa.array(_probability((x - model.mean) / model.scale, np.array(model.weights)))

    return score


def _probability(z: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z @ w[:-1] + w[-1], -30, 30)))


def _calibrated(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, steps: int = 40):
    """Logistic regression by Newton steps on standardised features: (mean, scale, weights with the intercept last)."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = _probability(z[:, :-1], w)
        slope = z.T @ (weight * (p - y)) / weight.sum() + ridge * w
        bend = (z * (weight * p * (1 - p))[:, None]).T @ z / weight.sum() + ridge * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


def labelled(labels: DataFrame, label_col: str, fold_modulus: int, held_out: int) -> DataFrame:
    """(doc_id, label) outside the held-out fold; ids without a label of 0 or 1, or with both, are left out."""
    rows = labels.select("doc_id", F.col(label_col).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
    rows = rows.where(crc_mod("doc_id", fold_modulus) != held_out)
    return rows.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").select("doc_id", "label")


def fit(docs: DataFrame, labels: DataFrame, fold_modulus: int = 5, held_out: int = 0) -> Model:
    """A model from a bounded sample of labelled documents: of those in ``docs`` with a text of at most SAMPLE_CHARS characters, the first SAMPLE_TOXIC and SAMPLE_ORDINARY by a hash of their ids.

    The sample's ids choose the texts by a broadcast join (bounded by the sample's size); an id that repeats gives its least text. Ids without a label of 0 or 1, or with both, are left out. Without labels, or with only one class, every score is the share of toxic labels.
    """
    known = labelled(labels, "toxic", fold_modulus, held_out)
    short = docs.where(F.length("text") <= SAMPLE_CHARS).select("doc_id", "text")
    present = known.join(short.select("doc_id"), "doc_id", "left_semi")
    first = lambda label, n: present.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    sample = first(1, SAMPLE_TOXIC).union(first(0, SAMPLE_ORDINARY)).withColumnRenamed("doc_id", "__id")
    texts = short.join(F.broadcast(sample), F.col("doc_id") == F.col("__id")).groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    rows = sorted((r["doc_id"], r["text"], r["label"]) for r in texts.collect())  # a row for each id of the sample
    y = np.array([label for _, _, label in rows])
    toxic, ordinary = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(toxic) or not len(ordinary):
        return Model(prior=float(len(toxic) > 0))
    texts = [t for _, t, _ in rows]
    dictionaries, part = _trained(texts, toxic, ordinary)
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    weight = np.where(y == 1, counts[1] / len(toxic), counts[0] / len(ordinary))  # the sample's classes weigh as they do among all labels
    mean, scale, w = _calibrated(_judged_by_others(Windows(dictionaries), texts, part), y.astype(float), weight)
    return Model(dictionaries, tuple(mean), tuple(scale), tuple(w))


def _trained(texts: list[str], toxic: np.ndarray, ordinary: np.ndarray) -> tuple[tuple[tuple[bytes, bytes], ...], np.ndarray]:
    """The dictionaries of each part, and the part of each text. Both classes are dealt in turn, and the two of a part are trained on about equally much text."""
    parts = max(min(PARTS, len(toxic) // PART_DOCS, len(ordinary) // PART_DOCS), 2 if min(len(toxic), len(ordinary)) > 1 else 1)
    part = np.zeros(len(texts), int)
    part[toxic], part[ordinary] = np.arange(len(toxic)) % parts, np.arange(len(ordinary)) % parts
    out = []
    for j in range(parts):
        of_part = [[texts[i] for i in rows if part[i] == j] for rows in (toxic, ordinary)]
        least = min(sum(map(len, ts)) for ts in of_part)
        out.append(tuple(_dictionary(_up_to(ts, least)) for ts in of_part))
    return tuple(out), part


def _up_to(texts: list[str], chars: int) -> list[str]:
    """The first texts that hold so many characters together."""
    ends = np.cumsum([len(t) for t in texts])
    return texts[: int(np.searchsorted(ends, chars)) + 1]


def _judged_by_others(windows: Windows, texts: list[str], part: np.ndarray) -> np.ndarray:
    """The features of texts of the sample, each by the parts that it isn't in; by the one part, if there is no other."""
    place: dict[str, int] = {}
    split = [[place.setdefault(w, len(place)) for w in _windows(t)] for t in texts]
    savings = windows.savings(list(place)) if place else np.zeros((0, 1))
    others = lambda own: np.delete(savings, own, 1) if savings.shape[1] > 1 else savings
    means = {own: others(own).mean(1) for own in set(part.tolist())}
    return np.array([summary(means[own][at] if at else np.zeros(0)) for at, own in zip(split, part.tolist())])


def scored(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1 for every whole text, higher where it is likelier toxic; null and empty texts are scored as texts without words, repeated rows each. A column named like the score is replaced."""
    bounded_batches(docs.sparkSession)
    return docs.withColumn(score_col, _scorer(model)(F.col(f"`{text_col}`")))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``; rows with a null doc_id are not held out."""
    got = scored(docs.select("doc_id", "text"), fit(docs, labels))
    return got.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= REJECT_FROM).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, with their columns, whose score is under REJECT_FROM."""
    return docs.where(_scorer(fit(docs, labels))(F.col("text")) < REJECT_FROM)
