"""Benchmark decontamination: one automaton over all windows of the benchmark, one pass over the documents.

Texts are compared as sequences of words. Each word of the benchmark has a number, so a window of ten words is a
sequence of ten numbers and a document is a sequence with one number for each of its words (0 for words that the
benchmark lacks). An Aho-Corasick automaton over the windows finds every occurrence in one scan. An occurrence's
offsets in that sequence are the numbers of the document's words, and they are mapped to places in the original text.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import arrow_function, bounded_batches, checkpointed, without, worker_slot

WINDOW = 10
#: (window, item) pairs in one automaton, which takes some 300 bytes for each in a worker. Only a benchmark with more windows than that (some 20,000 items of 100 words) is scanned in blocks, one after the other.
BLOCK_PAIRS = 2_000_000

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) words [0-9A-Za-z and everything beyond ASCII]+, as UTF-8."""
    return (text or "").encode().translate(_FOLD).split()


def windows(text: str | None, n: int = WINDOW) -> set[str]:
    """Runs of n consecutive words, joined by spaces; a text of fewer words, but not none, is one window."""
    w = [x.decode() for x in words(text)]
    return {" ".join(w[i : i + n]) for i in range(max(len(w) - n, 0) + 1)} if w else set()


def spans_of(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of words, in order and apart, as (start, end) in characters of the original text."""
    out, starts, ends = [], {a for a, _ in runs}, {b - 1 for _, b in runs}
    for i, m in enumerate(_WORD.finditer(text)):
        if i in starts:
            begun = m.start()
        if i in ends:
            out.append((begun, m.end()))
            if len(out) == len(runs):
                break
    return out


class Scanner:
    """An Aho-Corasick automaton over (window, item id), in arrays with a place for each state; a state is a beginning of a window, 0 is the empty one.

    Most states go on with one word only: ``word`` and ``child``. What else a state goes on with is in ``more``, the first words are in ``first``.
    """

    def __init__(self, pairs: Iterable[tuple[str, str]]):
        self.number: dict[bytes, int] = {}
        self.word, self.child, self.fail, self.size, self.hit = (array("i", [0]) for _ in range(5))
        self.first: dict[int, int] = {}
        self.more: dict[int, int] = {}
        self.items_of: dict[int, list[int]] = {}
        ids: dict[str, int] = {}
        for window, item in pairs:
            self.items_of.setdefault(self._added(window), []).append(ids.setdefault(item, len(ids)))
        self.ids = list(ids)
        self._link()

    def _added(self, window: str) -> int:
        """The state of a whole window, made with those on the way to it."""
        state = 0
        for w in window.encode().split(b" "):
            x = self.number.setdefault(w, len(self.number) + 1)
            state = self._next(state, x) or self._grown(state, x)
        self.hit[state] = state
        return state

    def _next(self, state: int, x: int) -> int:
        if not state:
            return self.first.get(x, 0)
        return self.child[state] if self.word[state] == x else self.more.get(state << 32 | x, 0)

    def _grown(self, state: int, x: int) -> int:
        new = len(self.fail)
        for places in (self.word, self.child, self.fail, self.hit):
            places.append(0)
        self.size.append(self.size[state] + 1)
        if not state:
            self.first[x] = new
        elif not self.word[state]:
            self.word[state], self.child[state] = x, new
        else:
            self.more[state << 32 | x] = new
        return new

    def _link(self) -> None:
        """Where each state falls back to (``fail``), and the longest window that ends in it (``hit``), by growing size."""
        branches: dict[int, list[tuple[int, int]]] = {}
        for key, new in self.more.items():
            branches.setdefault(key >> 32, []).append((key & 0xFFFFFFFF, new))
        level = list(self.first.values())
        while level:
            below = []
            for state in level:
                for x, new in [(self.word[state], self.child[state]), *branches.get(state, ())] if self.word[state] else ():
                    back = self.fail[state]
                    while back and not self._next(back, x):
                        back = self.fail[back]
                    self.fail[new] = back = self._next(back, x)
                    self.hit[new] = self.hit[new] or self.hit[back]
                    below.append(new)
            level = below

    def scan(self, found: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged runs [start, end) of hit words, and the ids of the items whose windows occur."""
        runs: list[tuple[int, int]] = []
        seen: set[int] = set()
        number, first, word, child, more, fail, hit = self.number.get, self.first.get, self.word, self.child, self.more.get, self.fail, self.hit
        state = 0
        for end, x in enumerate([number(w, 0) for w in found], 1):
            if not x:
                state = 0
                continue
            while state:
                if word[state] == x:
                    state = child[state]
                    break
                if on := more(state << 32 | x):
                    state = on
                    break
                state = fail[state]
            else:
                state = first(x, 0)
            at = hit[state]
            while at:  # the longest window that ends here, then the shorter ones
                seen.add(at)
                start = end - self.size[at]
                while runs and runs[-1][1] >= start:
                    start = min(start, runs.pop()[0])
                runs.append((start, end))
                at = hit[fail[at]]
        return runs, {self.ids[i] for at in seen for i in self.items_of[at]}


#: What is known of a document after a block.
_FIELDS = "struct<n_words: bigint, runs: array<struct<start: bigint, end: bigint>>, spans: array<struct<start: bigint, end: bigint>>, items: array<string>>"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_TYPE = pa.struct([("n_words", pa.int64()), ("runs", _RUNS), ("spans", _RUNS), ("items", pa.list_(pa.string()))])


def merged(runs: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and out[-1][1] >= a:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _scan_with(block):
    """A function that adds to what earlier blocks have found; its scanner is kept in each worker."""

    @arrow_function(_TYPE)
    def scan(texts: pa.Array, so_far: pa.Array) -> pa.Array:
        scanner, out = worker_slot("decontamination", block.id, lambda: block.value), []
        as_rows = lambda pairs: [{"start": a, "end": b} for a, b in pairs]
        for text, old in zip(texts.to_pylist(), so_far.to_pylist()):
            found = words(text)
            runs, items = scanner.scan(found)
            if old:
                runs = merged([*runs, *((r["start"], r["end"]) for r in old["runs"])])
                items = items | set(old["items"])
            out.append({"n_words": len(found), "runs": as_rows(runs), "spans": as_rows(spans_of(text, runs) if runs else ()), "items": sorted(items)})
        return pa.array(out, _TYPE)

    return scan


class _Block:
    """The broadcast scanner of a block of pairs, with an id that workers can keep it by."""

    def __init__(self, pairs: DataFrame):
        spark = pairs.sparkSession
        self.sent = spark.sparkContext.broadcast(Scanner((r["window"], r["item_id"]) for r in pairs.toLocalIterator()))
        self.id = (spark.sparkContext.applicationId, self.sent._jbroadcast.id())

    def __getstate__(self):
        return {"sent": self.sent, "id": self.id}

    @property
    def value(self):
        return self.sent.value


def _windows_of(benchmark: DataFrame, n: int, item_col: str, text_col: str) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = sorted(windows(text, n))
                for i in range(0, len(found), 10_000):
                    part = found[i : i + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([item] * len(part), pa.string())], ["window", "item_id"])

    got = benchmark.where(F.col(f"`{item_col}`").isNotNull()).select(F.col(f"`{item_col}`").cast("string"), F.col(f"`{text_col}`").cast("string"))
    return got.mapInArrow(rows, "window string, item_id string").distinct()


def scanned(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """``docs`` with a column ``found``: n_words, the runs of hit words (numbers of words, from 0), the same runs as spans of characters of the text, and the ids, as sorted strings, of the items that occur.

    The benchmark's windows are counted first. Their automaton is broadcast, and the documents pass through one scan without a
    shuffle; a benchmark beyond ``block_pairs`` windows has an automaton and a scan for each block, side by side with what was found before.
    A null text has no words; an item with a null id or without words has no windows. Repeated rows stay repeated, no rows give no rows. A column named ``found`` is replaced.
    """
    bounded_batches(docs.sparkSession)
    pairs = checkpointed(_windows_of(benchmark, n, item_col, item_text_col))
    blocks = max(1, -(-pairs.count() // block_pairs))
    pairs = pairs.withColumn("block", F.pmod(F.xxhash64("window", "item_id"), F.lit(blocks)))
    out = without(docs, ["found"]).withColumn("found", F.lit(None).cast(_FIELDS))
    for k in range(blocks):
        if k and k % 3 == 0:
            out = checkpointed(out)  # each scan has a worker of its own: so many at a time
        out = out.withColumn("found", _scan_with(_Block(pairs.where(F.col("block") == k)))(F.col(f"`{text_col}`"), F.col("found")))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans) for every row of ``docs``; spans are the hit runs as (start, end) in characters of the text. No benchmark: nothing is hit. Extra columns are not read."""
    got = scanned(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")), benchmark, n, block_pairs=block_pairs)
    n_hit = F.aggregate("found.runs", F.lit(0).cast("long"), lambda total, r: total + r["end"] - r["start"])
    digest = F.sha2(F.array_join("found.items", ","), 256)
    got = got.select("doc_id", F.col("found.n_words").alias("n_words"), n_hit.alias("n_hit"), F.size("found.items").cast("long").alias("n_items"), digest.alias("items_sha256"), F.col("found.spans").alias("spans"))
    return got.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"), "spans")


def clean(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with their columns, in which no window of the benchmark occurs; rows with a null text or without words stay."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text_col}`").alias("text"))
    kept = scanned(rows, benchmark, n).where(F.size("found.runs") == 0)
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
