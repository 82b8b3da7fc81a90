"""Exact encoding and decoding with a byte-fallback BPE model of the sentencepiece library, without that library.

The last token of a text's encoding is the same whatever the text goes on with, so long as the encoding breaks
there; every prefix of a text has exactly one last token. A table holds that token for each prefix: of the vocabulary's
entries that end at a place (an automaton finds them), the one that may stand behind the last token of the
prefix before it. Whether two tokens may stand side by side is a test of just those two: their own merges are
replayed at the seam, and the pair stands unless a merge across the seam would have come first. The ids
are then read off the table backwards.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import arrow_function, bounded_batches, worker_slot

MARK = "▁"
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6
_NEVER = float("inf")
#: Entries a worker keeps: encoded stretches between spaces, and tested pairs. Only what it keeps is bounded; the rest is worked out again.
KEPT_STRETCHES, KEPT_PAIRS, KEPT_LENGTH = 300_000, 800_000, 48


def _fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of a protocol buffer message's fields."""
    i = 0

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            byte = b[i]
            i += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while i < len(b):
        number, kind = divmod(varint(), 8)
        if kind == 0:
            yield number, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield number, b[i : i + size]
            i += size


class _Kept(dict):
    """Keeps what is added. When it holds more than half of ``most`` it starts anew, but still finds what it held last."""

    def __init__(self, most: int):
        super().__init__()
        self.half, self.older = most // 2, {}

    def __missing__(self, key):
        return self.older.get(key)

    def trim(self) -> None:
        if len(self) > self.half:
            self.older = dict(self)
            self.clear()


class _Automaton:
    """Finds the longest token that ends at each place of a text, and those that are ends of it.

    A state is a beginning of tokens: ``on`` has the characters it goes on with, ``fail`` the longest of its ends that is a
    state too, ``tokens`` the (length, id) of the tokens that end in it, longest first.
    """

    def __init__(self, tokens: dict[str, int]):
        self.on: list[dict[str, int]] = [{}]
        own: dict[int, tuple[int, int]] = {}
        for token, i in tokens.items():
            state = 0
            for c in token:
                if c not in self.on[state]:
                    self.on[state][c] = len(self.on)
                    self.on.append({})
                state = self.on[state][c]
            own[state] = (len(token), i)
        self.fail = [0] * len(self.on)
        self.tokens: list[tuple[tuple[int, int], ...]] = [()] * len(self.on)
        level = list(self.on[0].values())
        for state in level:  # grows by the states below, so that shorter beginnings come first
            shorter = self.tokens[self.fail[state]]
            self.tokens[state] = (own[state], *shorter) if state in own else shorter
            for c, new in self.on[state].items():
                back = self.fail[state]
                while back and c not in self.on[back]:
                    back = self.fail[back]
                self.fail[new] = self.on[back].get(c, 0)
                level.append(new)


class Model:
    """A BPE model with byte fallback, the identity as normaliser and a dummy prefix; ValueError for any other."""

    def __init__(self, raw: bytes):
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        scores: list[float] = []
        trainer: dict = {}
        normalizer: dict = {}
        for number, value in _fields(raw):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece[1].decode())
                scores.append(struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0])
                self.kinds.append(piece.get(3, _NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normalizer = dict(_fields(value))
        if trainer.get(3) != 2 or not trainer.get(35):
            raise ValueError("not a BPE model with byte fallback")
        if normalizer.get(1) != b"identity" or normalizer.get(2) or not normalizer.get(3, 1) or normalizer.get(4, 1) or not normalizer.get(5, 1):
            raise ValueError("its normaliser is not the identity with a dummy prefix")
        if set(self.kinds) - {_NORMAL, _UNKNOWN, _CONTROL, _BYTE}:
            raise ValueError("it has user-defined or unused pieces")
        normal = [i for i, k in enumerate(self.kinds) if k == _NORMAL]
        self.id = {self.pieces[i]: i for i in normal}
        self.bytes = {int(self.pieces[i][3:5], 16): i for i, k in enumerate(self.kinds) if k == _BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        if any(c not in self.id for p in self.id for c in p):
            raise ValueError("a character of a piece is no piece")
        if any(MARK in p.lstrip(MARK) for p in self.id):
            raise ValueError("a piece has a space behind another character")
        #: Merges come in the order of falling scores.
        self.rank = {self.pieces[i]: r for r, i in enumerate(sorted(normal, key=lambda i: (-scores[i], i))) if len(self.pieces[i]) > 1}
        #: What stands at the edges of each token as it is merged, and whether its merges come in the order of their ranks.
        self.left: dict[int, list[tuple[str, float]]] = {}
        self.right: dict[int, list[tuple[str, float]]] = {}
        self.in_order: dict[int, bool] = {}
        for p, i in self.id.items():
            end, steps = self._merges(p)
            if end == [p]:  # others never come out of an encoding
                self.left[i], self.right[i] = self._edges(p, steps)
                ranks = [r for r, _, _ in steps]
                self.in_order[i] = ranks == sorted(ranks)
        self.automaton = _Automaton({self.pieces[i]: i for i in self.left})
        #: Tested pairs of tokens: the first one's id times the number of pieces, and the second one's.
        self.pairs = _Kept(KEPT_PAIRS)
        #: Stretches that no token crosses: spaces and what follows them, and line ends unless a piece has one.
        self._stretch = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n" if "\n" not in self.id else f"{MARK}*[^{MARK}]+|{MARK}+")
        self.stretches = _Kept(KEPT_STRETCHES)
        self.decimal = [str(i) for i in range(len(self.pieces))]
        self.shown = [p.replace(MARK, " ") if k == _NORMAL else None for p, k in zip(self.pieces, self.kinds)]

    def _merges(self, text: str) -> tuple[list[str], list[tuple[int, int, int]]]:
        """What a text of known characters is merged to, and the merges in order: rank, and how many characters precede and follow."""
        parts, steps = list(text), []
        while True:
            ranked = [(self.rank[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.rank]
            if not ranked:
                return parts, steps
            r, i = min(ranked)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            steps.append((r, sum(map(len, parts[:i])), sum(map(len, parts[i + 1 :]))))

    @staticmethod
    def _edges(p: str, steps) -> tuple[list[tuple[str, float]], list[tuple[str, float]]]:
        """What stands at the left and at the right edge of a token as it is merged, each with the rank of the merge that ends it."""
        left = [(1, -1)] + [(len(p) - behind, r) for r, before, behind in steps if not before]
        right = [(1, -1)] + [(len(p) - before, r) for r, before, behind in steps if not behind]
        ends = lambda edge: [*(r for _, r in edge[1:]), _NEVER]
        return [(p[:n], r) for (n, _), r in zip(left, ends(left))], [(p[-n:], r) for (n, _), r in zip(right, ends(right))]

    def may_follow(self, a: int, b: int) -> bool:
        """Whether a text made of two tokens, merged from its characters, gives just these."""
        if not (self.in_order[a] and self.in_order[b]):
            return self._merges(self.pieces[a] + self.pieces[b])[0] == [self.pieces[a], self.pieces[b]]
        rank, right, left = self.rank.get, self.right[a], self.left[b]
        i = j = 0
        while True:
            end, inner_a = right[i]
            start, inner_b = left[j]
            across = rank(end + start)
            # of equal ranks the leftmost merge is first
            if across is not None and across < inner_a and across <= inner_b:
                return False
            if inner_a <= inner_b:
                if inner_a == _NEVER:
                    return True
                i += 1
            else:
                j += 1

    def _follows(self, a: int, b: int) -> bool:
        """``may_follow``, kept."""
        self.pairs.trim()
        known = self.pairs[a * len(self.pieces) + b] = self.may_follow(a, b)
        return known

    def _ids(self, stretches: list[str]) -> Iterator[list[int]]:
        """The ids of each stretch. They come sorted, and a stretch takes over the table of the beginning that it shares with the one before."""
        on, fail, tokens, pairs, width = self.automaton.on, self.automaton.fail, self.automaton.tokens, self.pairs, len(self.pieces)
        states, last, sizes = [0], [-1], [0]  # the automaton's state, the last token of each prefix and its length; -1: none, or a character that is no piece
        before = ""
        for stretch in stretches:
            same = 0
            for x, y in zip(stretch, before):
                if x != y:
                    break
                same += 1
            del states[same + 1 :], last[same + 1 :], sizes[same + 1 :]
            state = states[same]
            for end, c in enumerate(stretch[same:], same + 1):
                while (goes := on[state].get(c)) is None and state:
                    state = fail[state]
                state = goes or 0
                states.append(state)
                for size, token in tokens[state]:
                    left = last[end - size]
                    if left < 0 or ((known := pairs[left * width + token]) is None and self._follows(left, token)) or known:
                        last.append(token)
                        sizes.append(size)
                        break
                else:
                    last.append(-1)
                    sizes.append(1)
            ids, i = [], len(stretch)
            while i:
                if last[i] >= 0:
                    ids.append(last[i])
                elif stretch[i - 1] in self.id:
                    raise AssertionError(f"no last token behind {stretch[:i]!r}")
                else:
                    ids.extend(self.bytes[b] for b in reversed(stretch[i - 1].encode()))
                i -= sizes[i]
            ids.reverse()
            yield ids
            before = stretch

    def parts(self, texts: list[str | None]) -> list[list[tuple[str, str]]]:
        """For each stretch of each text its ids, joined by commas, and what they decode to. Each distinct stretch is encoded once."""
        split = [self._stretch.findall(MARK + text.replace(" ", MARK)) if text else [] for text in texts]
        kept = self.stretches
        kept.trim()
        new = []
        for s in {s for stretches in split for s in stretches if s not in kept}:
            old = kept[s]
            if old is None:
                new.append(s)
            else:
                kept[s] = old
        new.sort()
        decimal, shown = self.decimal, self.shown
        for s, ids in zip(new, self._ids(new)):
            plain = [shown[i] for i in ids]
            kept[s] = ",".join([decimal[i] for i in ids]), self._plain(ids) if None in plain else "".join(plain)
        out = [[kept[s] for s in stretches] for stretches in split]
        for s in new:
            if len(s) > KEPT_LENGTH:
                del kept[s]
        return out

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for p in self.parts([text])[0] for i in p[0].split(",")]

    def _plain(self, ids) -> str:
        out, run = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            if run:
                out.append(_utf8(bytes(run)))
                run.clear()
            if self.kinds[i] == _UNKNOWN:
                out.append(" ⁇ ")
            elif self.kinds[i] != _CONTROL:
                out.append(self.pieces[i].replace(MARK, " "))
        if run:
            out.append(_utf8(bytes(run)))
        return "".join(out)

    def decode(self, ids) -> str:
        """The text of a list of ids; the dummy prefix is taken off."""
        ids = list(ids)
        text = self._plain(ids)
        first = next((i for i in ids if self.kinds[i] != _CONTROL), None)
        return text[1:] if first is not None and self.kinds[first] == _NORMAL and self.pieces[first].startswith(MARK) else text


def _utf8(run: bytes) -> str:
    """Bytes as text; each byte that starts no whole character becomes U+FFFD."""
    out, i = [], 0
    while i < len(run):
        for n in (1, 2, 3, 4):
            try:
                out.append(run[i : i + n].decode())
                i += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            i += 1
    return "".join(out)


def model_of(raw: bytes) -> Model:
    """The model of a file's bytes, built once in each process."""
    return worker_slot("sentencepiece", hashlib.sha256(raw).digest(), lambda: Model(raw))


_TYPE = pa.struct([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
_WITH_IDS = pa.struct([*_TYPE, pa.field("ids", pa.list_(pa.int32()))])


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _encoder(raw: bytes, with_ids: bool):
    kind = _WITH_IDS if with_ids else _TYPE

    @arrow_function(kind)
    def encode(texts: pa.Array) -> pa.Array:
        model = model_of(raw)
        sizes, id_digests, text_digests, ids_of = [], [], [], []
        for parts in model.parts(texts.to_pylist()):
            ids, decoded = ",".join([p[0] for p in parts]), "".join([p[1] for p in parts])[1:]  # without the dummy prefix
            sizes.append(ids.count(",") + 1 if ids else 0)
            id_digests.append(_sha(ids))
            text_digests.append(_sha(decoded))
            if with_ids:
                ids_of.append(np.fromstring(ids, np.int32, sep=","))
        columns = [pa.array(sizes, pa.int64()), pa.array(id_digests, pa.string()), pa.array(text_digests, pa.string())]
        if with_ids:
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids_of])]).astype(np.int32)
            columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*ids_of, np.empty(0, np.int32)]))))
        return pa.StructArray.from_arrays(columns, fields=list(kind))

    return encode


def read_model(path: str) -> bytes:
    """The model file (a vocabulary: bounded), read on the driver and sent along with the function."""
    with open(path, "rb") as f:
        return f.read()


def token_digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for every row; a null text is an empty one. Extra columns are not read."""
    bounded_batches(docs.sparkSession)
    got = docs.select(F.col(f"`{id_col}`").alias("doc_id"), _encoder(read_model(model_path), False)(F.col(f"`{text_col}`")).alias("r"))
    return got.select("doc_id", "r.n_tokens", "r.ids_sha256", "r.decoded_sha256")


def tokenized(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``token_digests`` with the ids themselves, as an array of integers."""
    bounded_batches(docs.sparkSession)
    got = docs.select(F.col(f"`{id_col}`").alias("doc_id"), _encoder(read_model(model_path), True)(F.col(f"`{text_col}`")).alias("r"))
    return got.select("doc_id", "r.n_tokens", "r.ids_sha256", "r.decoded_sha256", "r.ids")
