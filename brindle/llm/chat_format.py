"""Chat formatting by a grammar round trip.

    conversation := turn*
    turn         := "<s>[INST] " text " [/INST]</s>\\n"               where the role is user
                  | "<s>[OUT]" text "</s>\\n"                         where the role is assistant
                  | "<s>[R:" role "] " text " [/R:]</s>\\n"           for any other role

Inside a text, a control string may not stand as it is. A turn is rendered with its text unchanged and read back
by the parser; only if what comes back differs from the source, the conflicting content is escaped: each
control string, already escaped or not, gets one more backslash behind its first character, and the parser takes one
away. That is exact for every text, so the second reading is always identical.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import arrow_function, bounded_batches

_CONTROLS = r"/?s>|/?INST\]|OUT\]|/?R:"
_FREE = re.compile(rf"([<\[])(\\*)(?={_CONTROLS})")
_ESCAPED = re.compile(rf"([<\[])\\(\\*)(?={_CONTROLS})")
#: Text up to the next control string that isn't escaped.
_TEXT = rf"[^<\[]*(?:(?![<\[](?:{_CONTROLS}))[<\[][^<\[]*)*"
_TURN = re.compile(rf"<s>(?:\[INST\] (?P<user>{_TEXT}) \[/INST\]|\[OUT\](?P<assistant>{_TEXT})|\[R:(?P<role>[A-Za-z_-]+|=[0-9a-f]*)\] (?P<text>{_TEXT}) \[/R:\])</s>\n")


def escape(text: str) -> str:
    return _FREE.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


def _render(role: str, text: str) -> str:
    if role == "user":
        return f"<s>[INST] {text} [/INST]</s>\n"
    if role == "assistant":
        return f"<s>[OUT]{text}</s>\n"
    return f"<s>[R:{_role_out(role)}] {text} [/R:]</s>\n"


def _role_out(role: str) -> str:
    """A role that is no known one, in hexadecimal where it holds anything but plain word characters."""
    return role if re.fullmatch(r"[A-Za-z_-]+", role) else "=" + role.encode().hex()


def _role_in(role: str) -> str:
    return bytes.fromhex(role[1:]).decode() if role.startswith("=") else role


def parse(rendered: str, at: int = 0) -> Iterator[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn; start and end bound the text, still escaped, in ``rendered``. ValueError where the grammar doesn't hold."""
    while at < len(rendered):
        m = _TURN.match(rendered, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        group = "user" if m["user"] is not None else "assistant" if m["assistant"] is not None else "text"
        role = _role_in(m["role"]) if group == "text" else group
        yield role, unescape(m[group]), *m.span(group)
        at = m.end()


def _reads_back(rendered: str, role: str, text: str) -> bool:
    try:
        return [(r, t) for r, t, _, _ in parse(rendered)] == [(role, text)]
    except ValueError:
        return False


def render(role: str | None, text: str | None) -> str:
    """One turn; null is the empty role or text."""
    role, text = role or "", text or ""
    plain = _render(role, text)
    if _reads_back(plain, role, text):
        return plain
    escaped = _render(role, escape(text))
    if not _reads_back(escaped, role, text):
        raise AssertionError(f"a turn can't be read back: {escaped!r}")
    return escaped


def loss_spans(rendered: str) -> list[tuple[int, int]]:
    """The loss mask: (start, end) of what an assistant says, in characters of a rendered text."""
    return [(start, end) for role, _, start, end in parse(rendered) if role == "assistant"]


_PART = pa.struct([("rendered", pa.string()), ("loss_spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


@arrow_function(_PART)
def _rendered(roles: pa.Array, texts: pa.Array) -> pa.Array:
    parts = [render(r, t) for r, t in zip(roles.to_pylist(), texts.to_pylist())]
    return pa.array([{"rendered": p, "loss_spans": [{"start": a, "end": b} for a, b in loss_spans(p)]} for p in parts], _PART)


def formatted(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, rendered, loss_spans): each row with its part of the conversation's training text and the loss mask over that part.

    A conversation's text is its parts by turn, one after the other; they are kept as rows so that a conversation with any number of turns is never held whole.
    """
    bounded_batches(conversations.sparkSession)
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return rows.withColumn("__part", _rendered("role", "text")).select("*", "__part.rendered", "__part.loss_spans").drop("__part")


_DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of conversations whose parts come sorted, one at a time."""
    now, begun, out = None, False, []

    def done():
        nonlocal out
        columns = list(zip(*out)) if out else [[]] * 6
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [f.split()[0] for f in _DIGEST.split(", ")])
        out = []
        return batch

    def close():
        out.append((now, turns, all_.hexdigest(), loss_chars, loss.hexdigest(), chars))

    for b in batches:
        for conv, rendered, spans in zip(*(b.column(c).to_pylist() for c in ("conv_id", "rendered", "loss_spans"))):
            if not begun or conv != now:
                if begun:
                    close()
                now, begun, turns, loss_chars, chars, all_, loss = conv, True, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
            for role, text, _, _ in parse(rendered):
                turns += 1
                all_.update(f"{role}\n{text}\n".encode())
            for span in spans:  # what is under the mask, unescaped
                said = unescape(rendered[span["start"] : span["end"]])
                loss_chars += len(said)
                loss.update(said.encode())
            chars += len(rendered)
        if len(out) >= 1_000:
            yield done()
    if begun:
        close()
    yield done()


def digests(formatted_rows: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from the rendered parts and their loss mask alone.

    Turns are taken by turn (null first), equal ones by role and text; repeated rows count as often as they stand. Rows with a
    null conv_id are one conversation. A conversation passes through one task as a stream: its digest needs its text
    in order, but only one batch of it is held.
    """
    parts = formatted_rows.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    return parts.select("conv_id", "rendered", "loss_spans").mapInArrow(_read_back, _DIGEST)
