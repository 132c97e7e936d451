"""Conversations as training windows of bounded length.

Turns of a conversation go by in order. A running sum of their tokens decides where a window ends, so windows are
aligned to turns. Each window opens with the system turn, repeats the latest turns before it as far as they fit a smaller
budget, and goes on with new turns. Only new assistant turns are targets: a repeated one stands in the text with no loss.

A task holds one window at a time, however long the conversation is.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitpanel.llm.common import SEPARATORS, SLICE_BYTES, slices

BUDGET, HISTORY = 512, 128
SYSTEM, TARGET = "system", "assistant"
OPEN, BETWEEN, CLOSE = "### ", ": ", "</turn>\n"

# Characters that control strings are made of, and how texts and roles spell them.
_SPELL = {"\\": "\\\\", "#": "\\h", "<": "\\l", ":": "\\c"}
_MEAN = {v: k for k, v in _SPELL.items()}
_WORD = re.compile("[^" + "".join(map(chr, SEPARATORS)) + "]+")


def escape(text: str) -> str:
    """A text in which no control string can occur; colons are left, since only roles end at one."""
    return text.replace("\\", "\\\\").replace("#", "\\h").replace("<", "\\l")


def unescape(text: str) -> str:
    return re.sub(r"\\[\\hlc]", lambda m: _MEAN[m.group()], text)


def turn_text(role: str, text: str) -> str:
    return OPEN + escape(role).replace(":", "\\c") + BETWEEN + escape(text) + CLOSE


def parse(formatted: str) -> Iterator[tuple[str, str, int, int]]:
    """Role, text, and the offsets of the escaped text, for each turn of a formatted window."""
    at = 0
    while at < len(formatted):
        start = formatted.index(BETWEEN, at) + len(BETWEEN)
        end = formatted.index(CLOSE, start)
        yield unescape(formatted[at + len(OPEN) : start - len(BETWEEN)]), unescape(formatted[start:end]), start, end
        at = end + len(CLOSE)


def count_tokens(text: str) -> int:
    """Words of the text, and four for the marks of its turn."""
    return 4 + sum(1 for _ in _WORD.finditer(text))


@dataclass
class _Turn:
    role: str
    text: str
    tokens: int


@dataclass
class Window:
    text: str
    new_from: int
    loss: list[tuple[int, int]] = field(default_factory=list)
    n_tokens: int = 0


def windows(turns: Iterable[tuple[str, str]], budget: int = BUDGET, history: int = HISTORY) -> Iterator[Window]:
    """Cut the (role, text) turns of one conversation into windows.

    A window exceeds the budget only if the system turn and one new turn do so alone.
    """
    system: _Turn | None = None
    past: deque[_Turn] = deque()  # turns that may be repeated
    new: list[_Turn] = []
    head = total = past_tokens = 0
    first = True

    def build() -> Window:
        repeated = ([system] if system and not (first and new and new[0] is system) else []) + list(past)
        parts = [turn_text(t.role, t.text) for t in repeated]
        at = sum(map(len, parts))
        window = Window("", at, n_tokens=sum(t.tokens for t in repeated) + sum(t.tokens for t in new))
        for t in new:
            parts.append(turn_text(t.role, t.text))
            if t.role == TARGET:
                end = at + len(parts[-1]) - len(CLOSE)
                window.loss.append((end - len(escape(t.text)), end))
            at += len(parts[-1])
        window.text = "".join(parts)
        return window

    for role, text in turns:
        turn = _Turn(role, text, count_tokens(text))
        if first and not new and role == SYSTEM:
            system = turn
            new.append(turn)
            total += turn.tokens
            continue
        if new and any(t is not system for t in new) and head + past_tokens + total + turn.tokens > budget:
            yield build()
            for t in new:
                if t is not system:
                    past.append(t)
                    past_tokens += t.tokens
            first, new, total, head = False, [], 0, system.tokens if system else 0
        if not new or new == [system]:  # history gives way before new turns do
            while past and (past_tokens > history or head + past_tokens + turn.tokens > budget):
                past_tokens -= past.popleft().tokens
        new.append(turn)
        total += turn.tokens
    if new:
        yield build()


def _in_order(df: DataFrame, conversation: str, order: list[str], text: str) -> DataFrame:
    """Rows of a conversation one after the other in one task, which streams them."""
    return df.repartition(F.xxhash64(conversation)).sortWithinPartitions(conversation, *order, text)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for part in slices(batch, batch.num_columns - 1):
            yield from zip(*(c.to_pylist() for c in part.columns))


def format_windows(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                   budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """All conversations as windows: conv_id, window, text, new_from, loss, n_tokens.

    ``loss`` lists the [start, end) offsets, in code points of the window's text, that are targets; ``new_from`` is where
    turns begin that no earlier window has. Turns go by number, then role, then text (NULLs first); a NULL role or text
    counts as empty, and rows that repeat are turns of their own. Rows with a NULL conversation form one. Other columns are
    not looked at.
    """
    slim = turns.select(F.col(conversation).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
                        F.coalesce(F.col(text), F.lit("")).alias("text"))
    schema = T.StructType([slim.schema["conv_id"], *T._parse_datatype_string(
        "window int, text string, new_from int, loss array<struct<start:int,end:int>>, n_tokens int").fields])
    arrow = pa.schema([("window", pa.int32()), ("text", pa.string()), ("new_from", pa.int32()),
                       ("loss", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("n_tokens", pa.int32())])

    def run(batches):
        kind, held, size = None, [], 0

        def flush():
            cols = list(zip(*held))
            loss = [[{"start": a, "end": b} for a, b in spans] for spans in cols[4]]
            return pa.RecordBatch.from_arrays(
                [pa.array(cols[0], kind), *(pa.array(c, t) for c, t in zip((cols[1], cols[2], cols[3], loss, cols[5]), arrow.types))],
                names=["conv_id", *arrow.names])

        def typed():
            nonlocal kind
            for batch in batches:
                kind = batch.schema.field(0).type
                yield batch

        for conv, rows in groupby(_rows(typed()), key=lambda r: r[0]):
            for k, w in enumerate(windows(((r[2], r[3]) for r in rows), budget, history)):
                held.append((conv, k, w.text, w.new_from, w.loss, w.n_tokens))
                size += len(w.text)
                if size > SLICE_BYTES:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return _in_order(slim, "conv_id", ["turn", "role"], "text").mapInArrow(run, schema)


def read_back(formatted: DataFrame) -> DataFrame:
    """What windows say, read from their text alone, one row a conversation.

    conv_id, n_turns, turns_sha256 (role, line feed, text, line feed for every turn), loss_chars and loss_sha256 (the
    texts under the loss mask, unescaped), formatted_chars (of all windows).
    """
    slim = formatted.select("conv_id", "window", "new_from", "loss", "text")
    schema = T.StructType([slim.schema["conv_id"], *T._parse_datatype_string(
        "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long").fields])
    names = schema.fieldNames()

    def run(batches):
        kind, out = None, []

        def typed():
            nonlocal kind
            for batch in batches:
                kind = batch.schema.field(0).type
                yield batch

        def flush():
            cols = list(zip(*out))
            types = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

        for conv, rows in groupby(_rows(typed()), key=lambda r: r[0]):
            turns, loss, n, n_loss, size = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            for _, _, new_from, spans, text in rows:
                size += len(text)
                for role, said, _, _ in parse(text[new_from:]):
                    turns.update(f"{role}\n{said}\n".encode())
                    n += 1
                for span in spans:
                    target = unescape(text[span["start"] : span["end"]])
                    loss.update(target.encode())
                    n_loss += len(target)
            out.append((conv, n, turns.hexdigest(), n_loss, loss.hexdigest(), size))
            if len(out) >= 5000:
                yield flush()
                out = []
        if out:
            yield flush()

    return _in_order(slim, "conv_id", ["window"], "text").mapInArrow(run, schema)
