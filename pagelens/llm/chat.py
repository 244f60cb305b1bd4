"""Operator 7: chat formatting in budgeted windows with a loss mask.

Turns of a conversation are streamed in order. Prefix sums of turn tokens choose spans of whole turns: a window holds
the conversation's first system turn, up to ``history`` turns repeated from before the span, and the longest span
that still fits the budget. A turn larger than the budget has a window of its own, whole, after the system turn. A
system turn that takes more than ``repeat_share`` of the budget stands in its own window only, and isn't repeated.
Repeated turns are masked: each assistant text counts for the loss once, in the window where it is new.

The template is ``<s>[ROLE] role [/ROLE]`` + text + ``</s>`` for every turn. ``\\`` and the control strings' first
characters ``<`` and ``[`` are escaped by a ``\\`` inside roles and texts, so no text can forge a mark, and reading
back is exact. Work is dealt by conversation and sorted by turn; a conversation is streamed, never gathered.

Null and odd input: a null text or role is empty; rows of equal (conv_id, turn) follow in order of role and text, and
repeated rows stay; null turns come first; a null conv_id is a conversation. An empty table gives no windows but the
extra conversation's, if asked for. Extra columns are left out.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table


@dataclass(frozen=True)
class Template:
    #: tokens, counted as white-space words and two marks a turn
    budget: int = 1024
    history: int = 2
    #: at most this share of the budget goes to repeated turns
    repeat_share: float = 0.5


_ESCAPE, _UNESCAPE = re.compile(r"[\\<\[]"), re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"<s>\[ROLE\] ((?:[^\\\[]|\\.)*) \[/ROLE\]((?:[^\\<]|\\.)*)</s>", re.S)


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn as formatted, and where its text starts and ends."""
    head = f"<s>[ROLE] {escape(role)} [/ROLE]"
    body = escape(text)
    return f"{head}{body}</s>", len(head), len(head) + len(body)


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn; start and end bound the escaped text."""
    return [(unescape(m[1]), unescape(m[2]), *m.span(2)) for m in _TURN.finditer(formatted)]


class Windows:
    """Cuts one conversation after another into windows, as its turns arrive."""

    def __init__(self, template: Template):
        self.template = template
        self.start(None)

    def start(self, conv: int | None) -> None:
        self.conv, self.system, self.number = conv, None, 0
        self.past: deque = deque(maxlen=self.template.history)
        self.clear()

    def clear(self) -> None:
        self.new: list = []
        self.before: list = []
        self.total = 0

    def head(self) -> None:
        """System turn and history that go before a new span, within their share of the budget."""
        room = int(self.template.budget * self.template.repeat_share)
        self.before = []
        if self.number and self.system is not None and self.system[2] <= room:
            self.before.append(self.system)
            room -= self.system[2]
        tail: list = []
        for turn in reversed(self.past) if self.number else ():
            room -= turn[2]
            if room < 0 or turn is self.system:
                break
            tail.append(turn)
        self.before += tail[::-1]
        self.total = sum(t[2] for t in self.before)

    def add(self, role: str, text: str) -> tuple | None:
        """A window, if this turn begins the next."""
        turn = (role, text, len(text.split()) + 2)
        out = None
        if self.new and self.total + turn[2] > self.template.budget:
            out = self.close()
        if not self.new:
            self.head()
            if self.total + turn[2] > self.template.budget:  # no room for repeats
                self.before = self.before[: int(bool(self.before) and self.before[0] is self.system)]
                self.total = sum(t[2] for t in self.before)
        if self.system is None and role == "system":
            self.system = turn
        self.new.append(turn)
        self.total += turn[2]
        return out

    def close(self) -> tuple | None:
        if not self.new:
            return None
        parts, spans, at = [], [], 0
        for i, (role, text, _) in enumerate([*self.before, *self.new]):
            shown, a, b = render(role, text)
            if i >= len(self.before) and role == "assistant":
                spans.append((at + a, at + b))
            parts.append(shown)
            at += len(shown)
        out = (self.conv, self.number, "".join(parts), [s[0] for s in spans], [s[1] for s in spans], len(self.before), self.total)
        self.past.extend(self.new)
        self.number += 1
        self.clear()
        return out


WINDOW = "conv_id bigint, window_no int, formatted string, loss_starts array<int>, loss_ends array<int>, n_repeated int, n_tokens int"
_WINDOW_TYPES = pa.schema([("conv_id", pa.int64()), ("window_no", pa.int32()), ("formatted", pa.string()), ("loss_starts", pa.list_(pa.int32())), ("loss_ends", pa.list_(pa.int32())), ("n_repeated", pa.int32()), ("n_tokens", pa.int32())])


def _format(batches: Iterator[pa.RecordBatch], template: Template) -> Iterator[pa.RecordBatch]:
    w, begun = Windows(template), False
    for b in batches:
        out = []
        for conv, role, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            if not begun or conv != w.conv:
                out.append(w.close() if begun else None)
                w.start(conv)
                begun = True
            out.append(w.add(role, text))
        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*made, strict=True), _WINDOW_TYPES, strict=True)] if (made := [x for x in out if x]) else [pa.array([], f.type) for f in _WINDOW_TYPES], schema=_WINDOW_TYPES)
    if last := w.close():
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(last, _WINDOW_TYPES, strict=True)], schema=_WINDOW_TYPES)


def format_windows(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """turns: (conv_id, turn, role, text). Windows with text, loss spans over it, and the number of repeated turns."""
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = rows.repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(lambda it: _format(it, template), WINDOW)


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the windows of each conversation say, from their formatted text and spans alone."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"]

    def emit(s: list) -> tuple:
        return (s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5], s[6])

    state = None
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())  # all null is typed too
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    for b in batches:
        done = []
        for conv, shown, starts, ends, repeated in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
            if state is None or state[0] != conv:
                if state:
                    done.append(emit(state))
                state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
            for role, text, _, _ in parse(shown)[repeated:]:
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            for a, e in zip(starts, ends, strict=True):
                text = unescape(shown[a:e])
                state[3] += len(text)
                state[4].update(text.encode("utf-8", "surrogatepass"))
            state[5] += len(shown)
            state[6] += 1
        if done:
            yield batch(done)
    if state:
        yield batch([emit(state)])


def digests(windows: DataFrame) -> DataFrame:
    """A row per conversation, read back from its windows."""
    n = int(windows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = windows.repartition(n, "conv_id").sortWithinPartitions("conv_id", "window_no").select("conv_id", "formatted", "loss_starts", "loss_ends", "n_repeated")
    return ordered.mapInArrow(_read_back, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_windows bigint")


def op7_chat_format(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return digests(format_windows(rows.unionByName(extra)))


QUERIES = {"op7_chat_format": op7_chat_format}
