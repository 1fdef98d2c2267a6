"""Chat formatting in budgeted windows.

A conversation's turns are formatted by a template and their tokens are summed up. The running sums choose spans of
whole turns, so that the system turn, a limited piece of history and the span together stay within the budget. Each
span gives one row: the formatted text, the character ranges under the loss mask, and how many turns at its start
repeat earlier ones. Repeated turns are never under the mask, so each assistant text is a target once.

Turns are read in order from sorted partitions. A task holds one window and the history in front of it, so
a conversation of any length is formatted, and read back, in bounded memory.

Template: ``[SYS]text[/SYS]``, ``[INST]text[/INST]`` (user), ``<s>text</s>`` (assistant), ``[TURN role]text[/TURN]``
(any other role). Where a text holds the start of one of these marks, a backslash is put after its first character;
where backslashes are there already, one more is added. Reading back removes one.

Defined results: rows are ordered by turn, then role, then text; a null text is empty, a null role is the role "";
a conversation without id is one conversation; a system turn is retained where it is the first turn; a turn that is
longer than the budget makes a window of its own with no history (``tokens`` tells); repeated rows are turns of
their own; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Callable, Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.tokens import byte_bpe, public_path

BUDGET, HISTORY = 2048, 512

MARKS = {"system": ("[SYS]", "[/SYS]"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
_TAIL = r"(\\*)(?=/?(?:s>|INST\]|SYS\]|TURN))"
_ESCAPE, _UNESCAPE = re.compile(r"([<\[])" + _TAIL), re.compile(r"([<\[])\\" + _TAIL)
_OPEN = re.compile(r"\[SYS\]|\[INST\]|<s>|\[TURN ([^\]]*)\]")


def escape(text: str) -> str:
    """Text without marks."""
    return _ESCAPE.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    """Inverse of :func:`escape`."""
    return _UNESCAPE.sub(r"\1\2", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A formatted turn and the range of its text."""
    before, after = MARKS.get(role) or (f"[TURN {quote(role, safe='')}]", "[/TURN]")
    body = escape(text)
    return before + body + after, len(before), len(before) + len(body)


def parse(formatted: str) -> Iterator[tuple[str, str, int, int]]:
    """Turns of a formatted window: role, text, start and end of the text."""
    roles = {m[0]: (role, m[1]) for role, m in MARKS.items()}
    at = 0
    while at < len(formatted):
        m = _OPEN.match(formatted, at)
        if not m:
            raise ValueError("no turn starts here")
        role, close = roles.get(m[0]) or (unquote(m[1]), "[/TURN]")
        end = formatted.index(close, m.end())
        yield role, unescape(formatted[m.end() : end]), m.end(), end
        at = end + len(close)


WINDOWS = "conv_id long, window int, formatted string, loss array<struct<start:int,end:int>>, n_repeated int, first_turn long, n_turns int, tokens long"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


class _Windows:
    """Windows of one conversation, turn by turn."""

    def __init__(self, conv_id: int | None, budget: int, history: int, tokens: Callable[[str], int]):
        self.conv_id, self.budget, self.most, self.tokens = conv_id, budget, history, tokens
        self.system: list[tuple] = []
        self.past: deque[tuple] = deque()
        self.span: list[tuple] = []
        self.past_sum = self.span_sum = 0
        self.number = self.seen = 0

    def add(self, role: str, text: str) -> Iterator[tuple]:
        formatted, start, end = render(role, text)
        turn = (role, formatted, start, end, self.tokens(formatted))
        before = sum(t[4] for t in self.system) + self.past_sum
        if self.span and before + self.span_sum + turn[4] > self.budget:
            yield self.close()
        if not self.span:  # older history gives way to the first turn of a span
            while self.past and sum(t[4] for t in self.system) + self.past_sum + turn[4] > self.budget:
                self.past_sum -= self.past.popleft()[4]
        self.span.append(turn)
        self.span_sum += turn[4]

    def close(self) -> tuple:
        fits = sum(t[4] for t in self.system) + self.span_sum <= self.budget
        kept = self.system if fits or len(self.span) > 1 else []
        repeated = [*kept, *self.past]
        text, loss, at = [], [], 0
        for k, (role, formatted, start, end, _) in enumerate([*repeated, *self.span]):
            if k >= len(repeated) and role == "assistant":
                loss.append({"start": at + start, "end": at + end})
            text.append(formatted)
            at += len(formatted)
        total = sum(t[4] for t in repeated) + self.span_sum
        row = (self.conv_id, self.number, "".join(text), loss, len(repeated), self.seen, len(self.span), total)
        self.number += 1
        if not self.seen and self.span[0][0] == "system":
            self.system = self.span[:1]
            self.past.extend(self.span[1:])
        else:
            self.past.extend(self.span)
        self.seen += len(self.span)
        self.past_sum = sum(t[4] for t in self.past)
        while self.past and self.past_sum > self.most:
            self.past_sum -= self.past.popleft()[4]
        self.span, self.span_sum = [], 0
        return row


def format_chats(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokenizer: str | None = None) -> DataFrame:
    """Windows of all conversations (conv_id, turn, role, text), see ``WINDOWS``."""
    path = tokenizer or public_path("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_bpe(path)
        state: _Windows | None = None

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            c = list(zip(*rows, strict=True))
            types = (pa.int64(), pa.int32(), pa.string(), _SPANS, pa.int32(), pa.int64(), pa.int32(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(c, types, strict=True)], names=["conv_id", "window", "formatted", "loss", "n_repeated", "first_turn", "n_turns", "tokens"])

        for batch in batches:
            rows = []
            for conv_id, role, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if state is None or state.conv_id != conv_id:
                    if state is not None:
                        rows.append(state.close())
                    state = _Windows(conv_id, budget, history, lambda s: len(encode(s)))
                rows.extend(state.add(role or "", text or ""))
            if rows:
                yield batch_of(rows)
        if state is not None:
            yield batch_of([state.close()])

    turns = conversations.select(F.col("conv_id").cast("long"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return ordered.mapInArrow(run, WINDOWS)


READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"


def read_back(windows: DataFrame) -> DataFrame:
    """Per conversation, from its formatted windows alone: digests of its turns and of all text under the loss mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in READ.split(", ")]
        conv_id, counts, turns, loss = None, None, None, None

        def row() -> tuple:
            return conv_id, counts["turns"], turns.hexdigest(), counts["loss"], loss.hexdigest(), counts["chars"], counts["windows"]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        for batch in batches:
            rows = []
            for conv, formatted, spans, n_repeated in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if counts is None or conv != conv_id:
                    if counts is not None:
                        rows.append(row())
                    conv_id, turns, loss = conv, hashlib.sha256(), hashlib.sha256()
                    counts = dict.fromkeys(("turns", "loss", "chars", "windows"), 0)
                for k, (role, text, _, _) in enumerate(parse(formatted)):
                    if k >= n_repeated:
                        turns.update(f"{role}\n{text}\n".encode())
                        counts["turns"] += 1
                for span in spans:
                    target = unescape(formatted[span["start"] : span["end"]])
                    loss.update(target.encode())
                    counts["loss"] += len(target)
                counts["chars"] += len(formatted)
                counts["windows"] += 1
            if rows:
                yield batch_of(rows)
        if counts is not None:
            yield batch_of([row()])

    ordered = windows.repartition("conv_id").sortWithinPartitions("conv_id", "window").select("conv_id", "formatted", "loss", "n_repeated")
    return ordered.mapInArrow(run, READ)
