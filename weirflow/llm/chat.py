"""Chat formatting by incremental black-box rendering.

A template is any function from turns to a string. Successive prefixes of a conversation are
rendered, and consecutive outputs are compared: what a turn adds is its span, and an output that
changes what earlier turns rendered to shows a template that rewrites history. The text inside a
turn's span is found by rendering the prefix with two probe texts in its place.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]
Render = Callable[[list[Turn]], str]

_CONTROL = re.compile(r"(?=</?s>|\[/?INST\]|<<|>>)(.)", re.S)


@lru_cache(maxsize=4096)
def escape(text: str) -> str:
    """Backslashes are doubled, and control strings are split by one after their first character."""
    return _CONTROL.sub(r"\1\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


START = "<s>"


def render_turn(role: str, text: str) -> str:
    if role == "user":
        return f"[INST] {escape(text)} [/INST]"
    if role == "assistant":
        return f" {escape(text)} </s>"
    return f"<< {escape(role)} >> {escape(text)} <</>>"


def render_turns(turns: list[Turn]) -> str:
    """The template of this module; ``parse_turns`` inverts it."""
    return START + "".join(render_turn(*turn) for turn in turns)


def parse_turns(text: str, *, begun: bool = False) -> list[Turn]:
    """The turns of a string that ``render_turns`` made; ``begun``: of what follows its first turns."""
    if not begun and not text.startswith(START):
        raise ValueError("no start mark")
    at, out = 0 if begun else len(START), []
    while at < len(text):
        role, start, close = "assistant", at + 1, " </s>"
        if text.startswith("[INST] ", at):
            role, start, close = "user", at + 7, " [/INST]"
        elif text.startswith("<< ", at):
            stop = text.index(" >> ", at + 3)
            role, start, close = unescape(text[at + 3 : stop]), stop + 4, " <</>>"
        elif text[at] != " ":
            raise ValueError(f"no turn begins at {at}")
        end = text.index(close, start)
        out.append((role, unescape(text[start:end])))
        at = end + len(close)
    return out


@dataclass
class Formatted:
    """A rendered conversation: spans of its turns, of its learned texts, and rewriting turns."""

    text: str
    spans: list[tuple[int, int]] = field(default_factory=list)
    loss: list[tuple[int, int]] = field(default_factory=list)
    rewritten_by: list[int] = field(default_factory=list)


def _common(a: str, b: str) -> int:
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while low < high:  # the longest equal prefix, by halving
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def _text_span(turns: list[Turn], now: str, render: Render) -> tuple[int, int]:
    """Where the last turn's text stands in ``now``, by two other texts in its place."""
    *before, (role, _) = turns
    a, b = render([*before, (role, "a")]), render([*before, (role, "bb")])
    head = _common(a, b)
    tail = _common(a[::-1], b[::-1]) if head < min(len(a), len(b)) else 0
    return head, len(now) - min(tail, len(a) - head - 1)


def format_turns(turns: list[Turn], render: Render = render_turns, learned: tuple[str, ...] = ("assistant",)) -> Formatted:
    """Renders all prefixes. A turn's span ends where the next output still agrees with its own.

    What follows a turn's text, such as a mark at the very end, may change with the next turn. If
    a turn changes output up to the text of the turn before it, its index goes to
    ``rewritten_by``; such conversations get no loss spans, as they couldn't be trusted.
    """
    before = render([])
    out = Formatted(before)
    start, text_end = len(before), 0
    for k, (role, _) in enumerate(turns):
        now = render(turns[: k + 1])
        same = _common(out.text, now)
        if same < text_end:
            out.rewritten_by.append(k)
        if k:
            begin = out.spans[-1][0]
            out.spans[-1] = (begin, max(begin, same))
            start = max(begin, same)
        else:
            start = same
        out.spans.append((start, len(now)))
        begin, text_end = _text_span(turns[: k + 1], now, render)
        if role in learned:
            out.loss.append((begin, text_end))
        out.text = now
    if out.rewritten_by:
        out.loss = []
    return out


#: This module's template only appends, so longer conversations are rendered and put out in segments of so many turns.
MAX_TURNS = 512
#: Characters of text that are put out at once.
BLOCK = 4 << 20
_SPANS = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
_FORMATTED = {"segment": ("long", pa.int64()), "first_turn": ("long", pa.int64()), "begin": ("long", pa.int64()), "text": ("string", pa.string())}
_FORMATTED |= dict.fromkeys(("spans", "loss"), ("array<struct<begin:bigint,end:bigint>>", _SPANS)) | {"rewritten_by": ("array<bigint>", pa.list_(pa.int64()))}
_DIGESTS = {"n_turns": ("long", pa.int64()), "turns_sha256": ("string", pa.string()), "loss_chars": ("long", pa.int64()), "loss_sha256": ("string", pa.string())}
_DIGESTS |= {"formatted_chars": ("long", pa.int64()), "rewrites_history": ("boolean", pa.bool_())}


class _Rows:
    """Rows of (conv_id, more columns) that are gathered into batches."""

    def __init__(self, columns: dict):
        self.columns, self.rows, self.size = columns, [], 0

    def add(self, row: tuple, size: int = 0) -> None:
        self.rows.append(row)
        self.size += size

    def full(self) -> bool:
        return self.size >= BLOCK or len(self.rows) >= 1000

    def batch(self, kind: pa.DataType) -> pa.RecordBatch:
        columns = zip(*self.rows, strict=True)
        kinds = [kind, *(t for _, t in self.columns.values())]
        self.rows, self.size = [], 0
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["conv_id", *self.columns])


def _with(frame: DataFrame, columns: dict):
    from pyspark.sql.types import StructType

    more = StructType.fromDDL(", ".join(f"{n} {t}" for n, (t, _) in columns.items()))
    return StructType([frame.schema["conv_id"], *more.fields])


class _Stream:
    """One conversation whose turns come in segments: offsets and turn numbers are those of the whole.

    The last turn of a segment is rendered again before the next one, so what follows is compared
    with what stands there, and the start mark is put out once.
    """

    def __init__(self, render: Render, learned: tuple[str, ...]):
        self.render, self.learned = render, learned
        self.tail: list[Turn] = []
        self.segment = self.turns = self.chars = 0

    def add(self, turns: list[Turn]) -> tuple:
        made, kept = format_turns([*self.tail, *turns], self.render, self.learned), len(self.tail)
        begin = made.spans[kept][0] if kept else 0
        text, shift = made.text[begin:], self.chars - begin
        known = sum(role in self.learned for role, _ in self.tail) if made.loss else 0
        spans, loss = ([{"begin": a + shift, "end": b + shift} for a, b in x] for x in (made.spans[kept:], made.loss[known:]))
        row = self.segment, self.turns, self.chars, text, spans, loss, [k - kept + self.turns for k in made.rewritten_by]
        self.tail = turns[-1:]
        self.segment, self.turns, self.chars = self.segment + 1, self.turns + len(turns), self.chars + len(text)
        return row


def render_conversations(rows: DataFrame, render: Render = render_turns, *, learned: tuple[str, ...] = ("assistant",), max_turns: int = MAX_TURNS) -> DataFrame:
    """conv_id, segment, first_turn, begin, text, spans, loss, rewritten_by for (conv_id, turn, role, text).

    Turns go by turn, then role and text where turns repeat; nulls in role and text are empty, a
    null conv_id is a conversation of its own. ``text`` is what the template gives, ``spans`` has
    the place of each turn, ``loss`` those of the learned texts, and ``rewritten_by`` the turns
    that change earlier output; offsets (code points, ends exclusive) and turn numbers count from
    the conversation's start.

    With this module's template, which only appends, a conversation is a row for each
    ``max_turns`` turns, one after another in a partition: texts joined by ``segment`` are its
    rendering, whatever ``max_turns`` is, and a task holds one segment at a time. Any other
    template may change whatever came before, so it always gets the whole history: one row a
    conversation, held by a task as a whole. An empty table gives no row.
    """
    kept = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    lanes = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = kept.repartition(lanes, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    appends = render is render_turns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: object = run  # no id equals it
        stream, held, out = _Stream(render, learned), [], _Rows(_FORMATTED)

        def put() -> None:
            row = stream.add(held)
            out.add((current, *row), len(row[3]))

        kind = pa.int64()
        for batch in batches:
            kind = batch.schema.field(0).type
            for conv, role, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if conv != current:
                    if current is not run:
                        put()
                    current, stream, held = conv, _Stream(render, learned), []
                elif appends and len(held) >= max_turns:
                    put()
                    held = []
                held.append((role, text))
                if out.full():
                    yield out.batch(kind)
        if current is not run:
            put()
        if out.rows:
            yield out.batch(kind)

    return dealt.mapInArrow(run, _with(kept, _FORMATTED))


class _Digest:
    """Digests of one conversation, from its formatted segments in order."""

    def __init__(self) -> None:
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = 0
        self.rewrites = False

    def add(self, begin: int, text: str, loss: list[dict], rewritten_by: list[int]) -> None:
        self.rewrites |= bool(rewritten_by)
        for role, said in parse_turns(text, begun=self.chars > 0):
            self.n += 1
            self.turns.update(f"{role}\n{said}\n".encode())
        for span in loss:
            said = unescape(text[span["begin"] - begin : span["end"] - begin])
            self.loss_chars += len(said)
            self.loss.update(said.encode())
        self.chars += len(text)

    def row(self) -> tuple:
        return self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.rewrites


def format_conversations(rows: DataFrame, *, max_turns: int = MAX_TURNS) -> DataFrame:
    """conv_id and digests for each conversation: what ``render_conversations`` gives with this
    module's template, read back from its texts and spans."""
    made = render_conversations(rows, max_turns=max_turns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, current, out, kind = None, None, _Rows(_DIGESTS), pa.int64()
        for batch in batches:
            kind = batch.schema.field(0).type
            columns = (batch.column(name).to_pylist() for name in ("conv_id", "segment", "begin", "text", "loss", "rewritten_by"))
            for conv, segment, *row in zip(*columns, strict=True):
                if segment == 0:
                    if digest:
                        out.add((current, *digest.row()))
                    current, digest = conv, _Digest()
                digest.add(*row)
            if out.full():
                yield out.batch(kind)
        if digest:
            out.add((current, *digest.row()))
        if out.rows:
            yield out.batch(kind)

    return made.mapInArrow(run, _with(made, _DIGESTS))


def op9_chat_format(spark, sf_dir: str) -> DataFrame:
    """All conversations, and conversation -1, whose texts hold control strings.

    Null roles and texts are empty; repeated turns go by role and text; of an empty table
    conversation -1 is left; other columns, whatever their names, aren't read.
    """
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    return format_conversations(rows.unionByName(extra))
