"""Chat formatting by incremental black-box rendering.

A template is anything with render(turns) -> str and unescape(str) -> str. Successive prefixes of
a conversation are rendered; what a prefix adds to the one before is its last turn's span. The
text in the span is found by rendering the turn with two probe texts: what both outputs share
at their ends belongs to the template. A prefix that doesn't begin with the prefix before shows
a template that rewrites history, even if a later prefix looks as if it hadn't; texts are then
located in the whole output, a turn at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple, Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_PROBES = ("Pa", "Qb")


class Turn(NamedTuple):
    role: str
    text: str


class Template(Protocol):
    def render(self, turns: list[Turn]) -> str: ...

    def unescape(self, text: str) -> str: ...


class Marked:
    """`<s>[INST] role` and the text on new lines, closed by `[/INST]</s>`; control strings in roles and texts are broken by a backslash.

    A backslash of the text is doubled, a single one after a control string's first character
    breaks it, and one before % stands for a line break in a role.
    """

    _control = re.compile(r"\\|</?s>|\[/?INST\]|<\|(?=\w+\|>)|<</?SYS>>")
    _escaped = re.compile(r"\\([\\%]?)")

    def escape(self, text: str) -> str:
        return self._control.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)

    def unescape(self, text: str) -> str:
        return self._escaped.sub(lambda m: {"\\": "\\", "%": "\n"}.get(m[1], ""), text)

    def render(self, turns: list[Turn]) -> str:
        return "".join(f"<s>[INST] {self.escape(r).replace(chr(10), chr(92) + '%')}\n{self.escape(t)}\n[/INST]</s>\n" for r, t in turns)

    def role(self, head: str) -> str:
        """The role in what stands before a text."""
        return self.unescape(head.removeprefix("<s>[INST] ").removesuffix("\n"))


class Span(NamedTuple):
    """Of a turn, and of its text in it."""

    start: int
    text_start: int
    text_end: int
    end: int


def _shared(a: str, b: str) -> int:
    """Length of the common prefix."""
    if a == b:
        return len(a)
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[:mid] == b[:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def _margins(template: Template, before: list[Turn], turn: Turn, after: list[Turn]) -> tuple[int, int]:
    """Where the turn's text starts, and how far from the end it ends, in the output of all these turns."""
    a, b = (template.render([*before, Turn(turn.role, p), *after]) for p in _PROBES)
    return _shared(a, b), _shared(a[::-1], b[::-1])


def _prefixes(template: Template, turns: list[Turn]) -> list[Span] | None:
    """The span of each turn; None if the template rewrites history."""
    out, last = [], ""
    for k, turn in enumerate(turns):
        now = template.render(turns[: k + 1])
        if not now.startswith(last):
            return None
        head, tail = _margins(template, turns[:k], turn, [])
        if head < len(last) or len(now) - tail < head:
            return None
        out.append(Span(len(last), head, len(now) - tail, len(now)))
        last = now
    return out


def render(template: Template, turns: list[Turn]) -> tuple[str, list[Span], bool]:
    """The formatted conversation, the span of each turn, and whether the template rewrites history.

    Every prefix is rendered, whatever its length, as a black box may rewrite at any turn; the
    work grows with the square of a conversation's turns.
    """
    whole = template.render(turns) if turns else ""
    if (spans := _prefixes(template, turns)) is not None:
        return whole, spans, False
    spans, at = [], 0
    for k, turn in enumerate(turns):  # spans then are those of the texts, with what stands before each
        head, tail = _margins(template, turns[:k], turn, turns[k + 1 :])
        spans.append(Span(at, head, len(whole) - tail, len(whole) - tail))
        at = len(whole) - tail
    return whole, spans, True


_SPAN = "struct<role:string,start:long,text_start:long,text_end:long,end:long,loss:boolean>"


def format_conversations(turns: DataFrame, template: Template | None = None, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(id, formatted, spans, rewrites): a row for each conversation, spans by turn with the loss mask on texts of the roles in `learn`.

    Turns are ordered by turn, role and text, nulls first, so ties and repeated rows have a
    defined order and all count. Null roles and texts are empty; turns of a null id are one
    conversation; other columns play no part. No turns give no rows. A conversation is one
    output row, so it must fit a task, as any row must.
    """
    template = template or Marked()
    own = turns.select(F.col(f"`{id_col}`").alias("conv"), F.struct(F.col(f"`{turn_col}`").alias("n"), F.col(f"`{role_col}`").alias("role"), F.col(f"`{text_col}`").alias("text")).alias("t"))
    kind = dict(own.dtypes)["conv"]
    grouped = own.groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    rows = grouped.select("conv", F.transform("turns", lambda t: F.struct(F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text"))).alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                b = whole.slice(at, 200)
                out = []
                for own in b.column(1).to_pylist():
                    convo = [Turn(t["role"], t["text"]) for t in own]
                    text, spans, rewrites = render(template, convo)
                    out.append((text, [{"role": t.role, **s._asdict(), "loss": t.role in learn} for t, s in zip(convo, spans, strict=True)], rewrites))
                texts, spans, rewrites = map(list, zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(spans, _arrow_spans()), pa.array(rewrites, pa.bool_())], names=["conv", "formatted", "spans", "rewrites"])

    return rows.mapInArrow(run, f"conv {kind}, formatted string, spans array<{_SPAN}>, rewrites boolean").withColumnRenamed("conv", id_col)


def _arrow_spans() -> pa.DataType:
    return pa.list_(pa.struct([("role", pa.string()), *((c, pa.int64()) for c in ("start", "text_start", "text_end", "end")), ("loss", pa.bool_())]))


def read_back(formatted: DataFrame, template: Marked | None = None, id_col: str = "conv_id") -> DataFrame:
    """(id, turns array of role and text, learned string, formatted_chars) read from the output: its spans, its loss mask and its escapes alone."""
    template = template or Marked()
    own = formatted.select(F.col(f"`{id_col}`").alias("conv"), "formatted", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            turns, learned, sizes = [], [], []
            for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                texts = [template.unescape(text[s["text_start"] : s["text_end"]]) for s in spans]
                turns.append([{"role": template.role(text[s["start"] : s["text_start"]]), "text": t} for s, t in zip(spans, texts, strict=True)])
                sizes.append(len(text))
                learned.append("".join(t for s, t in zip(spans, texts, strict=True) if s["loss"]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(turns, pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))), pa.array(learned, pa.string()), pa.array(sizes, pa.int64())], names=["conv", "turns", "learned", "formatted_chars"])

    return own.mapInArrow(run, f"conv {dict(own.dtypes)['conv']}, turns array<struct<role:string,text:string>>, learned string, formatted_chars long").withColumnRenamed("conv", id_col)
