"""Chat formatting with a loss mask, around a template that is a black box.

A template is a function from a list of (role, text) to a string. Successive prefixes of a conversation are rendered and
consecutive outputs compared: what the longer one adds is the turn's span, and a longer output that doesn't begin with
the shorter one betrays a template that rewrites history. Inside a span the text is located by rendering the turn with
two probe texts that differ in every character: what their spans share at both ends belongs to the template.

Every prefix is rendered whole, however long the conversation is, so that what is found doesn't depend on a number of
turns. That takes time quadratic in the turns. A template that promises that a turn's span doesn't depend on turns further
back than ``reach`` (an attribute of the template; none is assumed) is rendered with that many turns before the new one,
and the promise is checked at each step: the last turn's span, rendered without what was dropped, must be the old one.
Conversations arrive as streams of rows in turn order, so with such a template one of any length takes bounded memory.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Template = Callable[[list[tuple[str, str]]], str]
_PROBES = ("\x01", "\x02")
_special = re.compile(r"[\\<>\[\]]")
_turn = re.compile(r"<s>\[((?:[^\\\]]|\\.)*)\]\n((?:[^\\<>\[\]]|\\.)*)</s>\n", re.DOTALL)


class HistoryRewritten(ValueError):
    """The template changes the rendering of earlier turns when turns are added."""


def escape(text: str) -> str:
    """Every character that control strings are made of gets a backslash."""
    return _special.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def turnwise(reach: int) -> Callable[[Template], Template]:
    """Mark a template by its promise that the span of a turn depends on at most ``reach`` turns before it."""

    def mark(template: Template) -> Template:
        template.reach = reach
        return template

    return mark


@turnwise(0)
def marked_template(turns: list[tuple[str, str]]) -> str:
    """``<s>[role]`` and a line feed, the text, ``</s>`` and a line feed for each turn, roles and texts escaped."""
    return "".join(f"<s>[{escape(role)}]\n{escape(text)}</s>\n" for role, text in turns)


class Span(NamedTuple):
    segment: str  # what the turn adds to the output
    start: int  # where, in code points
    text_start: int  # the text inside the segment
    text_end: int


class Renderer:
    """Locates turns one by one in the output of a template. ``turns`` and ``output`` are the prefix that is rendered
    again with the next turn: all of it, or its end if the template has a ``reach``."""

    def __init__(self, template: Template):
        self.template, self.reach = template, getattr(template, "reach", None)
        self.turns: list[tuple[str, str]] = []
        self.output, self.dropped = template([]), 0
        self.chars = len(self.output)

    def _added(self, role: str, text: str) -> str:
        longer = self.template([*self.turns, (role, text)])
        if not longer.startswith(self.output):
            raise HistoryRewritten(f"turn {self.dropped + len(self.turns) + 1} changes what was rendered before it")
        return longer[len(self.output) :]

    def add(self, role: str, text: str) -> Span:
        lead = self.output if not self.turns and not self.dropped else ""  # what the template says before any turn
        segment, (one, two) = self._added(role, text), (self._added(role, p) for p in _PROBES)
        head = len(os.path.commonprefix([one, two]))
        tail = len(os.path.commonprefix([one[head:][::-1], two[head:][::-1]]))
        span = Span(lead + segment, self.chars - len(lead), len(lead) + head, len(lead) + len(segment) - tail)
        self.chars += len(segment)
        self.turns.append((role, text))
        self.output += segment
        if self.reach is not None and len(self.turns) > max(self.reach, 1):
            self._forget(segment)
        return span

    def _forget(self, segment: str) -> None:
        """Go on with the last ``reach`` turns, one at least, if they give the last turn the span it has."""
        drop = len(self.turns) - max(self.reach, 1)
        self.dropped, self.turns = self.dropped + drop, self.turns[drop:]
        before = self.template(self.turns[:-1])
        self.output = self.template(self.turns)
        if self.output != before + segment:
            raise HistoryRewritten("the span of a turn depends on turns further back than the template's reach")


def spans(turns: Iterator[tuple[str, str]], template: Template = marked_template) -> Iterator[Span]:
    renderer = Renderer(template)
    for role, text in turns:
        yield renderer.add(role, text)


def read_back(segment: str) -> list[tuple[str, str]]:
    """The turns in a piece of ``marked_template``'s output; the pieces must cover it."""
    out, at = [], 0
    for m in _turn.finditer(segment):
        if m.start() != at:
            break
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(segment):
        raise ValueError("text outside the marks of a turn")
    return out


def _ordered(conversations: DataFrame) -> DataFrame:
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _segments(batches: Iterator[pa.RecordBatch], template: Template) -> Iterator[tuple]:
    """(conv_id, number, role, span) of rows that come sorted by conversation and turn."""
    renderer, current, number = None, None, 0
    for batch in batches:
        for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
            if renderer is None or conv != current:
                renderer, current, number = Renderer(template), conv, 0
            yield conv, number, role, renderer.add(role, text)
            number += 1


def format_turns(conversations: DataFrame, template: Template = marked_template, train_on: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """``conv_id, number, segment, start, loss_start, loss_end``: the segments of a conversation, joined in the order
    of ``number``, are its formatted text; the loss mask is [loss_start, loss_end) in it, null for turns outside
    ``train_on``.

    Null texts and roles are empty strings. Turns of one conversation with the same number are ordered by role and
    text, null numbers come first, repeated rows are turns of their own, and rows without ``conv_id`` are one
    conversation. Other columns are ignored. An empty table gives no rows. Texts of any length are taken whole. A template
    that rewrites history ends the job with ``HistoryRewritten``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        schema = pa.schema([("conv_id", pa.int64()), ("number", pa.int64()), ("segment", pa.string()), ("start", pa.int64()), ("loss_start", pa.int64()), ("loss_end", pa.int64())])
        emit = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
        for conv, number, role, s in _segments(batches, template):
            loss = (s.start + s.text_start, s.start + s.text_end) if role in train_on else (None, None)
            out.append((conv, number, s.segment, s.start, *loss))
            if len(out) >= 1000:
                yield emit()
                out.clear()
        if out:
            yield emit()

    return _ordered(conversations).mapInArrow(run, "conv_id long, number long, segment string, start long, loss_start long, loss_end long")


class _Digest:
    """What is read back of one conversation."""

    def __init__(self) -> None:
        self.n = self.loss_chars = self.chars = 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, span: Span, trained: bool) -> None:
        if span.start != self.chars:
            raise ValueError("segments leave a gap")
        self.chars += len(span.segment)
        for role, text in read_back(span.segment):
            self.n += 1
            self.turns.update(f"{role}\n{text}\n".encode())
        if trained:
            text = unescape(span.segment[span.text_start : span.text_end])
            self.loss_chars += len(text)
            self.loss.update(text.encode())

    def row(self) -> tuple:
        return self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def format_digests(conversations: DataFrame, train_on: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``, read back from the segments of
    ``marked_template``, one row for each conversation. Nulls, ties and empty tables as in ``format_turns``."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        digest, current = None, None
        emit = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        for conv, number, role, span in _segments(batches, marked_template):
            if number == 0:
                if digest:
                    rows.append((current, *digest.row()))
                digest, current = _Digest(), conv
            digest.add(span, role in train_on)
            if len(rows) >= 1000:
                yield emit()
                rows.clear()
        if digest:
            rows.append((current, *digest.row()))
        if rows:
            yield emit()

    return _ordered(conversations).mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
g AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS loss,
    sum(length(role) + length(text) + 11 + length(regexp_replace(role || text, '[^\\<>\[\]]', '', 'g'))) AS chars
  FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars
FROM g
"""
