"""Chat formatting by incremental rendering of a template that is a black box.

A template is any function from a list of turns (role, text) to a string. Conversations are rendered turn by turn:
the output for the turns so far is compared with the output before the last one. If it only grew, the rest is the
span of the turn; if not, the template has rewritten history, and the turn says how many characters it took back. A
further rendering with a mark in place of the text finds where the text lies inside the span, without any knowledge of
the template; that part of the assistant's turns is the loss mask.

Rows are dealt by conversation and sorted by turn, and stream through. Every rendering starts at the first turn, so a
task holds the turns of one conversation, and its time grows with the square of their number: nothing less is right for
any template. Of a template that is known to put out each turn by itself, as `turns_template` does, the caller may say
so by `lookback`: then a task holds that many turns and takes time in proportion to them.

Defined cases. Null texts and roles are empty strings. Turns with equal numbers follow by role, then text; a null turn
comes first. Repeated rows are turns of their own. Rows with a null conversation id are one conversation. An empty
table gives an empty result. Only the four columns are read.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoledger.llm.common import width

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

ASSISTANT = "assistant"

HEADER, END = "### ", "</turn>"
# What could be taken for a part of the template, and the sign that keeps it from being so.
_CONTROL = re.compile(r"\\|###|</turn>")
_CONTROL_ROLE = re.compile(r"[\\:]|###|</turn>")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(r"### ((?:[^\\:]|\\.)*):\n((?:[^\\<]+|\\.|<(?!/turn>))*)</turn>\n", re.DOTALL)


def turns_template(turns: list[Turn]) -> str:
    """Every turn as a header line with its role, the text, and an end mark; control strings inside are escaped."""
    return "".join(f"{HEADER}{_CONTROL_ROLE.sub(r'\\\g<0>', role)}:\n{_CONTROL.sub(r'\\\g<0>', text)}{END}\n" for role, text in turns)


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def parse(formatted: str) -> list[Turn]:
    """Turns of a text that `turns_template` made."""
    out, at = [], 0
    while at < len(formatted):
        found = _TURN.match(formatted, at)
        if not found:
            raise ValueError(f"no turn at {at}")
        out.append((unescaped(found[1]), unescaped(found[2])))
        at = found.end()
    return out


def _text_within(template: Template, before: list[Turn], turn: Turn, old: str, span: str) -> tuple[int, int] | None:
    """Start and end of the turn's text in its span, found by a mark in place of the text."""
    mark = "\ue000"
    while mark in turn[0]:
        mark += "\ue000"
    probe = template([*before, (turn[0], mark)])
    if not probe.startswith(old) or probe.count(mark, len(old)) != 1:
        return None
    head, tail = probe[len(old):].split(mark)
    fits = len(head) + len(tail) <= len(span) and span.startswith(head) and span.endswith(tail)
    return (len(head), len(span) - len(tail)) if fits else None


def _format(template: Template, lookback: int | None):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "seq", "role", "start", "taken_back", "piece", "loss_start", "loss_end"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        conversation, seq, end, past, old = object(), 0, 0, [], ""
        for batch in batches:
            rows = []
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if conv != conversation:
                    conversation, seq, end, past, old = conv, 0, 0, [], template([])
                turn = (role or "", text or "")
                if lookback is not None and len(past) >= max(lookback, 1):
                    past = past[-(lookback - 1):] if lookback > 1 else []
                    old = template([*past])
                new = template([*past, turn])
                kept = len(old) if new.startswith(old) else len(os.path.commonprefix([old, new]))
                taken_back, piece = len(old) - kept, new[kept:]
                inside = None
                if turn[0] == ASSISTANT and not taken_back:
                    inside = _text_within(template, past, turn, old, piece)
                start = end - taken_back
                mask = (start + inside[0], start + inside[1]) if inside else (None, None)
                rows.append((conv, seq, turn[0], start, taken_back, piece, *mask))
                past.append(turn)
                old, seq, end = new, seq + 1, start + len(piece)
            columns = zip(*rows, strict=True) if rows else ([],) * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return kernel


PIECES = "conv_id long, seq long, role string, start long, taken_back long, piece string, loss_start long, loss_end long"


def format_chats(rows: DataFrame, template: Template = turns_template, conv: str = "conv_id", turn: str = "turn",
                 role: str = "role", text: str = "text", lookback: int | None = None) -> DataFrame:
    """One row per turn: the `piece` it adds to the formatted conversation at `start`, and its part of the loss mask.

    `taken_back` is above 0 where the template rewrote what it had put out before; such turns have no mask. The
    pieces of a conversation are neighbours, in order. With `lookback`, later turns are rendered with as many turns only,
    itself among them; that is right for templates that neither count nor rewrite what lies further back.
    """
    turns = rows.select(
        F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    dealt = turns.repartition(width(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(_format(template, lookback), PIECES)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    class Sums:
        def __init__(self, conv):
            self.conv, self.turns, self.loss, self.chars = conv, 0, 0, 0
            self.turns_sha, self.loss_sha = hashlib.sha256(), hashlib.sha256()

        def row(self):
            return self.conv, self.turns, self.turns_sha.hexdigest(), self.loss, self.loss_sha.hexdigest(), self.chars

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else ([],) * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    now = None
    for batch in batches:
        rows = []
        columns = (batch.column(c).to_pylist() for c in ("conv_id", "start", "piece", "loss_start", "loss_end"))
        for conv, start, piece, loss_start, loss_end in zip(*columns, strict=True):
            if now is None or now.conv != conv:
                if now is not None:
                    rows.append(now.row())
                now = Sums(conv)
            for role, text in parse(piece):
                now.turns += 1
                now.turns_sha.update(f"{role}\n{text}\n".encode())
            now.chars += len(piece)
            if loss_start is not None:
                text = unescaped(piece[loss_start - start:loss_end - start])
                now.loss += len(text)
                now.loss_sha.update(text.encode())
        yield batch_of(rows)
    if now is not None:
        yield batch_of([now.row()])


def read_back(pieces: DataFrame) -> DataFrame:
    """Digests of every conversation, from the formatted text and the mask alone: what `turns_template` formatted is parsed again."""
    return pieces.mapInArrow(
        _read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
