"""Chat formatting: a finite-state machine over roles, a declarative template, and its exact inverse.

A conversation is streamed turn by turn: rows are dealt by conversation and sorted inside each partition, and every step keeps
only its state, so a conversation of any length takes bounded memory. Each turn becomes three segments: the mark before it, its
text with control strings escaped, and the mark after it; each has a loss flag. A conversation whose roles break the machine's
order is still formatted, and `fault` names what was wrong at that turn.

Escaping: a template's marks all start with one of its lead characters; inside texts each lead character gets a backslash after
it. A mark has no backslash there, so no text can hold a mark; taking one backslash away after each lead gives the text back.

Null text is empty; a null role is the role ``; a null turn sorts first; rows of one turn sort by role, then text, and repeated rows are all kept.
Rows without a conversation id form one conversation with a null id. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import text as T

ESCAPE = "\\"


@dataclass(frozen=True)
class Template:
    """marks: what stands before and after a turn of each role; other roles: `<<name>>` and `other`. next: roles that may follow each
    state, `` being the start. loss: roles whose text is learned, with the mark after it if `loss_end`."""

    marks: dict[str, tuple[str, str]] = field(default_factory=lambda: {"system": ("[SYS] ", " [/SYS]\n"), "user": ("[INST] ", " [/INST]\n"), "assistant": ("[ANS] ", " </s>\n")})
    other: tuple[str, str, str] = ("[ROLE]", "[/ROLE] ", " [END]\n")
    next: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    loss: tuple[str, ...] = ("assistant",)
    leads: str = "[<"

    def __post_init__(self) -> None:
        marks = [m.strip() for pair in self.marks.values() for m in pair] + [m.strip() for m in self.other]
        if any(not m or m[0] not in self.leads or m[1:2] == ESCAPE or any(c in self.leads for c in m[1:]) for m in marks):
            raise ValueError("each mark starts with a lead character, holds no other one and no backslash after it")

    def escape(self, text: str) -> str:
        for c in self.leads:
            text = text.replace(c, c + ESCAPE)
        return text

    def unescape(self, text: str) -> str:
        for c in self.leads:
            text = text.replace(c + ESCAPE, c)
        return text

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        """The turn's segments and their loss flags."""
        if role in self.marks:
            before, after = self.marks[role]
        else:
            before, after = self.other[0] + self.escape(role) + self.other[1], self.other[2]
        return [(before, False), (self.escape(text), role in self.loss), (after, False)]

    def fault(self, last: str, role: str) -> str | None:
        """What is wrong when a turn of this role follows the state."""
        return None if role in self.next.get(last, ()) else f"{role or 'no role'} after {last or 'the start'}"

    def parse(self, segments: Iterable[str]) -> Iterator[tuple[str, str]]:
        """(role, text) of each turn, read back from formatted segments."""
        known = {before: role for role, (before, _) in self.marks.items()}
        parts = iter(segments)
        for before in parts:
            if before in known:
                role = known[before]
            else:
                role = self.unescape(before[len(self.other[0]) : -len(self.other[1])])
            yield role, self.unescape(next(parts))
            next(parts)

    def split(self, formatted: str) -> Iterator[tuple[str, str]]:
        """(role, text) of each turn, read back from the whole formatted string."""
        at = 0
        while at < len(formatted):
            for role, (before, after) in self.marks.items():
                if formatted.startswith(before, at):
                    begin = at + len(before)
                    break
            else:
                begin = formatted.index(self.other[1], at) + len(self.other[1])
                role, after = self.unescape(formatted[at + len(self.other[0]) : begin - len(self.other[1])]), self.other[2]
            end = formatted.index(after, begin)
            yield role, self.unescape(formatted[begin:end])
            at = end + len(after)


SEGMENTS = "conv_id long, turn long, segment long, role string, text string, loss boolean, fault string"


def formatted(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """Segments of all conversations, in order inside each partition: three rows for each turn, numbered from 0 in each conversation."""
    template = template or Template()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("segment", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("loss", pa.bool_()), ("fault", pa.string())])
        now: object = ...
        state, number = "", 0
        for b in batches:
            out: list[tuple] = []
            for conv, turn, role, text in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                if conv != now:
                    now, state, number = conv, "", 0
                fault = template.fault(state, role)
                for part, loss in template.segments(role, text):
                    out.append((conv, turn, number, role, part, loss, fault))
                    number += 1
                state = role
            yield T.batch(schema, **dict(zip(schema.names, zip(*out, strict=True) if out else [()] * 7, strict=True)))

    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(T.lean(run), SEGMENTS)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_faults long"


def read_back(segments: DataFrame, template: Template | None = None) -> DataFrame:
    """One row for each conversation: digests of what its formatted segments say. Takes the result of `formatted` as it comes."""
    template = template or Template()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_faults", pa.int64())])
        conv: object = ...
        turns = loss = None
        n = chars = size = faults = 0
        held: list[str] = []

        def row() -> tuple:
            return conv, n, turns.hexdigest(), chars, loss.hexdigest(), size, faults

        for b in batches:
            out = []
            for c, part, learn, fault in zip(b.column(0).to_pylist(), b.column(4).to_pylist(), b.column(5).to_pylist(), b.column(6).to_pylist(), strict=True):
                if turns is None or c != conv:
                    if turns is not None:
                        out.append(row())
                    conv, turns, loss, n, chars, size, faults, held = c, hashlib.sha256(), hashlib.sha256(), 0, 0, 0, 0, []
                size += len(part)
                if learn:
                    text = template.unescape(part)
                    chars += len(text)
                    loss.update(text.encode())
                held.append(part)
                if len(held) == 3:
                    (role, text), = template.parse(held)
                    turns.update(f"{role}\n{text}\n".encode())
                    n, held = n + 1, []
                    faults += fault is not None
            if out:
                yield T.batch(schema, **dict(zip(schema.names, zip(*out, strict=True), strict=True)))
        if turns is not None:
            yield T.batch(schema, **dict(zip(schema.names, zip(row(), strict=True), strict=True)))

    return segments.mapInArrow(T.lean(run), DIGESTS)
