"""Sortable ids of 16 bytes: 48 bits of milliseconds, then 80 random bits; text is base 32 without I, L, O and U."""

from __future__ import annotations

import os
import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

ALPHABET = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"
_VALUE = {c: i for i, c in enumerate(ALPHABET)}


class Generator:
    """Ids that rise strictly within one generator, also inside one millisecond."""

    def __init__(self) -> None:
        self.last, self.tail = -1, 0

    def new(self, ms: int | None = None) -> bytes:
        ms = max(int(time.time() * 1000) if ms is None else ms, self.last)
        if ms == self.last:
            self.tail += 1
            if self.tail >> 80:
                ms, self.tail = ms + 1, int.from_bytes(os.urandom(10), "big") >> 1
        else:
            self.tail = int.from_bytes(os.urandom(10), "big") >> 1  # room to count up
        self.last = ms
        return ms.to_bytes(6, "big") + self.tail.to_bytes(10, "big")


def text(ulid: bytes) -> str:
    """The 26 letters of an id."""
    n = int.from_bytes(ulid, "big")
    return "".join(ALPHABET[n >> 5 * k & 31] for k in range(25, -1, -1))


def parse(letters: str) -> bytes:
    """The id of 26 letters, in either case."""
    if len(letters) != 26 or any(c not in _VALUE for c in letters.upper()) or letters[0] > "7":
        raise ValueError(f"not an id: {letters}")
    n = 0
    for c in letters.upper():
        n = n << 5 | _VALUE[c]
    return n.to_bytes(16, "big")


def milliseconds(ulid: bytes) -> int:
    return int.from_bytes(ulid[:6], "big")


@F.pandas_udf(BinaryType())
def _ulids(times: Iterator[pd.Series]) -> Iterator[pd.Series]:
    make = Generator()
    for s in times:
        yield pd.Series([make.new() for _ in range(len(s))], dtype=object)


def ulids(rows: Column) -> Column:
    """A new id for each row, rising inside a task; `rows` is any column."""
    return _ulids(rows)
