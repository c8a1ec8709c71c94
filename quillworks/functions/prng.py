"""Seeded draws as Columns: 32-bit arithmetic in 64-bit integers.

A draw depends on the generator's key and its ordinal alone, so draws need no order of evaluation and any row can
make its own.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

M32 = 0xFFFFFFFF
#: Fixed values of the hash and of the generator.
FNV_OFFSET, FNV_PRIME = 2166136261, 16777619
STEP = 0x6D2B79F5


def mul32(a: Column, b: Column) -> Column:
    """Low 32 bits of a product of two unsigned 32-bit values, without leaving 64 bits."""
    high = F.shiftright(a, 16) * b
    return (F.shiftleft(high.bitwiseAND(0xFFFF), 16) + a.bitwiseAND(0xFFFF) * b).bitwiseAND(M32)


def mul32_py(a: int, b: int) -> int:
    return a * b & M32


def key_of(text: Column) -> Column:
    """FNV-1a of the code units of a text (in the basic plane)."""
    step = lambda h, c: mul32(h.bitwiseXOR(F.ascii(c).cast("long")), F.lit(FNV_PRIME).cast("long"))
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(FNV_OFFSET).cast("long"), step)


def key_py(text: str) -> int:
    h = FNV_OFFSET
    units = text.encode("utf-16-le")
    for i in range(0, len(units), 2):
        h = mul32_py(h ^ int.from_bytes(units[i : i + 2], "little"), FNV_PRIME)
    return h


def draw(key: Column, ordinal: Column) -> Column:
    """Draw number ordinal (from 1) of the generator with that key, in [0, 1)."""
    key, ordinal = key.cast("long"), ordinal.cast("long")
    state = (key + mul32(ordinal.bitwiseAND(M32), F.lit(STEP).cast("long"))).bitwiseAND(M32)

    def first(s: Column) -> Column:
        return mul32(s.bitwiseXOR(F.shiftright(s, 15)), s.bitwiseOR(F.lit(1).cast("long")))

    def second(t: Column) -> Column:
        return t.bitwiseXOR((t + mul32(t.bitwiseXOR(F.shiftright(t, 7)), t.bitwiseOR(F.lit(61).cast("long")))).bitwiseAND(M32))

    out = let(let(state, first), lambda t: let(second(t), lambda u: u.bitwiseXOR(F.shiftright(u, 14))))
    return out.cast("double") / F.lit(4294967296.0)


class Draws:
    """The same draws in order, for code that runs on the driver or in a group function."""

    def __init__(self, key: int):
        self.key, self.n = key, 0

    def next(self) -> float:
        self.n += 1
        s = (self.key + self.n * STEP) & M32
        t = mul32_py(s ^ s >> 15, s | 1)
        t ^= (t + mul32_py(t ^ t >> 7, t | 61)) & M32
        return (t ^ t >> 14) / 4294967296.0

    def below(self, n: int) -> int | None:
        """An index under n; nothing is drawn for n = 0."""
        return int(self.next() * n) % n if n else None

    def shuffled(self, items: list) -> list:
        out = list(items)
        for i in range(len(out) - 1, 0, -1):
            j = int(self.next() * (i + 1))
            out[i], out[j] = out[j], out[i]
        return out
