"""Random draws that any engine can repeat: integer mixing below 2**31."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

M = 2_147_483_647


class Draws:
    """A seeded stream of draws on the driver."""

    def __init__(self, seed: int):
        self.state = seed % (M - 1) + 1
        for _ in range(4):
            self.integer(0, 2)

    def unit(self) -> float:
        self.state = self.state * 48271 % M
        return (self.state - 1) / (M - 1)

    def integer(self, lo: int, hi: int) -> int:
        """In [lo, hi)."""
        return lo + min(hi - lo - 1, int(self.unit() * (hi - lo)))


def mixed(*parts: Column | int) -> Column:
    """A number below M from non-negative integer columns."""
    h = F.lit(17).cast("long")
    for p in parts:
        c = (F.lit(p) if isinstance(p, int) else p).cast("long")
        h = (h * F.lit(48271) + c + F.lit(11)) % F.lit(M)
        h = (h.bitwiseXOR(F.shiftright(h, 13)) * F.lit(69621)) % F.lit(M)
    return h


def mixed_sql(*parts: str) -> str:
    """The same in SQL."""
    h = "17::BIGINT"
    for p in parts:
        h = f"((({h}) * 48271 + ({p})::BIGINT + 11) % {M})"
        h = f"((xor({h}, ({h}) >> 13) * 69621) % {M})"
    return h
