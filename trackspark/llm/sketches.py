"""Parity sketches in 64-bit lanes: how far two sets are apart at least, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def folded(p: str, q: str) -> Column:
    """Lanes p, halved onto themselves where q has half as many: the sketch of the same set in half the bits."""
    half = F.floor(F.size(p) / 2).cast("int")
    fold = F.zip_with(F.slice(p, F.lit(1), half), F.slice(p, half + 1, half), lambda x, y: x.bitwiseXOR(y))
    return F.when(F.size(p) > F.size(q), fold).otherwise(F.col(p))


def apart(p: str, q: str) -> Column:
    """Bits in which two sketches differ, whose lanes differ by a factor of two at most."""
    bits = F.zip_with(folded(p, q), folded(q, p), lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("int"))
    return F.aggregate(bits, F.lit(0), lambda total, x: total + x)


def bit(h: Column) -> Column:
    """A word with the bit set that the lowest six bits of a hash tell."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), h.bitwiseAND(F.lit(63)).cast("int"))
