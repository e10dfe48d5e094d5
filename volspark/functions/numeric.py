"""Rounding and bits that volume data need and Spark has no function for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half(x: Column) -> Column:
    """A double rounded to the nearest half-precision value, ties to even; beyond the largest one infinite."""
    size = F.abs(x)
    unit = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(size)), F.lit(-14)) - 10)
    return F.when((x == 0) | F.isnan(x), x).when(size >= 65520.0, F.signum(x) * float("inf")).otherwise(F.rint(x / unit) * unit)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def f32(x: Column) -> Column:
    """Rounded to single precision, as a double."""
    return x.cast("float").cast("double")


def half_up(x: Column) -> Column:
    """Rounded to the nearest integer, ties upwards."""
    return F.floor(x + 0.5)


def uint(raw: Column, at: int, width: int, big: Column | None = None) -> Column:
    """The unsigned integer in `width` bytes of a binary column from the 0-based place `at`; little-endian where `big` is not true."""
    byte = [F.conv(F.hex(F.substring(raw, at + 1 + b, 1)), 16, 10).cast("long") for b in range(width)]
    little, other = F.lit(0).cast("long"), F.lit(0).cast("long")
    for b in range(width):
        little, other = little + byte[b] * (1 << (8 * b)), other * 256 + byte[b]
    return little if big is None else F.when(big, other).otherwise(little)


def signed(x: Column, bits: int) -> Column:
    """The two's complement of an unsigned integer of so many bits."""
    return F.when(x >= 1 << (bits - 1), x - (1 << bits)).otherwise(x)


def real(x: Column) -> Column:
    """The single-precision number with the bits of an unsigned 32-bit integer, as a double."""
    sign = F.when(x >= 1 << 31, -1.0).otherwise(1.0)
    power, tail = F.shiftright(x, 23).bitwiseAND(F.lit(255).cast("long")), x.bitwiseAND(F.lit((1 << 23) - 1).cast("long"))
    small = F.when(power == 0, tail * 2.0**-149).otherwise((tail + (1 << 23)) * F.pow(F.lit(2.0), power - 150))
    return F.when(power == 255, F.when(tail == 0, sign * float("inf")).otherwise(float("nan"))).otherwise(sign * small)
