"""Deterministic 32-bit hashes and low-discrepancy numbers as column expressions.

Spark's integers raise on overflow, so products of 32-bit numbers are built of halves.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK = 0xFFFFFFFF

# The multipliers of the mixing functions, which results depend on.
MIX_A, MIX_B = 0x7FEB352D, 0x846CA68B
TRIANGLE, AXIS = 0x9E3779B9, 0x85EBCA6B
UNIT_INDEX, UNIT_SEED, UNIT_A, UNIT_B = 2654435761, 2246822519, 2246822507, 3266489909


def multiplied(a: Column, k: int) -> Column:
    """a * k modulo 2^32, for a below 2^32."""
    low = a * F.lit(k & 0xFFFF)
    high = (a * F.lit(k >> 16)).bitwiseAND(F.lit(0xFFFF)) * F.lit(65536)
    return (low + high).bitwiseAND(F.lit(MASK))


def _shifted(x: Column, n: int) -> Column:
    return x.bitwiseXOR(F.shiftright(x, n))


def hash01(x: Column) -> Column:
    """A number in 0..1 from a 32-bit value."""
    x = _shifted(x.cast("bigint").bitwiseAND(F.lit(MASK)), 16)
    x = _shifted(multiplied(x, MIX_A), 15)
    x = _shifted(multiplied(x, MIX_B), 16)
    return x.bitwiseAND(F.lit(0xFFFFFF)) / F.lit(16777215.0)


def unit_hash(index: Column, seed: int) -> Column:
    """A number in 0..1 from an index and a seed."""
    a = multiplied((index.cast("bigint") + 1).bitwiseAND(F.lit(MASK)), UNIT_INDEX)
    x = _shifted(a.bitwiseXOR(F.lit(((seed + 1) * UNIT_SEED) & MASK)), 16)
    x = _shifted(multiplied(x, UNIT_A), 13)
    x = _shifted(multiplied(x, UNIT_B), 16)
    return F.shiftright(x, 8) / F.lit(16777215.0)


def quasirandom01(index: Column, triangle: Column, seed: int, axis: int) -> Column:
    """The axis-th coordinate of an index in a triangle: golden-ratio steps and a hashed start."""
    key = F.lit((seed & MASK) ^ (seed >> 32 & MASK) ^ ((axis * AXIS) & MASK)).cast("bigint").bitwiseXOR(multiplied(triangle.cast("bigint"), TRIANGLE))
    step = 0.618034 if axis == 0 else 0.7548777
    x = (index + 0.5) * step + hash01(key)
    return F.least(F.greatest(x - F.floor(x), F.lit(1e-6)), F.lit(0.999999))


def halton01(index: Column, base: int, seed: int = 0) -> Column:
    """Radical inverse of the index, moved on by the seed modulo the base."""
    start = index.cast("bigint") + (seed % base)
    digits = max(1, math.ceil(40 * math.log(2) / math.log(base)))
    return sum((F.floor(start / F.lit(float(base**k))) % base * F.lit(float(base) ** -(k + 1)) for k in range(digits)), F.lit(0.0))


def unit_direction(index: Column, seed: int) -> tuple[Column, Column, Column]:
    z = 2 * unit_hash(index, seed) - 1
    angle = 2 * math.pi * unit_hash(index, seed + 41)
    r = F.sqrt(F.greatest(1 - z * z, F.lit(0.0)))
    return r * F.cos(angle), r * F.sin(angle), z
