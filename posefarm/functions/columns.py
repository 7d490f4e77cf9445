"""Column expressions: quaternions, portable hashing and special functions.

Everything here is a built-in expression, so it stays inside whole-stage code
generation.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

MODULUS = 2147483647


def mix(value: Column, seed: int | Column = 0) -> Column:
    """A seeded integer hash into [0, 2**31 - 1) made of plain BIGINT arithmetic.

    It depends on the row key alone, so a draw survives repartitioning, and any
    SQL engine can repeat it.
    """
    seed = seed if isinstance(seed, Column) else F.lit(seed)
    x = F.pmod(F.pmod(value.cast("long"), F.lit(MODULUS)) + seed.cast("long") * 7919, F.lit(MODULUS))
    x = F.pmod(x * 48271, F.lit(MODULUS))
    x = x.bitwiseXOR(F.shiftright(x, 15))
    x = F.pmod(x * 69621, F.lit(MODULUS))
    x = x.bitwiseXOR(F.shiftright(x, 13))
    return F.pmod(x * 16807, F.lit(MODULUS))


def mix2(a: Column, b: Column, seed: int | Column = 0) -> Column:
    """As :func:`mix` for a pair: both are hashed before they meet, so that neighbouring
    pairs share no run of draws, however long either range is."""
    seed = seed if isinstance(seed, Column) else F.lit(seed)
    return mix(mix(a, seed) + mix(b, seed + 1), seed + 2)


def uniform(value: Column, seed: int | Column = 0) -> Column:
    """A uniform draw in [0, 1) keyed by ``value``."""
    return mix(value, seed) / F.lit(float(MODULUS))


def dot(a: Sequence[Column], b: Sequence[Column]) -> Column:
    total = a[0] * b[0]
    for x, y in zip(a[1:], b[1:]):
        total = total + x * y
    return total


def cross(a: Sequence[Column], b: Sequence[Column]) -> list[Column]:
    return [
        a[1] * b[2] - a[2] * b[1],
        a[2] * b[0] - a[0] * b[2],
        a[0] * b[1] - a[1] * b[0],
    ]


def rotation_matrix(q: Sequence[Column]) -> list[Column]:
    """Nine entries, row by row, of the rotation a unit quaternion (x, y, z, w)
    stands for in this library: the transpose of the usual matrix."""
    x, y, z, w = q
    return [
        1.0 - 2.0 * y * y - 2.0 * z * z, 2.0 * (x * y + z * w), 2.0 * (x * z - y * w),
        2.0 * (x * y - z * w), 1.0 - 2.0 * x * x - 2.0 * z * z, 2.0 * (y * z + x * w),
        2.0 * (x * z + y * w), 2.0 * (y * z - x * w), 1.0 - 2.0 * x * x - 2.0 * y * y,
    ]


def apply_matrix(m: Sequence[Column], v: Sequence[Column]) -> list[Column]:
    return [dot(m[3 * i:3 * i + 3], v) for i in range(3)]


def quat_mul(a: Sequence[Column], b: Sequence[Column]) -> list[Column]:
    """Hamilton product of quaternions stored as (x, y, z, w)."""
    va, vb = a[:3], b[:3]
    c = cross(va, vb)
    vector = [a[3] * vb[i] + b[3] * va[i] + c[i] for i in range(3)]
    return vector + [a[3] * b[3] - dot(va, vb)]


def geodesic_deg(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Angle in degrees between two rotations; q and -q are the same one."""
    return F.degrees(2.0 * F.acos(F.least(F.lit(1.0), F.abs(dot(a, b)))))


def erfc(x: Column) -> Column:
    """Complementary error function, Chebyshev fit with relative error below 1.2e-7."""
    z = F.abs(x)
    t = 1.0 / (1.0 + 0.5 * z)
    # Coefficients of the published fit, lowest power first.
    coefficients = (
        -1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806,
        0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277,
    )
    poly = F.lit(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        poly = poly * t + c
    tail = t * F.exp(-z * z + poly)
    return F.when(x >= 0, tail).otherwise(2.0 - tail)


def two_sided_normal_p(z: Column) -> Column:
    return F.least(F.lit(1.0), erfc(F.abs(z) / math.sqrt(2.0)))


def log_gamma(x: Column) -> Column:
    """log Gamma for x >= 1: Stirling series after a shift by eight."""
    shift = F.lit(0.0)
    for k in range(8):
        shift = shift + F.log(x + float(k))
    y = x + 8.0
    series = 1.0 / (12.0 * y) - 1.0 / (360.0 * y * y * y) + 1.0 / (1260.0 * F.pow(y, 5.0)) - 1.0 / (1680.0 * F.pow(y, 7.0)) + 1.0 / (1188.0 * F.pow(y, 9.0))
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2.0 * math.pi) + series - shift


def weighted_sum(array: Column, weights: Sequence[float]) -> Column:
    """Dot product of an array column with constants.

    Short vectors are unrolled into generated code; long ones use one
    higher-order expression, which beats hundreds of unrolled terms.
    """
    if not len(weights):
        return F.lit(0.0)
    if len(weights) <= 16:
        total = F.lit(0.0)
        for i, w in enumerate(weights):
            total = total + array.getItem(i) * float(w)
        return total
    fixed = F.array(*[F.lit(float(w)) for w in weights])
    return F.aggregate(F.zip_with(array, fixed, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def array_sums(array: Column, length: int) -> list[Column]:
    """One sum per array position, for a single pass without exploding."""
    return [F.sum(array.getItem(i)) for i in range(length)]
