"""Statistics as columns: intervals, paired tests, rates, and the seeded split."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coefficients of the complementary error function's approximation, constant term first.
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def wilson(successes: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Score interval of a proportion; the whole unit interval without trials."""
    p = successes / n
    denominator = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / denominator
    margin = z / denominator * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    low = F.when(n == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), centre - margin))
    high = F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), centre + margin))
    return low, high


def erfc(x: Column) -> Column:
    t = 1 / (1 + 0.5 * F.abs(x))
    poly = F.lit(ERFC[-1])
    for c in reversed(ERFC[:-1]):
        poly = c + t * poly
    r = t * F.exp(-x * x + poly)
    return F.when(x >= 0, r).otherwise(2 - r)


def mcnemar_p(n01: Column, n10: Column) -> Column:
    """Two-sided p of a paired test with the continuity correction clamped at zero; 1 without discordant pairs."""
    corrected = F.greatest(F.lit(0.0), F.abs(n01 - n10) - 1.0)
    return F.when(n01 + n10 == 0, F.lit(1.0)).otherwise(erfc(F.sqrt(corrected * corrected / (n01 + n10) / 2)))


def band(probability: Column, review: Column, act: Column, review_only: Column) -> Column:
    """act from the act threshold on, review from the review threshold on; rules for review never act."""
    return F.when((probability >= act) & ~review_only, "act").when(probability >= review, "review").otherwise("silent")


_LOW32 = (1 << 32) - 1


def _times32(a: Column, b: int | Column) -> Column:
    """Product of 32-bit values modulo 2 to the 32, in halves that stay inside 63 bits."""
    b = b if isinstance(b, Column) else F.lit(b).cast("long")
    low, high = b.bitwiseAND(F.lit(0xFFFF)), F.shiftrightunsigned(b, 16)
    return (a * low + F.shiftleft((a * high).bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(_LOW32))


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over code points."""
    point = lambda c: F.ascii(c).cast("long")
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(2166136261).cast("long"), lambda h, c: _times32(h.bitwiseXOR(point(c)), 16777619))


def first_draw(seed: Column) -> Column:
    """The first number of a mulberry32 generator."""
    low = F.lit(_LOW32)
    a = (seed + 0x6D2B79F5).bitwiseAND(low)
    t = _times32(a.bitwiseXOR(F.shiftrightunsigned(a, 15)), a.bitwiseOR(F.lit(1)))
    t = (t + _times32(t.bitwiseXOR(F.shiftrightunsigned(t, 7)), t.bitwiseOR(F.lit(61)))).bitwiseAND(low).bitwiseXOR(t)
    return t.bitwiseXOR(F.shiftrightunsigned(t, 14)) / 4294967296.0


def split_of(key: Column) -> Column:
    """dev for four fifths of the keys, holdout for the rest, by the key alone."""
    return F.when(first_draw(fnv1a(key)) < 0.8, "dev").otherwise("holdout")
