"""Numeric Column helpers: rounding, interpolation, reproducible draws, intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

TWO24, TWO52 = 16777216.0, 4503599627370496.0


def half_even(value: Column, digits: int = 0) -> Column:
    """Round half to even at ``digits`` decimals, in plain double arithmetic."""
    scale = float(10**digits)
    return F.rint(value * F.lit(scale)) / F.lit(scale)


def cents(value: Column) -> Column:
    return half_even(value, 2)


def micro(value: Column) -> Column:
    return half_even(value.cast("double"), 6)


def clip(value: Column, low: float | None = None, high: float | None = None) -> Column:
    """Clamp to [low, high]; null stays null (``greatest``/``least`` alone would skip it)."""
    out = value
    if high is not None:
        out = F.least(out, F.lit(high))
    if low is not None:
        out = F.greatest(out, F.lit(low))
    return F.when(value.isNotNull(), out)


def safe_div(num: Column, den: Column) -> Column:
    """num/den, null where the denominator is zero or null."""
    return num / F.when(den != 0, den)


def piecewise_linear(x: Column, xs: Sequence[float], ys: Sequence[float]) -> Column:
    """Linear interpolation through (xs, ys), clamped at both ends; null in, null out."""
    out = F.lit(float(ys[-1]))
    for i in range(len(xs) - 1, 0, -1):
        x0, x1, y0, y1 = float(xs[i - 1]), float(xs[i]), float(ys[i - 1]), float(ys[i])
        seg = F.lit(y0) + (x - F.lit(x0)) / F.lit(x1 - x0) * F.lit(y1 - y0)
        out = F.when(x <= F.lit(x1), seg).otherwise(out)
    out = F.when(x <= F.lit(float(xs[0])), F.lit(float(ys[0]))).otherwise(out)
    return F.when(x.isNotNull(), out)


def draw_key(*parts: Column | str | int) -> Column:
    """Hash of the parts; the source of the draws below. Independent of partitioning."""
    cols = [p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.md5(F.concat_ws("|", *cols))


def uniform(key: Column, slot: int = 0) -> Column:
    """Slot 0..4 of a draw key as a uniform number strictly inside (0, 1)."""
    digits = F.conv(F.substring(key, 6 * slot + 1, 6), 16, 10).cast("double")
    return (digits + 0.5) / TWO24


def uniform_fine(key: Column) -> Column:
    """The first 52 bits of a draw key as a uniform number strictly inside (0, 1), for picks among very many rows."""
    return (F.conv(F.substring(key, 1, 13), 16, 10).cast("double") + 0.5) / TWO52


def gauss_pair(u1: Column, u2: Column) -> tuple[Column, Column]:
    """Two independent standard normals from two uniforms (Box-Muller)."""
    radius = F.sqrt(F.lit(-2.0) * F.log(u1))
    angle = F.lit(6.283185307179586) * u2
    return radius * F.cos(angle), radius * F.sin(angle)


def wilson_interval(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson score interval for k successes in n trials; null when n = 0."""
    n = F.when(n > 0, n.cast("double"))
    p = k / n
    centre = (p + z * z / (2.0 * n)) / (1.0 + z * z / n)
    half = z * F.sqrt(p * (1.0 - p) / n + z * z / (4.0 * n * n)) / (1.0 + z * z / n)
    return F.greatest(F.lit(0.0), centre - half), F.least(F.lit(1.0), centre + half)
