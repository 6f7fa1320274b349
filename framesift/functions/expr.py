"""Scalar expressions that the operators share. All are built-in functions and stay in whole-stage code.

Rounding is half up (also below zero), absent signals are neutral, and vectors
of unequal length have two rules of their own, as the operators need them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_half_up(c: str | Column) -> Column:
    return F.floor(col(c) + 0.5)


def clamp(c: str | Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), col(c)))


def clamp01(c: str | Column) -> Column:
    """To 0..1; NaN is 0."""
    return F.when(F.isnan(col(c).cast("double")), F.lit(0.0)).otherwise(clamp(col(c).cast("double"), 0.0, 1.0))


def uncertainty(score: str | Column) -> Column:
    """1 at a score of 50, 0 at 0 and 100."""
    return 1 - F.abs(clamp(score, 0, 100) - 50) / 50


def review_difficulty(score: str | Column = "ai_score", stored: str | Column = "ai_uncertainty", select_at: int = 65, reject_at: int = 35) -> Column:
    """0 (clear) to 1 (hard): the stored uncertainty, else how far the score is from the nearer threshold, as a share of half the band between them."""
    known, s = col(stored).cast("double"), col(score)
    near = clamp(F.least(s - reject_at, select_at - s) / ((select_at - reject_at) / 2), 0.0, 1.0)
    return F.when(known.isNotNull() & ~F.isnan(known) & (F.abs(known) < float("inf")), known).otherwise(near)


def haversine_km(lat1: str | Column, lon1: str | Column, lat2: str | Column, lon2: str | Column) -> Column:
    a, b = F.radians(col(lat1)), F.radians(col(lat2))
    h = F.pow(F.sin((b - a) / 2), F.lit(2.0)) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(col(lon2) - col(lon1)) / 2), F.lit(2.0))
    return F.lit(2 * EARTH_KM) * F.atan2(F.sqrt(h), F.sqrt(1 - h))


def has_real_gps(lat: str = "lat", lon: str = "lon") -> Column:
    """Finite, in range and not the null island."""
    a, o = F.col(lat), F.col(lon)
    return F.coalesce(~F.isnan(a) & ~F.isnan(o) & a.between(-90, 90) & o.between(-180, 180) & ~((a == 0) & (o == 0)), F.lit(False))


def dot(x: str | Column, y: str | Column) -> Column:
    return F.aggregate(F.zip_with(col(x), col(y), lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0)))


def norm(x: str | Column) -> Column:
    return F.sqrt(dot(x, x))


def cosine(x: str | Column, y: str | Column, *, strict: bool = False) -> Column:
    """Cosine of two arrays; 0 for a zero vector. Unequal lengths: cut to the shorter, or 0 if ``strict``."""
    a, b = col(x), col(y)
    if strict:
        n = norm(a) * norm(b)
        return F.when((F.size(a) != F.size(b)) | (n == 0), F.lit(0.0)).otherwise(dot(a, b) / n)
    k = F.least(F.size(a), F.size(b))
    a, b = F.slice(a, 1, k), F.slice(b, 1, k)
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)


def hamming(x: str | Column, y: str | Column) -> Column:
    """Of two 64-bit hashes held as long."""
    return F.bit_count(col(x).bitwiseXOR(col(y)))


def blank_to_null(c: str | Column) -> Column:
    return F.nullif(col(c), F.lit(""))


def expand_template(template: str | Column, values: dict[str, Column]) -> Column:
    """{name} tokens replaced; unknown ones stay; characters that file names can't have become one hyphen."""
    out = col(template) if not isinstance(template, str) else F.lit(template)
    for k, v in values.items():
        out = F.replace(out, F.lit("{" + k + "}"), F.coalesce(v.cast("string"), F.lit("")))
    return F.regexp_replace(F.regexp_replace(out, r'[\\/:*?"<>|]', "-"), "-{2,}", "-")


def zero_pad(c: str | Column, n: int = 3) -> Column:
    """Padded to n digits; longer numbers stay whole."""
    s = col(c).cast("string")
    return F.lpad(s, F.greatest(F.length(s), F.lit(n)), F.lit("0"))
