"""Column expressions: vectors as array<double>, reproducible uniforms, rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def r6(c: Column | str) -> Column:
    """A double rounded to six places, with no negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def doubles(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product of two vectors of one length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column | str) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def l2(v: Column | str) -> Column:
    """Vector scaled to length 1; one shorter than 1e-12 is left as it is."""
    n = norm(v)
    # The length is repeated beside the vector, since inside the function it would be computed anew for every element.
    return F.zip_with(v, F.array_repeat(F.when(n < 1e-12, 1.0).otherwise(n), F.size(v)), lambda x, y: x / y)


def sanitized(v: Column | str, bound: float | None = 50.0) -> Column:
    """NaN becomes 0. With a bound, values (infinities too) are clipped to it; without, infinities become 0."""
    if bound is None:
        return F.transform(v, lambda x: F.when(F.isnan(x) | x.isin(float("inf"), float("-inf")) | x.isNull(), 0.0).otherwise(x))
    return F.transform(v, lambda x: F.when(F.isnan(x) | x.isNull(), 0.0).otherwise(F.least(F.lit(bound), F.greatest(F.lit(-bound), x))))


def uniform(*parts: Column | str | int) -> Column:
    """A number in [0, 1) drawn from the MD5 of the parts joined by '|'; the same in any engine and at every run."""
    key = F.concat_ws("|", *[(F.lit(str(p)) if isinstance(p, int) else F.col(p) if isinstance(p, str) else p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)
