"""Additive power sums and the exact moments they give."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

POWERS = ["n", "s1", "s2", "s3", "s4"]


def power_sums(value: str = "value", weight: Column | None = None) -> list[Column]:
    """Five aggregates sum(weight * value**k); all partial sums, so they merge by adding."""
    x, w = F.col(value), F.lit(1.0) if weight is None else weight.cast("double")
    powers = [w, w * x, w * x * x, w * x * x * x, w * x * x * x * x]
    return [F.coalesce(F.sum(F.when(x.isNotNull(), p)), F.lit(0.0)).alias(name) for p, name in zip(powers, POWERS, strict=True)]


def merged() -> list[Column]:
    """Aggregates that add power sums up."""
    return [F.sum(c).alias(c) for c in POWERS]


def moments() -> list[Column]:
    """mean, variance, std, skewness, kurtosis_excess from columns n, s1..s4.

    Population forms.  The variance is at least 0; skewness and excess kurtosis are 0 where
    it is not positive.  Without values all are null.
    """
    n = F.col("n")
    m = F.try_divide("s1", n)
    raw = F.try_divide("s2", n) - m * m
    m2 = F.greatest(raw, F.lit(0.0))
    m3 = F.try_divide("s3", n) - 3 * m * F.try_divide("s2", n) + 2 * m * m * m
    m4 = F.try_divide("s4", n) - 4 * m * F.try_divide("s3", n) + 6 * m * m * F.try_divide("s2", n) - 3 * m * m * m * m
    shape = lambda x: F.when(m2.isNull(), None).when(m2 > 0, x).otherwise(F.lit(0.0))
    return [
        m.alias("mean"),
        F.when(raw.isNotNull(), m2).alias("variance"),
        F.when(raw.isNotNull(), F.sqrt(m2)).alias("std"),
        shape(F.try_divide(m3, F.pow(m2, F.lit(1.5)))).alias("skewness"),
        shape(F.try_divide(m4, m2 * m2) - 3).alias("kurtosis_excess"),
    ]
