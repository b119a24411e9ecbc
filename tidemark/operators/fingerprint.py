"""Fingerprints: moments from power sums and shape from bins, per window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.moments import moments, power_sums
from ..functions.shape import dense, entropy, percentile

#: Canonical order of the nine-vector.  Fixed values.
VECTOR = ["mean", "variance", "skewness", "kurtosis_excess", "p50", "p90", "p95", "p99", "entropy_norm"]


def fingerprints(fact: DataFrame, schemas: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key and schema: n, moments, percentiles, entropy and the nine-vector.

    One pass over the fact: power sums per bin add up to the window's, and the same rows
    give the histogram.
    """
    per_bin = fact.groupBy(*keys, "schema_id", "bin").agg(F.sum("delta").alias("cnt"), *power_sums("value", F.col("delta")))
    sums = per_bin.groupBy(*keys, "schema_id").agg(*[F.sum(c).alias(c) for c in ("n", "s1", "s2", "s3", "s4")])
    shape = dense(per_bin.where("cnt <> 0"), schemas, keys)
    nats, share = entropy()
    shape = shape.select(*keys, "schema_id", *[percentile(q).alias(p) for p, q in (("p50", 0.5), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99))], nats.alias("entropy_nats"), share.alias("entropy_norm"))
    out = sums.select(*keys, "schema_id", "n", *moments()).join(shape, [*keys, "schema_id"])
    return out.withColumn("vector", F.array(*VECTOR))
