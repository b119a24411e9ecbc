"""Drift: Wasserstein distance of windows to a reference, thresholds and verdicts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shape import dense, grid, total, union_edges, wasserstein, wasserstein_grid

#: Scales a median absolute deviation to a standard deviation; default multiple; what the
#: largest distance is multiplied by when the deviation is 0.  Fixed values.
MAD_SCALE, MULTIPLE, FLAT = 1.4826, 8.0, 1.5


def pooled(histogram: DataFrame, keys: list[str]) -> DataFrame:
    """Sum of the windows' counts per key and bin; zeros stay."""
    return histogram.groupBy(*keys, "schema_id", "bin").agg(F.sum("cnt").alias("cnt"))


def distances(windows: DataFrame, reference: DataFrame, schemas: DataFrame, *, instrument: list[str], window: list[str], points: int | None = None) -> DataFrame:
    """instrument, window, distance, overflow_frac, novelty for each window.

    windows: instrument + window + schema_id, bin, cnt; reference: instrument + schema_id,
    bin, cnt.  The integral is exact over the union of the edges, or a trapezoid rule on
    `points` equally spaced points.  The distance is null if either interior is empty;
    `novelty` then tells whether the window only has mass outside the range.
    """
    a = dense(windows, schemas, [*instrument, *window]).withColumnRenamed("counts", "ca").withColumnRenamed("edges", "ea").withColumnRenamed("schema_id", "schema_a")
    b = dense(reference, schemas, instrument).select(*instrument, F.col("schema_id").alias("schema_b"), F.col("counts").alias("cb"), F.col("edges").alias("eb"))
    both = a.join(b, instrument, "left")
    if points:
        d = wasserstein_grid(F.col("ca"), F.col("ea"), F.col("cb"), F.col("eb"), grid(F.col("ea"), F.col("eb"), points))
    else:
        same = wasserstein(F.col("ca"), F.col("cb"), F.col("ea"))
        cross = wasserstein_grid(F.col("ca"), F.col("ea"), F.col("cb"), F.col("eb"), union_edges(F.col("ea"), F.col("eb")))
        d = F.when(F.col("schema_a") == F.col("schema_b"), same).otherwise(cross)
    inside = total(F.col("ca"))
    outside = F.col("under") + F.col("over")
    return both.select(*instrument, *window, d.alias("distance"), F.try_divide(outside, inside + outside).alias("overflow_frac"), ((inside <= 0) & (outside > 0)).alias("novelty"))


def thresholds(scored: DataFrame, *, instrument: list[str], k: float = MULTIPLE, policy: str = "mad") -> DataFrame:
    """Threshold per instrument from calibration distances; null ones are left out.

    'mad': median + k * scaled MAD; with a MAD of 0, 1.5 times the largest distance.
    'p99': the 99th percentile.  An instrument without distances has no threshold.
    """
    valid = scored.where(F.col("distance").isNotNull())
    if policy == "p99":
        return valid.groupBy(*instrument).agg(F.percentile("distance", 0.99).alias("threshold"))
    middle = F.median("distance").over(Window.partitionBy(*instrument))
    spread = valid.withColumns({"middle": middle}).withColumn("gap", F.abs(F.col("distance") - F.col("middle")))
    out = spread.groupBy(*instrument).agg(F.max("middle").alias("middle"), (F.median("gap") * MAD_SCALE).alias("mad"), F.max("distance").alias("most"))
    return out.select(*instrument, F.when(F.col("mad") > 0, F.col("middle") + k * F.col("mad")).otherwise(FLAT * F.col("most")).alias("threshold"))


def verdicts(scored: DataFrame, limits: DataFrame, *, instrument: list[str]) -> DataFrame:
    """scored with threshold and is_drift; a null distance is never drift."""
    out = scored.join(limits, instrument, "left")
    return out.withColumn("is_drift", F.coalesce(F.col("distance") > F.col("threshold"), F.lit(False)))


def detect(windows: DataFrame, schemas: DataFrame, calibration: Column, *, instrument: list[str], window: list[str], k: float = MULTIPLE, policy: str = "mad", points: int | None = None) -> DataFrame:
    """Verdicts of all windows, with a reference and threshold from those for which `calibration` holds."""
    reference = pooled(windows.where(calibration), instrument)
    scored = distances(windows, reference, schemas, instrument=instrument, window=window, points=points)
    return verdicts(scored, thresholds(scored.where(calibration), instrument=instrument, k=k, policy=policy), instrument=instrument)


def _inverse(matrix: pd.Series) -> pd.Series:
    """Pseudo-inverses of square matrices given row by row."""
    return matrix.map(lambda x: np.linalg.pinv(np.reshape(x, (int(len(x) ** 0.5), -1)), rcond=1e-12, hermitian=True).reshape(-1))


def mahalanobis(found: DataFrame, calibration: Column, size: int, *, instrument: list[str], vector: str = "vector") -> DataFrame:
    """found with the Mahalanobis distance of its vectors (of `size` numbers) to each instrument's calibration rows.

    Mean and covariance come from additive sums, one row per instrument, of which the
    covariance is inverted; directions without variance do not count.  An instrument
    without calibration rows, or a vector with a null, has a null distance.
    """
    v, at = F.col(vector), range(size)
    total = [F.sum(F.get(v, F.lit(i))).alias(f"p{i}") for i in at]
    cross = [F.sum(F.get(v, F.lit(i)) * F.get(v, F.lit(j))).alias(f"q{i}_{j}") for i in at for j in at if i <= j]
    sums = found.where(calibration).groupBy(*instrument).agg(F.count("*").alias("n"), *total, *cross)
    mean = [F.col(f"p{i}") / F.col("n") for i in at]
    covariance = F.array(*[F.col(f"q{min(i, j)}_{max(i, j)}") / F.col("n") - mean[i] * mean[j] for i in at for j in at])
    reference = sums.select(*instrument, F.array(*mean).alias("_mean"), F.pandas_udf(_inverse, "array<double>")(covariance).alias("_inverse"))
    out = found.join(reference, instrument, "left").withColumn("_gap", F.zip_with(v, "_mean", lambda x, y: x - y))
    gap, steps = F.col("_gap"), F.sequence(F.lit(0), F.lit(size - 1))
    add = lambda terms: F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)
    row = lambda i: add(F.transform(steps, lambda j: F.get("_inverse", i * size + j) * F.get(gap, j)))
    square = add(F.transform(steps, lambda i: F.get(gap, i) * row(i)))
    return out.withColumn("mahalanobis", F.sqrt(F.greatest(square, F.when(square.isNotNull(), F.lit(0.0))))).drop("_mean", "_inverse", "_gap")


def score_series(scored: DataFrame, *, instrument: list[str], window: list[str]) -> DataFrame:
    """The verdicts in the order of their windows: keys, distance, is_drift."""
    return scored.select(*instrument, *window, "distance", "is_drift").orderBy(*instrument, *window)


def confusion(found: DataFrame, truth: Column) -> DataFrame:
    """tp, fn, fp, tn, recall and the number of clean windows scored, in one row."""
    flag = F.col("is_drift")
    n = lambda c: F.count(F.when(c, F.lit(1)))
    out = found.agg(n(truth & flag).alias("tp"), n(truth & ~flag).alias("fn"), n(~truth & flag).alias("fp"), n(~truth & ~flag).alias("tn"))
    return out.withColumns({"recall": F.try_divide("tp", F.col("tp") + F.col("fn")), "clean_scored": F.col("fp") + F.col("tn")})


def baseline(windows: DataFrame, schemas: DataFrame, rule: str, *, instrument: list[str], hour: str = "event_hour", n: int = 24) -> DataFrame:
    """Distance of each hour to a moving baseline of the same instrument and schema.

    'previous_hour' and 'same_hour_yesterday' compare with one earlier window,
    'rolling_window' with the pool of the `n` hours before.  Hours without a baseline have
    a null distance.
    """
    own = dense(windows, schemas, [*instrument, hour])
    keys = [*instrument, "schema_id"]
    if rule == "rolling_window":
        # per bin: running sums over the hours before, as ranges of seconds
        seconds = F.unix_seconds(F.col(hour).cast("timestamp"))
        grid_ = windows.select(*keys, hour).distinct().join(windows.select(*keys, "bin").distinct(), keys)
        filled = grid_.join(windows, [*keys, hour, "bin"], "left").withColumn("sec", seconds)
        over = Window.partitionBy(*keys, "bin").orderBy("sec").rangeBetween(-3600 * n, -1)
        before = filled.select(*keys, hour, "bin", F.sum(F.coalesce("cnt", F.lit(0))).over(over).alias("cnt")).where("cnt IS NOT NULL AND cnt <> 0")
        base = dense(before, schemas, [*instrument, hour]).select(*keys, hour, F.col("counts").alias("cb"))
    else:
        step = {"previous_hour": "INTERVAL 1 HOUR", "same_hour_yesterday": "INTERVAL 24 HOURS"}[rule]
        base = own.select(*keys, (F.col(hour) + F.expr(step)).alias(hour), F.col("counts").alias("cb"))
    both = own.join(base, [*keys, hour], "left")
    empty = F.transform("counts", lambda _: F.lit(0.0))
    return both.select(*instrument, hour, wasserstein(F.col("counts"), F.coalesce("cb", empty), F.col("edges")).alias("distance"))


def divergences(windows: DataFrame, reference: DataFrame, schemas: DataFrame, *, instrument: list[str], window: list[str]) -> DataFrame:
    """PSI, Kullback-Leibler and Jensen-Shannon divergence (nats), Kolmogorov-Smirnov and cosine similarity on interior bins.

    PSI and Kullback-Leibler (of the window from the reference) take shares of at least 1e-6.  All are null if either interior is empty.
    """
    a = dense(windows, schemas, [*instrument, *window])
    b = dense(reference, schemas, instrument).select(*instrument, "schema_id", F.col("counts").alias("cb"))
    both = a.join(b, [*instrument, "schema_id"])
    ta, tb = total(F.col("counts")), total(F.col("cb"))
    both = both.where((ta > 0) & (tb > 0)).withColumn("pq", F.transform(F.arrays_zip("counts", "cb"), lambda z: F.struct((z["counts"] / ta).alias("p"), (z["cb"] / tb).alias("q"))))
    floor = lambda x: F.greatest(x, F.lit(1e-6))
    add = lambda f: F.aggregate("pq", F.lit(0.0), lambda s, z: s + f(z["p"], z["q"]))
    kl = lambda x, m: F.when(x > 0, x * F.ln(x / m)).otherwise(F.lit(0.0))
    start = F.struct(F.lit(0.0).alias("d"), F.lit(0.0).alias("most"))
    ks = F.aggregate("pq", start, lambda s, z: F.struct((s["d"] + z["p"] - z["q"]).alias("d"), F.greatest(s["most"], F.abs(s["d"] + z["p"] - z["q"])).alias("most")), lambda s: s["most"])
    return both.select(
        *instrument,
        *window,
        add(lambda p, q: (floor(p) - floor(q)) * F.ln(floor(p) / floor(q))).alias("psi"),
        add(lambda p, q: floor(p) * F.ln(floor(p) / floor(q))).alias("kl"),
        add(lambda p, q: (kl(p, (p + q) / 2) + kl(q, (p + q) / 2)) / 2).alias("js"),
        ks.alias("ks"),
        F.try_divide(add(lambda p, q: p * q), F.sqrt(add(lambda p, q: p * p) * add(lambda p, q: q * q))).alias("cosine"),
    )
