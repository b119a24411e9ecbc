"""Expressions on dense histograms.

A dense histogram row has edges (K+1), counts (K interior counts), under and over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dense(histogram: DataFrame, schemas: DataFrame, keys: list[str], *, count: str = "cnt") -> DataFrame:
    """One row per key and schema: under, over and the array of interior counts, zeros filled in.

    A group has at most K+2 rows, one per bin.  Negative nets stay.
    """
    long = histogram.groupBy(*keys, "schema_id").agg(F.map_from_entries(F.collect_list(F.struct("bin", F.col(count).cast("double")))).alias("held"))
    long = long.join(schemas.select("schema_id", "edges").dropDuplicates(["schema_id"]), "schema_id")
    k = F.size("edges") - 1
    at = lambda i: F.coalesce(F.try_element_at("held", i.cast("int")), F.lit(0.0))
    return long.select(*keys, "schema_id", "edges", at(F.lit(0)).alias("under"), at(k + 1).alias("over"), F.transform(F.sequence(F.lit(1), k), at).alias("counts"))


def total(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)


def _bins(counts: Column, edges: Column) -> Column:
    return F.transform(counts, lambda c, i: F.struct(c.alias("c"), F.get(edges, i).alias("lo"), F.get(edges, i + 1).alias("hi")))


def percentile(q: float, counts: Column | str = "counts", edges: Column | str = "edges", under: Column | str = "under", over: Column | str = "over") -> Column:
    """Percentile by linear interpolation in the first bin that reaches the rank; null if empty.

    Mass outside the range counts towards the rank and is reported at the range's edge.
    """
    counts, edges, under, over = (F.col(x) if isinstance(x, str) else x for x in (counts, edges, under, over))
    mass = total(counts) + under + over
    target = F.lit(q) * mass
    start = F.struct(under.alias("cum"), F.lit(None).cast("double").alias("at"))

    def step(a, b):
        here = a["at"].isNull() & (b["c"] > 0) & (target <= a["cum"] + b["c"])
        return F.struct((a["cum"] + b["c"]).alias("cum"), F.when(here, b["lo"] + (target - a["cum"]) / b["c"] * (b["hi"] - b["lo"])).otherwise(a["at"]).alias("at"))

    inside = F.aggregate(_bins(counts, edges), start, step, lambda a: a["at"])
    last = F.get(edges, F.size(edges) - 1)
    return F.when(mass <= 0, F.lit(None).cast("double")).when(target <= under, F.get(edges, F.lit(0))).otherwise(F.coalesce(inside, last))


def entropy(counts: Column | str = "counts") -> tuple[Column, Column]:
    """(nats, share of ln K) of the interior proportions; 0 when empty, the share 0 also for K <= 1."""
    counts = F.col(counts) if isinstance(counts, str) else counts
    mass = total(counts)
    nats = F.aggregate(counts, F.lit(0.0), lambda a, c: a - F.when(c > 0, c / mass * F.ln(c / mass)).otherwise(F.lit(0.0)))
    nats = F.when(mass > 0, nats).otherwise(F.lit(0.0))
    k = F.size(counts)
    return nats, F.when((k > 1) & (mass > 0), nats / F.ln(F.when(k > 1, k.cast("double")))).otherwise(F.lit(0.0))


def _cdf(x: Column, counts: Column, edges: Column) -> Column:
    """Share of the interior mass at or below x, linear inside bins."""
    part = lambda b: b["c"] * F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - b["lo"]) / (b["hi"] - b["lo"])))
    return F.aggregate(_bins(counts, edges), F.lit(0.0), lambda a, b: a + part(b)) / total(counts)


def _area(d0: Column, d1: Column, width: Column) -> Column:
    """Integral of |d| over a stretch on which d runs linearly from d0 to d1."""
    same = d0 * d1 >= 0
    both = F.abs(d0) + F.abs(d1)
    return F.when(same, width * both / 2).otherwise(width * (d0 * d0 + d1 * d1) / (2 * F.when(~same, both)))


def wasserstein(counts_a: Column, counts_b: Column, edges: Column) -> Column:
    """Wasserstein-1 of two interior histograms on the same edges, exactly; null if either is empty."""
    ma, mb = total(counts_a), total(counts_b)
    bins = F.transform(F.arrays_zip(counts_a.alias("a"), counts_b.alias("b")), lambda z, i: F.struct((z["a"] / ma - z["b"] / mb).alias("d"), (F.get(edges, i + 1) - F.get(edges, i)).alias("w")))
    start = F.struct(F.lit(0.0).alias("d"), F.lit(0.0).alias("area"))
    step = lambda a, b: F.struct((a["d"] + b["d"]).alias("d"), (a["area"] + _area(a["d"], a["d"] + b["d"], b["w"])).alias("area"))
    return F.when((ma > 0) & (mb > 0), F.aggregate(bins, start, step, lambda a: a["area"]))


def wasserstein_grid(counts_a: Column, edges_a: Column, counts_b: Column, edges_b: Column, points: Column) -> Column:
    """Wasserstein-1 of two interior histograms by the trapezoid rule over ascending points."""
    gaps = F.transform(points, lambda x: F.struct(x.alias("x"), F.abs(_cdf(x, counts_a, edges_a) - _cdf(x, counts_b, edges_b)).alias("d")))
    start = F.struct(F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("d"), F.lit(0.0).alias("area"))
    step = lambda a, p: F.struct(p["x"].alias("x"), p["d"].alias("d"), (a["area"] + F.coalesce((a["d"] + p["d"]) / 2 * (p["x"] - a["x"]), F.lit(0.0))).alias("area"))
    return F.when((total(counts_a) > 0) & (total(counts_b) > 0), F.aggregate(gaps, start, step, lambda a: a["area"]))


def grid(edges_a: Column, edges_b: Column, points: int = 1024) -> Column:
    """Equally spaced points over the union of two ranges."""
    lo = F.least(F.get(edges_a, F.lit(0)), F.get(edges_b, F.lit(0)))
    hi = F.greatest(F.get(edges_a, F.size(edges_a) - 1), F.get(edges_b, F.size(edges_b) - 1))
    return F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: lo + (hi - lo) * i / (points - 1))


def union_edges(edges_a: Column, edges_b: Column) -> Column:
    """All edges of both schemas, between which both cumulative curves are straight."""
    return F.array_sort(F.array_union(edges_a, edges_b))


def occupancy(boundaries: list[float], labels: list[str], counts: Column | str = "counts", edges: Column | str = "edges", under: Column | str = "under", over: Column | str = "over") -> list[Column]:
    """Share of the mass in each band; bins are split by width.  All 0 if empty.

    Underflow is in the lowest band, overflow in the highest.
    """
    counts, edges, under, over = (F.col(x) if isinstance(x, str) else x for x in (counts, edges, under, over))
    mass = total(counts) + under + over
    out = []
    for j, label in enumerate(labels):
        lo = F.lit(boundaries[j - 1]) if j else F.lit(float("-inf"))
        hi = F.lit(boundaries[j]) if j < len(boundaries) else F.lit(float("inf"))
        share = lambda b, lo=lo, hi=hi: F.when(b["hi"] > b["lo"], F.greatest(F.lit(0.0), F.least(b["hi"], hi) - F.greatest(b["lo"], lo)) / F.when(b["hi"] > b["lo"], b["hi"] - b["lo"])).otherwise(((b["lo"] >= lo) & (b["lo"] < hi)).cast("double"))
        inside = F.aggregate(_bins(counts, edges), F.lit(0.0), (lambda share: lambda a, b: a + b["c"] * share(b))(share))
        outside = (under if not j else F.lit(0.0)) + (over if j == len(labels) - 1 else F.lit(0.0))
        out.append(F.when(mass > 0, (inside + outside) / F.when(mass > 0, mass)).otherwise(F.lit(0.0)).alias(label))
    return out
