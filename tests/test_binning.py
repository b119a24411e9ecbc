import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.functions import binning

EDGES = [10.0, 20.0, 25.0, 40.0]
CASES = [(9.9, 0), (10.0, 1), (19.99, 1), (20.0, 2), (25.0, 3), (40.0, 3), (40.1, 4), (float("inf"), 4), (float("-inf"), 0), (None, None), (float("nan"), None)]


def frame(spark, values):
    return spark.createDataFrame([(v,) for v in values], "value double")


def test_both_assignments_follow_the_rule(spark):
    df = frame(spark, [v for v, _ in CASES]).select(binning.bin_of(F.col("value"), EDGES).alias("a"), binning.bin_in(F.col("value"), F.array(*map(F.lit, EDGES))).alias("b"))
    assert [tuple(r) for r in df.collect()] == [(b, b) for _, b in CASES]


def test_fit_equals_linear_quantiles_and_id(spark):
    rng = np.random.default_rng(3)
    values = rng.normal(21, 3, 5000)
    df = spark.createDataFrame([("s", float(v)) for v in values], "scope string, value double")
    row = binning.fit_schemas(df, scope=["scope"], bins=48, channel="temperature", fit_start="a", fit_end="b").first()
    wanted = np.unique(np.round(np.quantile(values, np.linspace(0, 1, 49)), 9))
    assert np.allclose(row["edges"], wanted, atol=1e-9)
    text = "s|temperature|a|b|" + ",".join(f"{e:.6f}" for e in row["edges"])
    assert row["schema_id"] == "bm_" + hashlib.sha256(text.encode()).hexdigest()[:12]


def test_equal_mass(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([("s", float(v)) for v in rng.normal(21, 3, 20_000)], "scope string, value double")
    fitted = binning.fit_schemas(df, scope=["scope"], bins=50)
    counts = [r["n"] for r in binning.assign_bins(df, fitted, scope=["scope"]).groupBy("bin").agg(F.count("*").alias("n")).collect()]
    inside = [n for n in counts if n > 1]  # rounding the edges may leave the extremes outside
    assert len(inside) == 50 and all(abs(n - 400) <= 60 for n in inside)


def test_too_few_values_raise_or_are_dropped(spark):
    df = spark.createDataFrame([("few", 1.0), ("few", 2.0)] + [("flat", 7.0)] * 30, "scope string, value double")
    with pytest.raises(PySparkException):
        binning.fit_schemas(df, scope=["scope"], bins=8).collect()
    assert binning.fit_schemas(df, scope=["scope"], bins=8, strict=False).count() == 0


@pytest.mark.parametrize(("n", "bins"), [(0, 8), (60, 8), (10_000, 256), (2000, 100)])
def test_recommended_bins(spark, n, bins):
    assert spark.range(1).select(binning.recommended_bins(F.lit(n))).first()[0] == bins


def test_automatic_bin_count(spark):
    df = spark.createDataFrame([("s", float(i)) for i in range(400)], "scope string, value double")
    assert len(binning.fit_schemas(df, scope=["scope"]).first()["edges"]) == 21


def test_many_schemas_take_the_join(spark, monkeypatch):
    rng = random.Random(2)
    df = spark.createDataFrame([(f"s{i % 3}", rng.random()) for i in range(300)], "scope string, value double")
    fitted = binning.fit_schemas(df, scope=["scope"], bins=8).cache()
    a = binning.assign_bins(df, fitted, scope=["scope"]).groupBy("scope", "bin").count().collect()
    monkeypatch.setattr(binning, "LITERAL_EDGES", 1)
    b = binning.assign_bins(df, fitted, scope=["scope"]).groupBy("scope", "bin").count().collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_schema_edges_cover_open_bins(spark):
    df = spark.createDataFrame([("x", [0.0, 1.0, 3.0, 6.0])], "schema_id string, edges array<double>")
    rows = binning.schema_edges(df).orderBy("bin").collect()
    assert [r["bin"] for r in rows] == [0, 1, 2, 3, 4]
    assert [r["midpoint"] for r in rows] == [0.0, 0.5, 2.0, 4.5, 6.0]
    assert math.isinf(rows[0]["lower_edge"]) and math.isinf(rows[-1]["upper_edge"])


def test_normalised_is_not_clamped(spark):
    df = frame(spark, [10.0, 25.0, 55.0]).select(binning.normalised(F.col("value"), F.array(*map(F.lit, EDGES))))
    assert [r[0] for r in df.collect()] == [0.0, 0.5, 1.5]


def test_approximate_fit_is_close(spark):
    df = spark.createDataFrame([("s", float(i)) for i in range(10_000)], "scope string, value double")
    exact = binning.fit_schemas(df, scope=["scope"], bins=10).first()["edges"]
    near = binning.fit_schemas(df, scope=["scope"], bins=10, accuracy=1000).first()["edges"]
    assert max(abs(a - b) for a, b in zip(exact, near)) <= 20


def test_sorted_quantiles_are_the_same_schemas(spark):
    rng = np.random.default_rng(5)
    rows = [(k, float(v)) for k, n in (("a", 3000), ("b", 701), (None, 97)) for v in rng.normal(20, 5, n)] + [("a", 20.0)] * 500 + [("c", None), ("b", float("nan"))]
    df = spark.createDataFrame(rows, "instrument_id string, value double").repartition(7)
    for bins in (16, None):
        plain, by_sort = (sorted(map(tuple, binning.fit_schemas(df, scope=["instrument_id"], bins=bins, by_sort=b).collect()), key=str) for b in (False, True))
        assert by_sort == plain and len(plain) == (3 if bins else 2)
    assert binning.fit_schemas(df.limit(0), scope=["instrument_id"], bins=16, by_sort=True).isEmpty()
