import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import binning, moments, shape


def values(spark, xs, scope="s"):
    return spark.createDataFrame([(scope, float(x)) for x in xs], "scope string, value double")


def histogram(df, fitted):
    return binning.assign_bins(df, fitted, scope=["scope"]).groupBy("scope", "schema_id", "bin").agg(F.count("*").alias("cnt"))


def test_moments_match_numpy_and_add_up(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(20, 2, 4000), rng.normal(25, 4, 3000)
    parts = values(spark, a, "a").groupBy("scope").agg(*moments.power_sums()).union(values(spark, b, "b").groupBy("scope").agg(*moments.power_sums()))
    got = parts.agg(*moments.merged()).select(*moments.moments()).first()
    x = np.concatenate((a, b))
    d = x - x.mean()
    assert got["mean"] == pytest.approx(x.mean(), rel=1e-9)
    assert got["variance"] == pytest.approx(x.var(), rel=1e-6)
    assert got["skewness"] == pytest.approx((d**3).mean() / x.std() ** 3, abs=1e-4)
    assert got["kurtosis_excess"] == pytest.approx((d**4).mean() / x.var() ** 2 - 3, abs=1e-4)


def test_moments_of_constant_and_empty(spark):
    flat = values(spark, [5, 5, 5]).groupBy().agg(*moments.power_sums()).select(*moments.moments()).first()
    assert (flat["mean"], flat["variance"], flat["skewness"], flat["kurtosis_excess"]) == (5.0, 0.0, 0.0, 0.0)
    none = values(spark, []).groupBy().agg(*moments.power_sums()).select(*moments.moments()).first()
    assert none["mean"] is None and none["variance"] is None


def test_retraction_subtracts(spark):
    df = spark.createDataFrame([(21.0, 1), (21.0, -1), (27.0, 1)], "value double, delta bigint")
    got = df.groupBy().agg(*moments.power_sums("value", F.col("delta"))).first()
    assert (got["n"], got["s1"]) == (1.0, 27.0)


def brute_percentile(edges, counts, under, over, q):
    mass, cum = sum(counts) + under + over, under
    if q * mass <= under:
        return edges[0]
    for i, c in enumerate(counts):
        if c > 0 and q * mass <= cum + c:
            return edges[i] + (q * mass - cum) / c * (edges[i + 1] - edges[i])
        cum += c
    return edges[-1]


@pytest.mark.parametrize(("counts", "under", "over"), [([3, 0, 5], 0, 0), ([1, 1, 1], 4, 9), ([0, 0, 0], 2, 0), ([0, 0, 0], 0, 3)])
def test_percentiles(spark, counts, under, over):
    edges = [0.0, 1.0, 4.0, 5.0]
    df = spark.createDataFrame([([float(c) for c in counts], edges, float(under), float(over))], "counts array<double>, edges array<double>, under double, over double")
    for q in (0.0, 0.3, 0.5, 0.99, 1.0):
        assert df.select(shape.percentile(q)).first()[0] == pytest.approx(brute_percentile(edges, counts, under, over, q))


def test_percentile_and_entropy_of_nothing(spark):
    df = spark.createDataFrame([([0.0, 0.0], [0.0, 1.0, 2.0], 0.0, 0.0)], "counts array<double>, edges array<double>, under double, over double")
    assert df.select(shape.percentile(0.5)).first()[0] is None
    assert tuple(df.select(*shape.entropy()).first()) == (0.0, 0.0)


def test_entropy_is_one_when_even_and_lower_when_not(spark):
    df = spark.createDataFrame([([5.0] * 4,), ([17.0, 1.0, 1.0, 1.0],)], "counts array<double>")
    even, odd = [r[0] for r in df.select(shape.entropy()[1]).collect()]
    assert even == pytest.approx(1.0) and odd < 0.7


def test_wasserstein_of_a_shift(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(20, 3, 20_000)
    fitted = binning.fit_schemas(values(spark, np.concatenate((x, x + 5))), scope=["scope"], bins=64).cache()
    a = shape.dense(histogram(values(spark, x), fitted), fitted, ["scope"]).select(F.col("counts").alias("a"), "edges")
    b = shape.dense(histogram(values(spark, x + 5), fitted), fitted, ["scope"]).select(F.col("counts").alias("b"))
    got = a.crossJoin(b).select(
        shape.wasserstein(F.col("a"), F.col("b"), F.col("edges")),
        shape.wasserstein(F.col("a"), F.col("a"), F.col("edges")),
        shape.wasserstein_grid(F.col("a"), F.col("edges"), F.col("b"), F.col("edges"), shape.grid(F.col("edges"), F.col("edges"))),
    ).first()
    assert got[0] == pytest.approx(5.0, abs=0.2) and got[1] == 0.0 and got[2] == pytest.approx(got[0], abs=2e-2)


def test_wasserstein_of_an_empty_interior_is_null(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 1.0], [0.0, 1.0, 2.0])], "a array<double>, b array<double>, e array<double>")
    assert df.select(shape.wasserstein(F.col("a"), F.col("b"), F.col("e"))).first()[0] is None
