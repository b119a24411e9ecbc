from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import drift
from tidemark.operators.bands import BandScheme
from tidemark.plans.catalog import mean_shift, scenario, simulated_drift
from tidemark.functions import binning
from tidemark.sources import simulator


def published(spark, fault, injected, calib):
    """Distances and threshold with all clean days as calibration, as the published runs did."""
    rows = simulator.simulate(spark, scenario(faults=(fault,))).withColumn("day", F.to_date("event_time"))
    clean = ~F.col("day").isin([datetime(2024, 6, d).date() for d in injected])
    fitted = binning.fit_schemas(rows.where(clean), scope=["instrument_id"], bins=48)
    daily = binning.assign_bins(rows, fitted, scope=["instrument_id"]).groupBy("instrument_id", "schema_id", "day", "bin").agg(F.count("*").alias("cnt"))
    found = drift.detect(daily, fitted, clean, instrument=["instrument_id"], window=["day"], points=1024)
    hit = found.where(~clean).orderBy("day").collect()
    return [round(r["distance"], 3) for r in hit], round(hit[0]["threshold"], 3)


@pytest.mark.parametrize(("kind", "amount", "distances"), [("mean_shift", 3.0, [2.791, 2.804, 2.767]), ("mean_shift", 8.0, [5.653, 5.688, 5.726]), ("variance_inflation", 3.0, [0.956, 0.830, 0.825]), ("mean_shift", 1.0, [0.778, 0.790, 0.720])])
def test_published_distances(spark, kind, amount, distances):
    first = mean_shift(amount)
    got, threshold = published(spark, simulator.Fault(kind, first.start, first.end, amount), (27, 28, 29), 28)
    assert got == distances and threshold == 2.715


def test_leading_calibration_catches_the_shift(spark):
    found = simulated_drift(spark, mean_shift(4.0)).cache()
    truth = F.col("day").between(datetime(2024, 6, 27).date(), datetime(2024, 6, 29).date())
    scored = found.where(F.col("day") >= datetime(2024, 6, 24).date())
    row = drift.confusion(scored, truth).first()
    assert (row["tp"], row["fn"], row["fp"], row["tn"]) == (3, 0, 0, 11)


def test_all_overflow_is_novel_and_never_drift(spark):
    schemas = spark.createDataFrame([("s", [0.0, 1.0, 2.0])], "schema_id string, edges array<double>")
    windows = spark.createDataFrame([("T", "w1", "s", 3, 9), ("T", "w2", "s", 1, 9)], "instrument_id string, w string, schema_id string, bin int, cnt bigint")
    found = drift.detect(windows, schemas, F.col("w") == "w2", instrument=["instrument_id"], window=["w"])
    row = found.where("w = 'w1'").first()
    assert row["distance"] is None and row["novelty"] and row["is_drift"] is False and row["overflow_frac"] == 1.0


def test_flat_distances_take_one_and_a_half_times_the_largest(spark):
    df = spark.createDataFrame([("T", 2.0)] * 3 + [("U", None)], "instrument_id string, distance double")
    assert [tuple(r) for r in drift.thresholds(df, instrument=["instrument_id"]).collect()] == [("T", 3.0)]


def test_bands(spark):
    scheme = BandScheme.severity(28.0, 33.0, 38.0)
    df = spark.createDataFrame([(v,) for v in (20.0, 28.0, 30.0, 33.0, 41.0, None)], "value double")
    assert [r["band"] for r in scheme.classify(df).collect()] == ["Nominal", "Elevated", "Elevated", "Warning", "Critical", None]
    with pytest.raises(ValueError):
        BandScheme((3.0, 2.0), ("a", "b", "c"))
    with pytest.raises(ValueError):
        BandScheme((3.0,), ("a",))


def test_occupancy_splits_bins_and_sums_to_one(spark):
    schemas = spark.createDataFrame([("s", [20.0, 30.0, 40.0])], "schema_id string, edges array<double>")
    h = spark.createDataFrame([("T", "s", 0, 1), ("T", "s", 1, 4), ("T", "s", 2, 4), ("T", "s", 3, 1)], "instrument_id string, schema_id string, bin int, cnt bigint")
    row = BandScheme.severity(28.0, 33.0, 38.0).occupancy(h, schemas, ["instrument_id"]).first()
    assert row["Nominal"] == pytest.approx(0.1 + 0.4 * 0.8) and row["Critical"] == pytest.approx(0.1 + 0.4 * 0.2)
    assert sum(row[x] for x in ("Nominal", "Elevated", "Warning", "Critical")) == pytest.approx(1.0)


def test_mahalanobis_is_numpys(spark):
    rng = np.random.default_rng(4)
    mix = rng.normal(size=(4, 4))
    rows = [(k, i, [float(x) for x in rng.normal(size=4) @ mix + 10] + [1.0]) for k in ("a", "b") for i in range(60)] + [("c", 99, [0.0] * 5)]
    df = spark.createDataFrame(rows, "instrument_id string, i int, vector array<double>")
    got = {(r["instrument_id"], r["i"]): r["mahalanobis"] for r in drift.mahalanobis(df, F.col("i") < 40, 5, instrument=["instrument_id"]).collect()}
    assert got.pop(("c", 99)) is None
    for k in ("a", "b"):
        x = np.array([v for kk, i, v in rows if kk == k and i < 40])[:, :4]
        inverse = np.linalg.inv(np.cov(x.T, bias=True))
        for kk, i, v in rows:
            if kk == k:
                gap = np.array(v[:4]) - x.mean(axis=0)
                assert got[k, i] == pytest.approx(float(np.sqrt(gap @ inverse @ gap)), rel=1e-6)
