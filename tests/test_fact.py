from datetime import datetime, timedelta

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.operators import fact as facts
from tidemark.operators import serving

H = datetime(2024, 6, 1, 9)
SCHEMA = "instrument_id string, channel string, schema_id string, bin int, event_hour timestamp_ntz, arrival_time timestamp_ntz, delta bigint, value double, entry_type string, measurement_id string, event_date date"


def row(bin_, arrival, delta=1, schema="s1", hour=H, value=21.0):
    return ("T", "temperature", schema, bin_, hour, arrival, delta, value, "measurement", None, hour.date())


def bins(df):
    return {r["bin"]: r["cnt"] for r in df.collect()}


@pytest.fixture
def late(spark):
    return spark.createDataFrame([row(3, H + timedelta(minutes=10)), row(7, H + timedelta(days=2))], SCHEMA)


def test_as_of_is_inclusive(late):
    assert bins(facts.as_of(late, H + timedelta(hours=1))) == {3: 1}
    assert bins(facts.as_of(late, H + timedelta(days=2))) == {3: 1, 7: 1}
    assert bins(facts.as_of(late, H)) == {}


def test_horizons(late):
    for name, wanted in (("1h", {3: 1}), ("24h", {3: 1}), ("7d", {3: 1, 7: 1}), ("final", {3: 1, 7: 1})):
        assert bins(facts.at_horizon(late, facts.HORIZONS[name])) == wanted


def test_correction_moves_a_reading(spark):
    schemas = spark.createDataFrame([("T", "s1", [0.0, 10.0, 22.0, 30.0])], "instrument_id string, schema_id string, edges array<double>")
    readings = spark.createDataFrame([("T", "temperature", 21.0, H, H, "m1")], "instrument_id string, channel string, value double, event_time timestamp_ntz, arrival_time timestamp_ntz, measurement_id string")
    changed = spark.createDataFrame([("T", "temperature", 21.0, 27.0, H, H + timedelta(days=1), "m1")], "instrument_id string, channel string, old_value double, new_value double, event_time timestamp_ntz, arrival_time timestamp_ntz, measurement_id string")
    fact = facts.increments(readings, schemas).unionByName(facts.corrections(changed, schemas))
    assert fact.count() == 3
    assert bins(facts.as_of(fact, H + timedelta(hours=1))) == {2: 1}
    assert bins(facts.current(fact)) == {3: 1}
    assert facts.powers_as_of(fact, None, ["instrument_id"]).first()["s1"] == 27.0


def test_negative_nets_stay_and_zeros_go(spark):
    fact = spark.createDataFrame([row(1, H, -1), row(2, H, 1), row(2, H, -1)], SCHEMA)
    assert bins(facts.current(fact)) == {1: -1}


def test_guard_looks_before_the_arrival_filter(spark):
    fact = spark.createDataFrame([row(3, H), row(3, H + timedelta(days=9), schema="s2")], SCHEMA)
    with pytest.raises(PySparkException):
        facts.as_of(fact, H, guard=True).collect()
    assert bins(facts.as_of(fact, H, schema_id="s1", guard=True)) == {3: 1}


def test_changes_are_half_open(late):
    t = H + timedelta(minutes=10)
    assert [r["bin"] for r in facts.changes_between(late, t, H + timedelta(days=2)).collect()] == [7]
    assert facts.then_and_now(late, t, H + timedelta(days=3)).count() == 1


def test_hour_filter_reaches_the_partition(spark, late, tmp_path):
    facts.write_fact(late, f"file://{tmp_path}/fact")
    plan = facts.select(spark.read.parquet(f"file://{tmp_path}/fact"), hour=H)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan


def test_incremental_state_is_the_rebuild(spark, tmp_path):
    import random

    rng = random.Random(9)
    rows = [row(rng.randrange(32), H, rng.choice([1, 1, -1])) for _ in range(600)]
    cuts = sorted(rng.sample(range(600), 4))
    path = f"file://{tmp_path}/state"
    for i, (a, b) in enumerate(zip([0, *cuts], [*cuts, 600])):
        serving.apply_batch(path, str(i), spark.createDataFrame(rows[a:b], SCHEMA))
    serving.apply_batch(path, "2", spark.createDataFrame(rows[cuts[1] : cuts[2]], SCHEMA))  # a replay
    whole = serving.net(spark.createDataFrame(rows, SCHEMA))
    assert serving.difference(serving.current_state(spark, path), whole).isEmpty()
    serving.compact(spark, path, f"{path}-compact")
    assert serving.difference(serving.current_state(spark, f"{path}-compact"), whole).isEmpty()
    assert serving.distribution(whole, "T", "s1").count() == whole.count()


def test_plot_view_has_every_bin(spark, late):
    schemas = spark.createDataFrame([("s1", [float(i) for i in range(9)])], "schema_id string, edges array<double>")
    serving.register_views(late, schemas)
    assert spark.sql("SELECT sum(cnt), count(*) FROM histogram_plot").first()[:] == (2, 10)
    for view in ("increment_fact", "bin_schema", "histogram", "histogram_plot"):
        spark.catalog.dropTempView(view)
    assert late.select(F.max("bin")).first()[0] == 7
