import json
from datetime import datetime, timedelta

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.functions import binning, channels
from tidemark.plans.catalog import scenario
from tidemark.sources import config, contract, simulator
from tidemark.streaming import ingest

CONFIG = """
instrument_types:
  thermometer:
    channels: [{name: temperature, rank: 0, kind: linear, unit: celsius}]
    bands: {nominal: [18.0, 26.0], critical: [38.0, .inf]}
    drift_rules: [{baseline: previous_hour, metric: wasserstein, threshold: auto}]
instruments:
  - {id: T1, type: thermometer, labels: [outdoor], location: {latitude: 1.0, longitude: 2.0, datum: WGS84, epoch: "2020.0"}}
"""


def test_decompose(spark):
    df = spark.createDataFrame([([21.5],), ([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>")
    rows = channels.decompose(df, "v", 1).collect()
    assert [(r["magnitude"], r["direction"]) for r in rows] == [(21.5, None), (5.0, [0.6, 0.8]), (0.0, None)]
    with pytest.raises(PySparkException):
        channels.decompose(df, "v", 2).collect()


def test_channel_problems(spark):
    df = spark.createDataFrame([("a", 1, "linear"), ("", 1, "linear"), ("a", 3, "linear"), ("a", 0, "odd")], "name string, rank int, kind string")
    good, bad = channels.split_valid(df, channels.channel_problem(F.col("name"), F.col("rank"), F.col("kind")))
    assert good.count() == 1 and bad.count() == 3


def test_hour_keeps_the_wall_clock(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 2, 3, 4, 5),)], "t timestamp_ntz").select(channels.event_hour(F.col("t")).alias("h"))
    assert df.dtypes == [("h", "timestamp_ntz")] and df.first()[0] == datetime(2024, 1, 2, 3)


def test_simulator_is_repeatable_and_faults_stay_in_their_windows(spark):
    start = datetime(2024, 6, 10)
    plain = {r["measurement_id"]: r["value"] for r in simulator.simulate(spark, scenario(days=3, per_hour=4)).collect()}
    faults = (
        simulator.Fault("mean_shift", start + timedelta(days=1), start + timedelta(days=2), 5.0),
        simulator.Fault("stuck", start, start + timedelta(hours=1), 12.0),
        simulator.Fault("spike", start + timedelta(hours=10), None, 60.0),
    )
    rows = simulator.simulate(spark, scenario(days=3, per_hour=4, faults=faults)).collect()
    assert len(rows) == 288
    for r in rows:
        age = r["event_time"] - start
        wanted = plain[r["measurement_id"]]
        if timedelta(days=1) <= age < timedelta(days=2):
            wanted += 5.0
        wanted = 12.0 if age < timedelta(hours=1) else 60.0 if age == timedelta(hours=10) else wanted
        assert r["value"] == pytest.approx(wanted, abs=1.1e-3)
        assert r["arrival_time"] - r["event_time"] == timedelta(seconds=5)
    truth = simulator.ground_truth(spark, scenario(faults=faults)).collect()
    assert [r["kind"] for r in truth] == ["mean_shift", "stuck", "spike"] and json.loads(truth[2]["detail"])["value"] == 60.0


def test_contract_takes_one_or_many_and_quarantines(spark):
    one = json.dumps({"instrument_id": "T", "measurement_id": "1", "event_time": "2024-01-01T00:00:00.5", "arrival_time": "2024-01-01T00:00:05", "values": {"t": 1.5}})
    df = spark.createDataFrame([(one,), (f"[{one},{one}]",), ("{broken",), (json.dumps({"instrument_id": "", "values": {"t": 1}}),), (json.dumps({"instrument_id": "T", "event_time": "x", "values": {"t": 1}}),)], "payload string")
    good, bad = contract.parse(df)
    assert good.count() == 3 and sorted(r["problem"] for r in bad.collect()) == ["no event time", "no instrument", "not a record"]


def test_config(spark):
    found = config.load(spark, CONFIG)
    assert {k: v.count() for k, v in found.items()} == {"channels": 1, "bands": 2, "drift_rules": 1, "instruments": 1}
    with pytest.raises(ValueError):
        config.load(spark, "instruments: [{id: x, type: unknown}]")


def test_streaming_keeps_late_rows_and_drops_repeats(spark, tmp_path):
    home = f"file://{tmp_path}"
    rows = simulator.simulate(spark, scenario(days=1, per_hour=4))
    fitted = binning.fit_schemas(rows, scope=["instrument_id"], bins=8).cache()
    payload = simulator.as_json(rows).collect()
    late = json.loads(payload[0]["payload"]) | {"measurement_id": "late", "event_time": "2024-06-01T00:00:00"}
    spark.createDataFrame([(r["payload"],) for r in payload] * 2, "value string").coalesce(1).write.text(f"{home}/in")
    run = lambda: ingest.ingest(spark, f"{home}/in", fitted, f"{home}/fact", f"{home}/offsets", f"{home}/state").awaitTermination()
    run()
    assert ingest.stored_fact(spark, f"{home}/fact").count() == 96
    spark.createDataFrame([(json.dumps(late),), (payload[1]["payload"],)], "value string").coalesce(1).write.mode("append").text(f"{home}/in")
    run()
    stored = ingest.stored_fact(spark, f"{home}/fact")
    assert stored.count() == 97 and stored.where("measurement_id = 'late'").count() == 1
    # a replay of the second batch leaves the fact as it is
    ingest.write_batch(spark.createDataFrame([(json.dumps(late),)], "payload string"), 1, fitted, f"{home}/fact", f"{home}/state")
    assert ingest.stored_fact(spark, f"{home}/fact").count() == 97


def test_registry_interval(spark):
    at = lambda d: datetime(2024, 1, d)
    registry = spark.createDataFrame([("T", at(1), at(10), "a"), ("T", at(10), None, "b")], "instrument_id string, valid_from timestamp_ntz, valid_to timestamp_ntz, site string")
    rows = spark.createDataFrame([("T", at(9)), ("T", at(10)), ("U", at(10))], "instrument_id string, event_hour timestamp_ntz")
    assert sorted(str(r["site"]) for r in config.registered(rows, registry).collect()) == ["None", "a", "b"]


def test_many_instruments_are_each_one(spark, monkeypatch):
    monkeypatch.setattr(simulator, "BLOCK", 100)
    at = lambda day, hour=0: datetime(2024, 6, day, hour)
    faults = (simulator.Fault("mean_shift", at(11), at(12), 4.0), simulator.Fault("mean_shift", at(11, 6), at(13), 1.5), simulator.Fault("variance_inflation", at(11, 3), at(11, 9), 3.0), simulator.Fault("stuck", at(12, 3), at(12, 5), 9.0), simulator.Fault("stuck", at(12, 4), at(12, 6), 10.0), simulator.Fault("spike", at(12, 4), None, 58.0))
    fleet = [simulator.Instrument("A", at(10), at(14), per_hour=4, seed=3, faults=faults), simulator.Instrument("B", at(11), at(13), per_hour=7, seed=5), simulator.Instrument("C", at(11), at(11), seed=1)]
    got = sorted(map(tuple, simulator.simulate_all(spark, fleet).collect()))
    assert got == sorted(tuple(r) for x in fleet for r in simulator.simulate(spark, x).collect()) and len(got) == 4 * 96 + 2 * 24 * 7
    assert sum(r[5] == 58.0 for r in got) == 1
