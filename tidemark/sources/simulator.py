"""A simulated instrument with injected faults and their ground truth."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Field parameters: annual mean, seasonal and daily amplitude, noise, warmest day and hour.  Fixed values.
FIELD = {"annual_mean": 21.0, "seasonal": 6.0, "daily": 5.0, "noise": 1.5, "peak_day": 20.0, "peak_hour": 14.0, "year": 365.25}
TRUTH_SCHEMA = "kind string, start string, end string, detail string"


@dataclass(frozen=True)
class Fault:
    """kind: mean_shift, variance_inflation, stuck (over [start, end)) or spike (at start)."""

    kind: str
    start: datetime
    end: datetime | None
    amount: float


@dataclass(frozen=True)
class Instrument:
    instrument_id: str
    start: datetime
    end: datetime
    per_hour: int = 60
    seed: int = 0
    channel: str = "temperature"
    latency_s: int = 5
    faults: tuple[Fault, ...] = field(default_factory=tuple)

    @property
    def step_s(self) -> float:
        return 3600.0 / self.per_hour

    @property
    def readings(self) -> int:
        return max(0, int(np.ceil((self.end - self.start).total_seconds() / self.step_s)))


def seasonal_field(ts: Column) -> Column:
    """Noise-free temperature at a wall-clock time."""
    p = FIELD
    day_s = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.floor(F.second(ts))
    day = F.dayofyear(ts) + day_s / 86400.0
    year = p["annual_mean"] + p["seasonal"] * F.cos(2 * np.pi * (day - p["peak_day"]) / p["year"])
    return year + p["daily"] * F.cos(2 * np.pi * (day_s / 3600.0 - p["peak_hour"]) / 24.0)


def _noise(seed: int, n: int, std: float):
    """Normal noise number i of a seeded generator, for row numbers in any order.

    One generator gives an instrument's whole sequence, so each task draws it from the
    start; a year of minutes is 4 MB.  Many instruments are simulated as many frames.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        drawn = np.random.default_rng(seed).normal(0.0, std, n)
        for batch in batches:
            yield batch.assign(noise=drawn[batch["i"].to_numpy()])

    return run


def simulate(spark: SparkSession, instrument: Instrument) -> DataFrame:
    """instrument_id, measurement_id, channel, event_time, arrival_time, value, in any order.

    Shifts add up and inflations multiply the noise; a stuck value overrides these, a spike
    everything.  A spike hits readings closer than half a step.
    """
    s, step = instrument, F.lit(instrument.step_s)
    at = lambda t: F.lit(t).cast("timestamp_ntz")
    rows = spark.range(s.readings).withColumnRenamed("id", "i")
    rows = rows.mapInPandas(_noise(s.seed, s.readings, FIELD["noise"]), "i bigint, noise double")
    micros = F.round(F.col("i") * step * 1_000_000).cast("bigint")
    rows = rows.withColumn("event_time", at(s.start) + F.make_dt_interval(secs=(micros / F.lit(1_000_000)).cast("decimal(18,6)")))
    ts = F.col("event_time")
    during = lambda f: (ts >= at(f.start)) & (ts < at(f.end))
    offset, factor = F.lit(0.0), F.lit(1.0)
    for f in s.faults:
        if f.kind == "mean_shift":
            offset = offset + F.when(during(f), F.lit(f.amount)).otherwise(F.lit(0.0))
        elif f.kind == "variance_inflation":
            factor = factor * F.when(during(f), F.lit(f.amount)).otherwise(F.lit(1.0))
    value = seasonal_field(ts) + F.col("noise") * factor + offset
    for f in s.faults:
        if f.kind == "stuck":
            value = F.when(during(f), F.lit(f.amount)).otherwise(value)
    for f in s.faults:
        if f.kind == "spike":
            half = timedelta(seconds=s.step_s / 2)
            value = F.when((ts > at(f.start - half)) & (ts < at(f.start + half)), F.lit(f.amount)).otherwise(value)
    return rows.select(
        F.lit(s.instrument_id).alias("instrument_id"),
        F.format_string(f"{s.instrument_id}-%08d", "i").alias("measurement_id"),
        F.lit(s.channel).alias("channel"),
        "event_time",
        (ts + F.make_dt_interval(secs=F.lit(s.latency_s))).alias("arrival_time"),
        F.round(value, 3).alias("value"),
    )


#: Numbers that a task draws at once.
BLOCK = 100_000


def _draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for k, n, seed in zip(batch["k"], batch["n"], batch["seed"], strict=True):
            drawn = np.random.default_rng(seed)
            for lo in range(0, n, BLOCK):
                size = min(BLOCK, n - lo)
                yield pd.DataFrame({"k": np.full(size, k, dtype=np.int32), "i": np.arange(lo, lo + size), "noise": drawn.normal(0.0, FIELD["noise"], size)})


def simulate_all(spark: SparkSession, instruments: list[Instrument]) -> DataFrame:
    """The readings of many instruments as `simulate` gives them one by one, in one frame.

    Each instrument's noise is drawn by one task in blocks.  The faults are a table that
    the readings are range-joined with; only readings that a fault hits are aggregated.
    """
    plan = [(k, s.instrument_id, s.channel, s.start, s.step_s, s.readings, s.seed, s.latency_s) for k, s in enumerate(instruments)]
    plan = spark.createDataFrame(plan, "k int, instrument_id string, channel string, start timestamp_ntz, step double, n bigint, seed bigint, latency int")
    drawn = plan.select("k", "n", "seed").repartition(max(1, len(instruments)), "k").mapInPandas(_draw, "k int, i bigint, noise double")
    seconds = lambda x: F.make_dt_interval(secs=x.cast("decimal(18,6)"))
    rows = drawn.join(F.broadcast(plan.drop("n", "seed")), "k")  # as many rows as the caller's list
    rows = rows.withColumn("event_time", F.col("start") + seconds(F.round(F.col("i") * F.col("step") * 1_000_000) / F.lit(1_000_000)))
    faults = [(k, place, f.kind, f.start, f.end, float(f.amount)) for k, s in enumerate(instruments) for place, f in enumerate(s.faults)]
    faults = spark.createDataFrame(faults, "fault_of int, place int, kind string, begins timestamp_ntz, ends timestamp_ntz, amount double")
    ts, half = F.col("event_time"), seconds(F.col("step") / 2)
    during = F.when(F.col("kind") == "spike", (ts > F.col("begins") - half) & (ts < F.col("begins") + half)).otherwise((ts >= F.col("begins")) & (ts < F.col("ends")))
    of = lambda kind: F.when(F.col("kind") == kind, F.col("amount"))
    last = lambda kind: F.max_by(of(kind), F.when(F.col("kind") == kind, F.col("place"))).alias(kind)
    hit = rows.join(F.broadcast(faults), (F.col("k") == F.col("fault_of")) & during).groupBy("k", "i")
    hit = hit.agg(F.sum(of("mean_shift")).alias("shift"), F.product(of("variance_inflation")).alias("factor"), last("stuck"), last("spike"))
    rows = rows.join(hit, ["k", "i"], "left")
    value = seasonal_field(ts) + F.col("noise") * F.coalesce("factor", F.lit(1.0)) + F.coalesce("shift", F.lit(0.0))
    return rows.select(
        "instrument_id",
        F.concat_ws("-", "instrument_id", F.lpad(F.col("i").cast("string"), 8, "0")).alias("measurement_id"),
        "channel",
        "event_time",
        (ts + F.make_dt_interval(secs=F.col("latency"))).alias("arrival_time"),
        F.round(F.coalesce("spike", "stuck", value), 3).alias("value"),
    )


def ground_truth(spark: SparkSession, instrument: Instrument) -> DataFrame:
    """One row per fault: kind, start, end, detail (JSON); drift faults, then stuck, then spikes."""
    rank = {"mean_shift": 0, "variance_inflation": 0, "stuck": 1, "spike": 2}
    rows = []
    for f in sorted(instrument.faults, key=lambda f: rank[f.kind]):
        what = "magnitude" if rank[f.kind] == 0 else "value"
        rows.append((f.kind, f.start.isoformat(), f.end.isoformat() if f.end else None, json.dumps({what: f.amount, "channel": instrument.channel})))
    return spark.createDataFrame(rows, TRUTH_SCHEMA)


def as_json(readings: DataFrame) -> DataFrame:
    """One column `payload`: the JSON record of each reading."""
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    return readings.select(F.to_json(F.struct("instrument_id", "measurement_id", iso("event_time").alias("event_time"), iso("arrival_time").alias("arrival_time"), F.create_map("channel", "value").alias("values"))).alias("payload"))
