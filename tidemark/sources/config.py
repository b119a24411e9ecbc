"""Instrument configuration from YAML, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CHANNELS = "type string, name string, rank int, kind string, unit string"
BANDS = "type string, label string, lower double, upper double"
RULES = "type string, baseline string, metric string, threshold string"
INSTRUMENTS = "instrument_id string, type string, labels array<string>, latitude double, longitude double, height_m double, datum string, epoch string, sampling_per_hour int"


def load(spark: SparkSession, text: str) -> dict[str, DataFrame]:
    """channels, bands, drift_rules and instruments of a configuration text.

    Missing parts give empty frames.  An instrument of an unknown type, or a location
    without datum and epoch, is an error.
    """
    import yaml

    spec = yaml.safe_load(text) or {}
    types = spec.get("instrument_types") or {}
    channels, bands, rules, instruments = [], [], [], []
    for name, t in types.items():
        channels += [(name, c["name"], int(c.get("rank", 0)), c.get("kind", "linear"), c.get("unit")) for c in t.get("channels") or []]
        bands += [(name, label, float(lo), float(hi)) for label, (lo, hi) in (t.get("bands") or {}).items()]
        rules += [(name, r["baseline"], r.get("metric", "wasserstein"), str(r.get("threshold", "auto"))) for r in t.get("drift_rules") or []]
    for i in spec.get("instruments") or []:
        if i.get("type") not in types:
            raise ValueError(f"instrument {i.get('id')} has the unknown type {i.get('type')}")
        place = i.get("location") or {}
        if place and not (place.get("datum") and place.get("epoch")):
            raise ValueError(f"the location of {i.get('id')} needs datum and epoch")
        number = lambda k: float(place[k]) if k in place else None  # noqa: B023, E731
        instruments.append((i["id"], i["type"], list(i.get("labels") or []), number("latitude"), number("longitude"), number("height_m"), place.get("datum"), place.get("epoch"), int(i.get("sampling_per_hour", 60))))
    return {
        "channels": spark.createDataFrame(channels, CHANNELS),
        "bands": spark.createDataFrame(bands, BANDS),
        "drift_rules": spark.createDataFrame(rules, RULES),
        "instruments": spark.createDataFrame(instruments, INSTRUMENTS),
    }


def registered(rows: DataFrame, registry: DataFrame, *, time: str = "event_hour") -> DataFrame:
    """rows with the registry entry of their instrument that is valid at their time.

    registry: instrument_id, valid_from, valid_to (null: open) and any other columns.
    """
    from pyspark.sql import functions as F

    r = registry.withColumnRenamed("instrument_id", "registry_id")
    at = F.col(time)
    return rows.join(r, (rows["instrument_id"] == r["registry_id"]) & (at >= F.col("valid_from")) & (F.col("valid_to").isNull() | (at < F.col("valid_to"))), "left").drop("registry_id")
