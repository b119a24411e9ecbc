"""The JSON contract of readings: one record or an array of records per payload."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RECORD = "struct<instrument_id:string,measurement_id:string,event_time:string,arrival_time:string,values:map<string,double>>"


def parse(payloads: DataFrame, *, column: str = "payload") -> tuple[DataFrame, DataFrame]:
    """(readings, quarantined) from a column of JSON texts.

    readings: instrument_id, measurement_id, channel, event_time, arrival_time, value,
    payload_hash, a row per channel.  The hash is of the payload as it came, so a payload
    sent again can be told.  Payloads that do not parse, records without instrument, time
    or values are quarantined with a `problem`.
    """
    text = F.col(column)
    rows = payloads.select(text.alias("payload"), F.sha2(text.cast("binary"), 256).alias("payload_hash"), F.from_json(text, f"array<{RECORD}>", {"mode": "PERMISSIVE"}).alias("records"))
    rows = rows.select("payload", "payload_hash", F.explode_outer("records").alias("r"))
    event, arrival = (F.try_to_timestamp(F.col(f"r.{c}")).cast("timestamp_ntz") for c in ("event_time", "arrival_time"))
    problem = (
        F.when(F.col("r").isNull(), "not a record")
        .when(F.coalesce(F.col("r.instrument_id"), F.lit("")) == "", "no instrument")
        .when(F.col("r.values").isNull() | (F.size("r.values") <= 0), "no values")
        .when(event.isNull(), "no event time")
    )
    marked = rows.withColumns({"problem": problem, "event": event, "arrival": arrival})
    good = marked.where("problem IS NULL").select("payload_hash", "r", "event", "arrival", F.explode("r.values").alias("channel", "value"))
    readings = good.select("r.instrument_id", "r.measurement_id", "channel", F.col("event").alias("event_time"), F.coalesce("arrival", "event").alias("arrival_time"), "value", "payload_hash")
    return readings, marked.where("problem IS NOT NULL").select("payload", "payload_hash", "problem")
