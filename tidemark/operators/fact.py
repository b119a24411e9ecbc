"""The bitemporal increment fact: append-only signed deltas and reads at any arrival time.

Columns: instrument_id, channel, schema_id, bin, event_hour, arrival_time, delta, value,
entry_type, measurement_id, event_date (the partition column of the stored table).
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binning import assign_bins
from ..functions.channels import event_hour
from ..functions.moments import power_sums

COLUMNS = ["instrument_id", "channel", "schema_id", "bin", "event_hour", "arrival_time", "delta", "value", "entry_type", "measurement_id", "event_date"]
KEYS = ["instrument_id", "channel", "schema_id", "bin", "event_hour"]


def _shaped(df: DataFrame, delta: int, kind: str) -> DataFrame:
    out = df.withColumns({"event_hour": event_hour(F.col("event_time")), "delta": F.lit(delta).cast("bigint"), "entry_type": F.lit(kind)})
    return out.withColumn("event_date", F.to_date("event_hour")).select(*COLUMNS)


def increments(readings: DataFrame, schemas: DataFrame, *, scope: list[str] | None = None) -> DataFrame:
    """One +1 row per reading (instrument_id, channel, value, event_time, arrival_time, measurement_id).

    Null and NaN values, and readings without a schema, make no row.
    """
    binned = assign_bins(readings, schemas, scope=scope if scope is not None else ["instrument_id"])
    return _shaped(binned.where(F.col("bin").isNotNull()), 1, "measurement")


def corrections(changes: DataFrame, schemas: DataFrame, *, scope: list[str] | None = None) -> DataFrame:
    """A retraction of old_value and an assertion of new_value, with one arrival time.

    changes: instrument_id, channel, old_value, new_value, event_time, arrival_time, measurement_id.
    """
    both = F.array(F.struct(F.lit(-1).alias("sign"), F.col("old_value").alias("value")), F.struct(F.lit(1).alias("sign"), F.col("new_value").alias("value")))
    long = changes.withColumn("entry", F.explode(both)).withColumns({"value": F.col("entry.value"), "sign": F.col("entry.sign")}).drop("entry")
    binned = assign_bins(long, schemas, scope=scope if scope is not None else ["instrument_id"]).where(F.col("bin").isNotNull())
    out = binned.withColumns({"event_hour": event_hour(F.col("event_time")), "delta": F.col("sign").cast("bigint"), "entry_type": F.lit("correction")})
    return out.withColumn("event_date", F.to_date("event_hour")).select(*COLUMNS)


def write_fact(fact: DataFrame, path: str, mode: str = "append") -> None:
    fact.write.mode(mode).partitionBy("event_date").parquet(path)


def _literal(x) -> Column:
    return F.lit(x).cast("timestamp_ntz") if isinstance(x, datetime) else x if isinstance(x, Column) else F.lit(x)


def select(fact: DataFrame, *, instrument_id=None, channel=None, hour=None, schema_id=None, guard: bool = False) -> DataFrame:
    """Rows of one instrument, channel, hour and schema; each is optional.

    A filter on the hour also filters the partition column.  With `guard` and no schema_id,
    more than one schema among the rows raises when the result is computed: the test is
    made before any filter on the arrival time.
    """
    out = fact
    for name, x in (("instrument_id", instrument_id), ("channel", channel), ("schema_id", schema_id)):
        if x is not None:
            out = out.where(F.col(name) == _literal(x))
    if hour is not None:
        out = out.where((F.col("event_hour") == _literal(hour)) & (F.col("event_date") == F.to_date(_literal(hour))))
    if guard and schema_id is None:
        ids = out.agg(F.min("schema_id").alias("lo"), F.max("schema_id").alias("hi"))
        ok = ids.select(F.when(F.col("lo").eqNullSafe(F.col("hi")), F.lit(True)).otherwise(F.raise_error(F.lit("several bin schemas; name one"))).alias("ok"))
        out = out.join(F.broadcast(ok), F.col("ok"), "inner").drop("ok")  # one row
    return out


def net_counts(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Sum of deltas per key as cnt; zero nets are left out, negative ones stay."""
    return rows.groupBy(*(keys or KEYS)).agg(F.sum("delta").alias("cnt")).where("cnt <> 0")


def as_of(fact: DataFrame, when, keys: list[str] | None = None, **which) -> DataFrame:
    """Net counts of what had arrived by `when`, inclusive."""
    return net_counts(select(fact, **which).where(F.col("arrival_time") <= _literal(when)), keys)


def current(fact: DataFrame, keys: list[str] | None = None, **which) -> DataFrame:
    return net_counts(select(fact, **which), keys)


def powers_as_of(fact: DataFrame, when, keys: list[str], **which) -> DataFrame:
    """Power sums of what had arrived by `when`; retractions subtract.  `when` None takes all."""
    rows = select(fact, **which)
    if when is not None:
        rows = rows.where(F.col("arrival_time") <= _literal(when))
    return rows.groupBy(*keys).agg(*power_sums("value", F.col("delta")))


#: Standard horizons after the start of the event hour; None takes everything.
HORIZONS = {"1h": "INTERVAL 1 HOUR", "24h": "INTERVAL 24 HOURS", "7d": "INTERVAL 7 DAYS", "final": None}


def at_horizon(fact: DataFrame, interval: str | None, keys: list[str] | None = None, **which) -> DataFrame:
    """Net counts of what arrived up to the start of the event hour plus an interval."""
    rows = select(fact, **which)
    if interval:
        rows = rows.where(F.col("arrival_time") <= F.col("event_hour") + F.expr(interval))
    return net_counts(rows, keys)


def horizon_table(fact: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Net counts at all HORIZONS in one pass, a column each; bins that are zero at all of them are left out."""
    by = lambda i: F.sum("delta") if i is None else F.coalesce(F.sum(F.when(F.col("arrival_time") <= F.col("event_hour") + F.expr(i), F.col("delta"))), F.lit(0))
    out = fact.groupBy(*(keys or KEYS)).agg(*[by(i).alias(f"cnt_{name}") for name, i in HORIZONS.items()])
    some = F.lit(False)
    for name in HORIZONS:
        some = some | (F.col(f"cnt_{name}") != 0)
    return out.where(some)


def changes_between(fact: DataFrame, after, until, **which) -> DataFrame:
    """Rows that arrived in (after, until], in order of arrival."""
    return select(fact, **which).where((F.col("arrival_time") > _literal(after)) & (F.col("arrival_time") <= _literal(until))).orderBy("arrival_time")


def then_and_now(fact: DataFrame, then, now, keys: list[str] | None = None) -> DataFrame:
    """Net counts at two times side by side where they differ, in one pass."""
    by = lambda t: F.coalesce(F.sum(F.when(F.col("arrival_time") <= _literal(t), F.col("delta"))), F.lit(0))
    return fact.groupBy(*(keys or KEYS)).agg(by(then).alias("cnt_then"), by(now).alias("cnt_now")).where("cnt_then <> cnt_now")


def lateness(fact: DataFrame) -> DataFrame:
    """fact with seconds from the start of the event hour to arrival."""
    return fact.withColumn("late_s", F.timestamp_diff("SECOND", F.col("event_hour"), F.col("arrival_time")))


def event_hours(fact: DataFrame, **which) -> DataFrame:
    return select(fact, **which).select("event_hour").distinct().orderBy("event_hour")
