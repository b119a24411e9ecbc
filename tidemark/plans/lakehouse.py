"""The layered tables: readings and truth, the fact, and what is derived from it.

bronze_readings and ground_truth hold what came in; increment_fact is the bitemporal fact;
histogram, fingerprints, bin_schema and drift are derived; histogram_current serves point
reads.  Tables are Parquet, the fact is partitioned by date, and every derived table can
be dropped and built again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import binning
from ..operators import drift, fact as facts, serving
from ..operators.fingerprint import fingerprints

TABLES = ["bronze_readings", "ground_truth", "increment_fact", "bin_schema", "bin_schema_edges", "histogram", "fingerprints", "drift", "histogram_current"]


def _save(df: DataFrame, name: str, *partition: str) -> None:
    writer = df.write.mode("overwrite").format("parquet")
    (writer.partitionBy(*partition) if partition else writer).saveAsTable(name)


def reset(spark: SparkSession, database: str) -> None:
    """Drop all tables of the layers."""
    for t in TABLES:
        spark.sql(f"DROP TABLE IF EXISTS {database}.{t}")


def land(readings: DataFrame, database: str, truth: DataFrame | None = None) -> None:
    """Readings (and the truth of simulated faults, for scoring only) as they came."""
    readings.sparkSession.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    _save(readings, f"{database}.bronze_readings")
    if truth is not None:
        _save(truth, f"{database}.ground_truth")


def build(spark: SparkSession, database: str, calibration: Column, *, bins: int | None = 48, keys: tuple[str, ...] = ("instrument_id", "channel"), k: float = drift.MULTIPLE) -> None:
    """Everything that derives from bronze_readings.

    `calibration` is a condition on the column `day`: schemas, references and thresholds
    are fitted on the days for which it holds, never on the truth.
    """
    name = lambda t: f"{database}.{t}"
    readings = spark.table(name("bronze_readings")).withColumn("day", F.to_date("event_time"))
    scope = list(keys)
    fitted = binning.fit_schemas(readings.where(calibration), scope=scope, bins=bins)
    _save(fitted, name("bin_schema"))
    fitted = spark.table(name("bin_schema"))
    _save(binning.schema_edges(fitted), name("bin_schema_edges"))
    _save(facts.increments(readings, fitted, scope=scope), name("increment_fact"), "event_date")
    fact = spark.table(name("increment_fact"))
    hourly = facts.net_counts(fact)
    _save(hourly, name("histogram"))
    _save(fingerprints(fact, fitted, [*scope, "event_hour"]), name("fingerprints"))
    daily = facts.net_counts(fact.withColumn("day", F.col("event_date")), [*scope, "schema_id", "day", "bin"])
    _save(drift.detect(daily, fitted, calibration, instrument=scope, window=["day"], k=k), name("drift"))
    _save(serving.net(fact), name("histogram_current"))


def consistent(spark: SparkSession, database: str) -> bool:
    """Whether the serving table equals a rebuild from the fact."""
    rebuilt = serving.net(spark.table(f"{database}.increment_fact"))
    return serving.difference(spark.table(f"{database}.histogram_current"), rebuilt).isEmpty()
