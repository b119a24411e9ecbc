"""The current-state histogram: additive batches, compaction and rebuild.

Counts add up, so a batch is written as its own partition of net deltas and the state is
their sum.  A batch that comes again overwrites its partition, so replays change nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.binning import schema_edges

KEYS = ["instrument_id", "channel", "schema_id", "bin"]
_SCHEMA = "instrument_id string, channel string, schema_id string, bin int, cnt bigint, batch_id string"


def net(fact: DataFrame) -> DataFrame:
    """State of a set of increments: net counts, zeros left out."""
    return fact.groupBy(*KEYS).agg(F.sum("delta").alias("cnt")).where("cnt <> 0")


def merge(*states: DataFrame) -> DataFrame:
    """States or net deltas (KEYS, cnt) added up; zeros are left out."""
    out = states[0].select(*KEYS, "cnt")
    for s in states[1:]:
        out = out.unionByName(s.select(*KEYS, "cnt"))
    return out.groupBy(*KEYS).agg(F.sum("cnt").alias("cnt")).where("cnt <> 0")


def apply_batch(path: str, batch_id: str, fact_rows: DataFrame) -> None:
    """Write one batch's net deltas; the same batch id again replaces them."""
    rows = net(fact_rows).withColumn("batch_id", F.lit(str(batch_id)))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)


def current_state(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_SCHEMA).parquet(path).groupBy(*KEYS).agg(F.sum("cnt").alias("cnt")).where("cnt <> 0")


def compact(spark: SparkSession, path: str, to: str) -> None:
    """The same state as one batch in a new folder."""
    current_state(spark, path).withColumn("batch_id", F.lit(f"compact-{uuid.uuid4().hex}")).write.mode("overwrite").partitionBy("batch_id").parquet(to)


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one of two states has, with the side; none if they are equal."""
    left, right = a.select(*KEYS, "cnt"), b.select(*KEYS, "cnt")
    return left.exceptAll(right).withColumn("side", F.lit("a")).union(right.exceptAll(left).withColumn("side", F.lit("b")))


def distribution(state: DataFrame, instrument_id: str, schema_id: str) -> DataFrame:
    """Point read of one instrument's histogram."""
    return state.where((F.col("instrument_id") == instrument_id) & (F.col("schema_id") == schema_id)).select("bin", "cnt").orderBy("bin")


def histogram_plot(histogram: DataFrame, schemas: DataFrame, keys: list[str]) -> DataFrame:
    """Every bin of every window with its edges, midpoint and count, zeros filled in."""
    edges = schema_edges(schemas)
    grid = histogram.select(*keys, "schema_id").distinct().join(edges, "schema_id")
    return grid.join(histogram.select(*keys, "schema_id", "bin", "cnt"), [*keys, "schema_id", "bin"], "left").withColumn("cnt", F.coalesce("cnt", F.lit(0).cast("bigint")))


def register_views(fact: DataFrame, schemas: DataFrame) -> None:
    """Temporary views increment_fact, bin_schema, histogram and histogram_plot for SQL."""
    fact.createOrReplaceTempView("increment_fact")
    schema_edges(schemas).createOrReplaceTempView("bin_schema")
    keys = ["instrument_id", "channel", "event_hour"]
    histogram = fact.groupBy(*keys, "schema_id", "bin").agg(F.sum("delta").alias("cnt")).where("cnt <> 0")
    histogram.createOrReplaceTempView("histogram")
    histogram_plot(histogram, schemas, keys).createOrReplaceTempView("histogram_plot")
