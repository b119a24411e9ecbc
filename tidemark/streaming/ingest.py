"""Streaming ingest: JSON payloads to the fact and the serving state, exactly once.

Late readings are never dropped, so no watermark is set on the event time.  Each
micro-batch is deduplicated by payload hash within itself and against the stored fact,
then written under its batch id; a batch that is replayed overwrites what it wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.fact import COLUMNS, increments
from ..operators.serving import apply_batch
from ..sources.contract import parse

_FACT = "instrument_id string, channel string, schema_id string, bin int, event_hour timestamp_ntz, arrival_time timestamp_ntz, delta bigint, value double, entry_type string, measurement_id string, payload_hash string, event_date date, batch_id bigint"


def stored_fact(spark: SparkSession, path: str) -> DataFrame:
    """The fact that streams have written; empty before the first batch."""
    names = StructType.fromDDL(_FACT)
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], names)
    return spark.read.schema(names).parquet(path)


def write_batch(batch: DataFrame, batch_id: int, schemas: DataFrame, fact_path: str, serving_path: str | None = None) -> None:
    """One micro-batch of payloads; idempotent for its batch id."""
    spark = batch.sparkSession
    readings, _ = parse(batch)
    first = readings.dropDuplicates(["payload_hash", "instrument_id", "measurement_id", "channel"])
    before = stored_fact(spark, fact_path).where(F.col("batch_id") != batch_id)
    # the dates of the batch bound what is read of the stored fact
    dates = [r[0] for r in first.select(F.to_date("event_time")).distinct().collect()]
    seen = before.where(F.col("event_date").isin(dates)).select("payload_hash").distinct()
    fresh = first.join(seen, "payload_hash", "left_anti")
    hashed = increments(fresh.withColumn("measurement_id", F.struct("measurement_id", "payload_hash")), schemas)
    rows = hashed.select(*[c for c in COLUMNS if c not in ("measurement_id", "event_date")], F.col("measurement_id.measurement_id").alias("measurement_id"), F.col("measurement_id.payload_hash").alias("payload_hash"), "event_date", F.lit(batch_id).cast("bigint").alias("batch_id"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("event_date", "batch_id").parquet(fact_path)
    if serving_path:
        apply_batch(serving_path, str(batch_id), stored_fact(spark, fact_path).where(F.col("batch_id") == batch_id))


def ingest(spark: SparkSession, source_path: str, schemas: DataFrame, fact_path: str, checkpoint: str, serving_path: str | None = None, **trigger) -> StreamingQuery:
    """Start a stream of text files, a payload per line, into the fact (and serving state)."""
    lines = spark.readStream.format("text").load(source_path).withColumnRenamed("value", "payload")
    write = lines.writeStream.foreachBatch(lambda batch, i: write_batch(batch, i, schemas, fact_path, serving_path))
    return write.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
