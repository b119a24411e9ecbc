"""Small Spark helpers shared by the corpus operators."""

from __future__ import annotations

import re
import tempfile
import uuid
import zlib
from collections.abc import Callable
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a temporary one only if none is set and all run in this process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        at = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = at.get() if at.isDefined() else None
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """The session's settings for the jobs started inside; the caller's come back after."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def arrow_rows(spark: SparkSession, rows: int):
    """Jobs started inside hand Python at most `rows` rows at a time, which bounds memory."""
    return settings(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows)})


def bound_batches(spark: SparkSession, rows: int = 1000) -> None:
    """From now on the session hands Python at most `rows` rows at a time.

    For frames that a caller computes later.  Spark also bounds a batch's bytes
    (spark.sql.execution.arrow.maxBytesPerBatch), but far above what a worker needs.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))


#: Partitions after a shuffle get the advised size, so small tables are a few files.
_SIZED = {"spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}
#: A local file system that writes no checksum files: these cost processes for each file.
_PLAIN_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def materialise(df: DataFrame, name: str, compression: str = "snappy", batch_rows: int = 1000) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back.

    It cuts the lineage and survives the loss of any executor.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark-{name}-{uuid.uuid4().hex}"
    with arrow_rows(spark, batch_rows), settings(spark, _SIZED):
        writer = df.write.mode("overwrite").option("compression", compression)
        (writer.options(**_PLAIN_FILES) if path.startswith("file:") else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidemark_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete materialised tables that nothing will read again."""
    for df in tables:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._tidemark_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def held_out(doc_id: Column, mod: int) -> Column:
    """True for rows that no model may learn from: crc32 of the id as text, mod `mod`, is 1.

    A null id is held out too.
    """
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % mod == 1, F.lit(True))


def keyed(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """Only (doc_id, text) and `more`, so other columns' names cannot clash."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), *more)


def summed(df: DataFrame, count: Callable, size: int, kind: type = np.int64, batch_rows: int = 500) -> np.ndarray:
    """The sum over all tasks of the array that count(batches) returns; its size is fixed.

    Each task sends its array in slices, a slice's sum is one row, and the driver gets
    size * 8 bytes in all.
    """
    width = -(-size // min(64, size))

    def part(batches):
        total = count(batches)
        for k in range(0, size, width):
            if total[k : k + width].any():
                yield pa.RecordBatch.from_pydict({"k": pa.array([k], pa.int32()), "data": pa.array([zlib.compress(np.ascontiguousarray(total[k : k + width], dtype=kind).tobytes(), 1)], pa.binary())})

    def add(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(zlib.decompress(x.as_py()), dtype=kind) for x in group["data"])
        return pa.table({"k": pa.array([group["k"][0].as_py()], pa.int32()), "data": pa.array([total.tobytes()], pa.binary())})

    out = np.zeros(size, dtype=kind)
    with arrow_rows(df.sparkSession, batch_rows):
        rows = df.mapInArrow(part, "k int, data binary").groupBy("k").applyInArrow(add, "k int, data binary").collect()
    for r in rows:
        got = np.frombuffer(r["data"], dtype=kind)
        out[r["k"] : r["k"] + len(got)] = got
    return out
