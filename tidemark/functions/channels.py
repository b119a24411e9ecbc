"""Scalar channels from measurements: decomposition, validation, band labels, time keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ["linear", "circular"]


def magnitude(vector: Column) -> Column:
    """Euclidean length; a one-element vector is a scalar and keeps its value."""
    length = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.when(F.size(vector) == 1, F.get(vector, F.lit(0)).cast("double")).otherwise(length)


def direction(vector: Column) -> Column:
    """Unit vector; null for scalars and for the zero vector."""
    norm = magnitude(vector)
    return F.when((F.size(vector) > 1) & (norm > 0), F.transform(vector, lambda x: x.cast("double") / F.when(norm > 0, norm)))


def decompose(df: DataFrame, vector: str, rank: Column | int) -> DataFrame:
    """df with magnitude and direction; rank 2 and above raises when computed."""
    rank = F.lit(rank) if isinstance(rank, int) else rank
    checked = F.when(rank <= 1, F.col(vector)).otherwise(F.raise_error(F.lit("channels of rank 2 or more have no decomposition")))
    return df.withColumns({"magnitude": magnitude(checked), "direction": direction(checked)})


def channel_problem(name: Column, rank: Column, kind: Column) -> Column:
    """Why a channel is invalid, or null."""
    return F.when(name.isNull() | (name == ""), "no name").when(~rank.between(0, 2) | rank.isNull(), "rank is not 0, 1 or 2").when(~kind.isin(KINDS) | kind.isNull(), "unknown kind")


def measurement_problem(instrument: Column, values: Column) -> Column:
    """Why a measurement is invalid, or null."""
    return F.when(instrument.isNull() | (instrument == ""), "no instrument").when(values.isNull() | (F.size(values) == 0), "no values")


def split_valid(df: DataFrame, problem: Column) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows with a column `problem`)."""
    marked = df.withColumn("problem", problem)
    return marked.where("problem IS NULL").drop("problem"), marked.where("problem IS NOT NULL")


def event_hour(ts: Column) -> Column:
    """Start of the wall-clock hour, without a time zone."""
    return F.date_trunc("hour", ts).cast("timestamp_ntz")


def hour_range(ts: Column, hour: Column) -> Column:
    """ts lies in the hour, as a range on ts itself, so that it reaches the scan."""
    return (ts >= hour) & (ts < hour + F.expr("INTERVAL 1 HOUR"))


def band_index(value: Column, boundaries: list[float]) -> Column:
    """How many boundaries are <= value; a boundary belongs to the upper band."""
    if list(boundaries) != sorted(boundaries):
        raise ValueError("boundaries must ascend")
    out = F.lit(0)
    for b in boundaries:
        out = out + (value >= F.lit(b)).cast("int")
    return out


def band_label(value: Column, boundaries: list[float], labels: list[str]) -> Column:
    if len(labels) != len(boundaries) + 1:
        raise ValueError("there must be one label more than boundaries")
    return F.get(F.array(*[F.lit(x) for x in labels]), band_index(value, boundaries))


#: Severity scheme: labels in order.  Fixed values.
SEVERITY = ["Nominal", "Elevated", "Warning", "Critical"]


def finite_widths(widths: str, over) -> Column:
    """Widths with non-finite ones replaced by the median of the finite ones in the window."""
    finite = F.when(F.abs(widths) != float("inf"), F.col(widths))
    return F.coalesce(finite, F.median(finite).over(over))
