"""The driver's event table as instrument readings, and the same in SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.binning import fit_schemas, frozen
from ..operators import fact as facts

BINS = 16
#: Calibration: days before this one.
CUT = datetime(2024, 1, 21)
AS_OF = datetime(2024, 1, 15, 12)
LATER = datetime(2024, 1, 17)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_type is the instrument; arrival is ts + id % 60 seconds, and 36 hours more for every fifth."""
    late = F.when(F.col("event_id") % 5 == 0, F.expr("INTERVAL 36 HOURS")).otherwise(F.expr("INTERVAL 0 HOURS"))
    ts = F.col("ts").cast("timestamp_ntz")
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("event_type").alias("instrument_id"),
        F.lit("value").alias("channel"),
        "value",
        ts.alias("event_time"),
        (ts + F.make_dt_interval(secs=(F.col("event_id") % 60).cast("decimal(18,6)")) + late).alias("arrival_time"),
        F.col("event_id").cast("string").alias("measurement_id"),
    )


def schemas(rows: DataFrame, bins: int = BINS) -> DataFrame:
    return frozen(fit_schemas(rows, scope=["instrument_id"], bins=bins))


def changes(rows: DataFrame) -> DataFrame:
    """Every 97th reading is corrected by a tenth, three days later."""
    return rows.where(F.col("event_id") % 97 == 0).select(
        "instrument_id", "channel", F.col("value").alias("old_value"), (F.col("value") * 1.1).alias("new_value"), "event_time", (F.col("event_time") + F.expr("INTERVAL 3 DAYS")).alias("arrival_time"), "measurement_id"
    )


def full_fact(rows: DataFrame, fitted: DataFrame) -> DataFrame:
    return facts.increments(rows, fitted).unionByName(facts.corrections(changes(rows), fitted))


def setting(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(readings, schemas, fact)"""
    rows = readings(spark, sf_dir)
    fitted = schemas(rows)
    return rows, fitted, full_fact(rows, fitted)


_BIN = "CASE WHEN {v} < edges[1] THEN 0 WHEN {v} > edges[len(edges)] THEN len(edges) ELSE least(len(list_filter(edges, lambda e: e <= {v})), len(edges) - 1) END"


def _fit(name: str, source: str, bins: int) -> str:
    fractions = ", ".join(repr(i / bins) for i in range(bins + 1))
    return f"{name} AS (SELECT instrument_id, list_sort(list_distinct(list_transform(quantile_cont(value, [{fractions}]), lambda e: round(e, 9)))) AS edges FROM {source} GROUP BY instrument_id)"


#: Common table expressions, each after those it names.
CTES = {
    "readings": "readings AS (SELECT event_id, event_type AS instrument_id, 'value' AS channel, value, ts AS event_time, ts + to_seconds(event_id % 60) + CASE WHEN event_id % 5 = 0 THEN INTERVAL 36 HOUR ELSE INTERVAL 0 HOUR END AS arrival_time, CAST(event_id AS VARCHAR) AS measurement_id FROM events)",
    "fit": _fit("fit", "readings", BINS),
    "ids": "ids AS (SELECT instrument_id, edges, 'bm_' || substr(sha256(instrument_id || '|value|||' || array_to_string(list_transform(edges, lambda e: printf('%.6f', e)), ',')), 1, 12) AS schema_id FROM fit)",
    "long": "long AS (SELECT instrument_id, measurement_id, event_time, arrival_time, value, 1 AS delta, 'measurement' AS entry_type FROM readings UNION ALL SELECT instrument_id, measurement_id, event_time, event_time + INTERVAL 3 DAY, value, -1, 'correction' FROM readings WHERE event_id % 97 = 0 UNION ALL SELECT instrument_id, measurement_id, event_time, event_time + INTERVAL 3 DAY, value * 1.1, 1, 'correction' FROM readings WHERE event_id % 97 = 0)",
    "fact": f"fact AS (SELECT l.*, CAST(date_trunc('hour', event_time) AS TIMESTAMP) AS event_hour, CAST(event_time AS DATE) AS day, schema_id, edges, CAST({_BIN.format(v='value')} AS INTEGER) AS bin FROM long l JOIN ids USING (instrument_id))",
    "bins": "bins AS (SELECT instrument_id, schema_id, unnest(generate_series(1, len(edges) - 1)) AS bin, edges FROM ids)",
    "axis": "axis AS (SELECT instrument_id, schema_id, bin, edges[bin] AS lo, edges[bin + 1] AS hi, len(edges) - 1 AS k FROM bins)",
    "daily": "daily AS (SELECT instrument_id, day, bin, CAST(sum(delta) AS BIGINT) AS cnt FROM fact GROUP BY ALL HAVING sum(delta) <> 0)",
    "days": "days AS (SELECT DISTINCT instrument_id, day FROM daily)",
    "dense": "dense AS (SELECT d.instrument_id, d.day, a.bin, a.lo, a.hi, a.k, CAST(coalesce(c.cnt, 0) AS DOUBLE) AS c FROM days d JOIN axis a USING (instrument_id) LEFT JOIN daily c ON c.instrument_id = d.instrument_id AND c.day = d.day AND c.bin = a.bin)",
    "outer_": "outer_ AS (SELECT instrument_id, day, CAST(sum(CASE WHEN bin = 0 THEN cnt ELSE 0 END) AS DOUBLE) AS under, CAST(sum(cnt) AS DOUBLE) AS mass FROM daily GROUP BY ALL)",
    "cum": "cum AS (SELECT d.*, under, mass, under + sum(c) OVER (PARTITION BY d.instrument_id, d.day ORDER BY bin) AS upto FROM dense d JOIN outer_ o ON o.instrument_id = d.instrument_id AND o.day = d.day)",
    "ref": "ref AS (SELECT instrument_id, bin, CAST(sum(cnt) AS BIGINT) AS cnt FROM daily WHERE day < DATE '2024-01-21' GROUP BY ALL)",
    "gaps": "gaps AS (SELECT d.instrument_id, d.day, d.bin, d.hi - d.lo AS w, c / sum(c) OVER w AS p, coalesce(r.cnt, 0) / sum(coalesce(r.cnt, 0)) OVER w AS q, sum(c) OVER w AS inside FROM dense d LEFT JOIN ref r ON r.instrument_id = d.instrument_id AND r.bin = d.bin WINDOW w AS (PARTITION BY d.instrument_id, d.day))",
    "steps": "steps AS (SELECT *, sum(p - q) OVER (PARTITION BY instrument_id, day ORDER BY bin) AS d1, sum(p - q) OVER (PARTITION BY instrument_id, day ORDER BY bin) - (p - q) AS d0 FROM gaps)",
    "w1": "w1 AS (SELECT instrument_id, day, sum(CASE WHEN d0 * d1 >= 0 THEN w * (abs(d0) + abs(d1)) / 2 ELSE w * (d0 * d0 + d1 * d1) / (2 * (abs(d0) + abs(d1))) END) AS distance FROM steps GROUP BY ALL)",
    "middle": "middle AS (SELECT instrument_id, median(distance) AS m, max(distance) AS most FROM w1 WHERE day < DATE '2024-01-21' GROUP BY ALL)",
    "limits": "limits AS (SELECT instrument_id, CASE WHEN median(abs(distance - m)) > 0 THEN any_value(m) + 8 * 1.4826 * median(abs(distance - m)) ELSE 1.5 * any_value(most) END AS threshold FROM w1 JOIN middle USING (instrument_id) WHERE day < DATE '2024-01-21' GROUP BY ALL)",
}


def sql(upto: str, body: str, *more: str) -> str:
    """A query with the common table expressions up to `upto` and further ones."""
    names = list(CTES)
    return "WITH " + ",\n".join([CTES[n] for n in names[: names.index(upto) + 1]] + list(more)) + "\n" + body


def fit_cte(name: str, source: str, bins: int) -> str:
    return _fit(name, source, bins)


def bin_sql(value: str) -> str:
    return _BIN.format(v=value)
