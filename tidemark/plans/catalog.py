"""Registered queries over the driver's tables, with equivalent SQL."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import binning, channels, moments, shape
from ..functions.storage import shared_folder, stored
from ..operators import drift, fact as facts, serving
from ..operators.bands import BandScheme
from ..operators.fingerprint import fingerprints
from ..sources import contract, simulator
from ..sources.config import load, registered
from . import mapping as m

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def text(c: str | Column) -> Column:
    """A time as text, the same in both engines."""
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


TEXT = "strftime({}, '%Y-%m-%d %H:%M:%S')"
HOUR, ARRIVAL = TEXT.format("event_hour") + " AS event_hour", TEXT.format("arrival_time") + " AS arrival_time"


#: Added before rounding: sums in another order differ in the last bits, and a value that
#: lies between two roundings would then go either way.
NUDGE = 1e-8


def near(c: Column, n: int) -> Column:
    return F.round(c + F.lit(NUDGE), n)


def rounded(n: int, *names: str) -> list[Column]:
    return [near(F.col(c), n).alias(c) for c in names]


def rounded_sql(n: int, *names: str) -> str:
    return ", ".join(f"round({c} + {NUDGE!r}, {n}) AS {c}" for c in names)


def _daily(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(net counts per instrument and day, schemas)"""
    _, fitted, fact = m.setting(spark, sf_dir)
    return facts.net_counts(fact.withColumn("day", F.col("event_date")), ["instrument_id", "schema_id", "day", "bin"]), fitted


# bins and schemas


@query(m.sql("fit", "SELECT instrument_id, CAST(i AS INTEGER) AS i, edges[i + 1] AS edge FROM (SELECT instrument_id, edges, unnest(generate_series(0, len(edges) - 1)) AS i FROM fit)"))
def fit_edges(spark, sf_dir):
    return m.schemas(m.readings(spark, sf_dir)).select("instrument_id", F.posexplode("edges").alias("i", "edge"))


@query("SELECT user_id, count(*) AS n, CAST(greatest(8, least(256, count(*) // 20)) AS INTEGER) AS bins FROM events GROUP BY user_id")
def recommend_bins(spark, sf_dir):
    n = m.table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return n.withColumn("bins", binning.recommended_bins(F.col("n")))


@query(m.sql("ids", "SELECT instrument_id, schema_id FROM ids"))
def schema_id(spark, sf_dir):
    return m.schemas(m.readings(spark, sf_dir)).select("instrument_id", "schema_id")


@query(m.sql("fit", "SELECT event_id, round((value - edges[1]) / (edges[len(edges)] - edges[1]), 9) AS position FROM readings JOIN fit USING (instrument_id)"))
def normalize(spark, sf_dir):
    rows = m.readings(spark, sf_dir)
    joined = rows.join(m.schemas(rows), "instrument_id")
    return joined.select("event_id", F.round(binning.normalised(F.col("value"), F.col("edges")), 9).alias("position"))


@query(m.sql("fit", f"SELECT event_id, CAST({m.bin_sql('value')} AS INTEGER) AS bin FROM readings JOIN fit USING (instrument_id)"))
def bin_assign(spark, sf_dir):
    rows = m.readings(spark, sf_dir)
    return binning.assign_bins(rows, m.schemas(rows), scope=["instrument_id"]).select("event_id", "bin")


@query(m.sql("fit", f"SELECT event_id, CAST({m.bin_sql('value')} AS INTEGER) AS bin FROM readings JOIN fit USING (instrument_id)"))
def bin_assign_joined(spark, sf_dir):
    """The same through a join, as for schemas too many for a literal tree."""
    rows = m.readings(spark, sf_dir)
    joined = rows.join(m.schemas(rows), "instrument_id")
    return joined.select("event_id", binning.bin_in(F.col("value"), F.col("edges")).alias("bin"))


_PRICE = ", ".join(repr(i / 48) for i in range(49))


@query(f"WITH fit AS (SELECT l_returnflag, list_sort(list_distinct(list_transform(quantile_cont(l_extendedprice, [{_PRICE}]), lambda e: round(e, 9)))) AS edges FROM lineitem GROUP BY 1) SELECT l_returnflag, CAST({m.bin_sql('l_extendedprice')} AS INTEGER) AS bin, count(*) AS cnt FROM lineitem JOIN fit USING (l_returnflag) GROUP BY ALL")
def lineitem_histogram(spark, sf_dir):
    rows = m.table(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice")
    fitted = binning.fit_schemas(rows, scope=["l_returnflag"], value="l_extendedprice", channel="price", bins=48)
    return binning.assign_bins(rows, fitted, scope=["l_returnflag"], value="l_extendedprice").groupBy("l_returnflag", "bin").agg(F.count("*").alias("cnt"))


@query(m.sql("fact", f"SELECT instrument_id, {HOUR}, bin, CAST(sum(delta) AS BIGINT) AS cnt FROM fact GROUP BY instrument_id, fact.event_hour, bin HAVING sum(delta) <> 0"))
def hourly_histogram(spark, sf_dir):
    _, _, fact = m.setting(spark, sf_dir)
    return facts.net_counts(fact, ["instrument_id", "event_hour", "bin"]).withColumn("event_hour", text("event_hour"))


@query(m.sql("readings", f"SELECT instrument_id, count(*) FILTER (b = 0) AS n_under, count(*) FILTER (b > len(edges) - 1) AS n_over FROM (SELECT *, {m.bin_sql('value')} AS b FROM readings JOIN fit USING (instrument_id) WHERE event_time >= TIMESTAMP '2024-01-21') GROUP BY instrument_id", "early AS (SELECT * FROM readings WHERE event_time < TIMESTAMP '2024-01-21')", m.fit_cte("fit", "early", m.BINS)))
def novelty_counts(spark, sf_dir):
    rows = m.readings(spark, sf_dir)
    cut = F.lit(m.CUT).cast("timestamp_ntz")
    fitted = m.schemas(rows.where(F.col("event_time") < cut))
    late = binning.assign_bins(rows.where(F.col("event_time") >= cut), fitted, scope=["instrument_id"]).join(fitted.select("instrument_id", F.size("edges").alias("top")), "instrument_id")
    return late.groupBy("instrument_id").agg(F.count(F.when(F.col("bin") == 0, 1)).alias("n_under"), F.count(F.when(F.col("bin") == F.col("top"), 1)).alias("n_over"))


# moments and shape

_POWERS = "CAST(sum(delta) AS DOUBLE) AS n, sum(delta * value) AS s1, sum(delta * pow(value, 2)) AS s2, sum(delta * pow(value, 3)) AS s3, sum(delta * pow(value, 4)) AS s4"
_SCALED = "n, round(s1 / 1e3, 6) AS s1, round(s2 / 1e6, 6) AS s2, round(s3 / 1e9, 6) AS s3, round(s4 / 1e12, 6) AS s4"


def _scaled(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, "n", *[F.round(F.col(f"s{k}") / 10.0 ** (3 * k), 6).alias(f"s{k}") for k in (1, 2, 3, 4)])


@query(m.sql("readings", f"SELECT instrument_id, {_SCALED} FROM (SELECT instrument_id, {_POWERS.replace('delta', '1')} FROM readings GROUP BY 1)"))
def power_sums(spark, sf_dir):
    return _scaled(m.readings(spark, sf_dir).groupBy("instrument_id").agg(*moments.power_sums()), "instrument_id")


@query(ORACLE_SQL["power_sums"])
def power_sums_merge(spark, sf_dir):
    daily = m.readings(spark, sf_dir).groupBy("instrument_id", F.to_date("event_time").alias("day")).agg(*moments.power_sums())
    return _scaled(daily.groupBy("instrument_id").agg(*moments.merged()), "instrument_id")


_MOMENTS = """mom AS (SELECT *, s1 / n AS mean, greatest(0, s2 / n - pow(s1 / n, 2)) AS variance, s3 / n - 3 * (s1 / n) * (s2 / n) + 2 * pow(s1 / n, 3) AS m3, s4 / n - 4 * (s1 / n) * (s3 / n) + 6 * pow(s1 / n, 2) * (s2 / n) - 3 * pow(s1 / n, 4) AS m4 FROM sums),
done AS (SELECT *, sqrt(variance) AS std, CASE WHEN variance > 0 THEN m3 / pow(variance, 1.5) ELSE 0 END AS skewness, CASE WHEN variance > 0 THEN m4 / (variance * variance) - 3 ELSE 0 END AS kurtosis_excess FROM mom)"""
_OUT = f"{rounded_sql(5, 'mean', 'variance', 'std')}, {rounded_sql(4, 'skewness', 'kurtosis_excess')}"


def _moments(sums: DataFrame, *keys: str) -> DataFrame:
    return sums.select(*keys, *moments.moments()).select(*keys, *rounded(5, "mean", "variance", "std"), *rounded(4, "skewness", "kurtosis_excess"))


@query(m.sql("readings", f"SELECT instrument_id, {_OUT} FROM done", f"sums AS (SELECT instrument_id, {_POWERS.replace('delta', '1')} FROM readings GROUP BY 1)", _MOMENTS))
def moments_by_instrument(spark, sf_dir):
    return _moments(m.readings(spark, sf_dir).groupBy("instrument_id").agg(*moments.power_sums()), "instrument_id")


@query("SELECT event_type AS instrument_id, 5.0 AS mean, 0.0 AS variance, 0.0 AS std, 0.0 AS skewness, 0.0 AS kurtosis_excess FROM events GROUP BY 1".replace("5.0", "CAST(5.0 AS DOUBLE)").replace(" 0.0", " CAST(0.0 AS DOUBLE)"))
def moments_constant_group(spark, sf_dir):
    flat = m.readings(spark, sf_dir).withColumn("value", F.lit(5.0))
    return _moments(flat.groupBy("instrument_id").agg(*moments.power_sums()), "instrument_id")


_P = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}
_PERCENTILES = "perc AS (SELECT instrument_id, day, " + ", ".join(f"CASE WHEN {q} * any_value(mass) <= any_value(under) THEN min(lo) ELSE coalesce(arg_min(lo + ({q} * mass - (upto - c)) / c * (hi - lo), bin) FILTER (c > 0 AND {q} * mass <= upto), max(hi)) END AS {p}" for p, q in _P.items()) + " FROM cum GROUP BY ALL)"


@query(m.sql("cum", f"SELECT instrument_id, CAST(day AS VARCHAR) AS day, {rounded_sql(6, *_P)} FROM perc", _PERCENTILES))
def bin_percentiles(spark, sf_dir):
    daily, fitted = _daily(spark, sf_dir)
    return shape.dense(daily, fitted, ["instrument_id", "day"]).select("instrument_id", F.col("day").cast("string").alias("day"), *[near(shape.percentile(q), 6).alias(p) for p, q in _P.items()])


_ENTROPY = "ent AS (SELECT instrument_id, day, coalesce(-sum(CASE WHEN c > 0 THEN c / t * ln(c / t) END), 0) AS entropy_nats, coalesce(-sum(CASE WHEN c > 0 THEN c / t * ln(c / t) END), 0) / ln(any_value(k)) AS entropy_norm FROM (SELECT *, sum(c) OVER (PARTITION BY instrument_id, day) AS t FROM dense) GROUP BY ALL)"


@query(m.sql("dense", f"SELECT instrument_id, CAST(day AS VARCHAR) AS day, {rounded_sql(6, 'entropy_nats', 'entropy_norm')} FROM ent", _ENTROPY))
def bin_entropy(spark, sf_dir):
    daily, fitted = _daily(spark, sf_dir)
    nats, share = shape.entropy()
    return shape.dense(daily, fitted, ["instrument_id", "day"]).select("instrument_id", F.col("day").cast("string").alias("day"), near(nats, 6).alias("entropy_nats"), near(share, 6).alias("entropy_norm"))


@query(m.sql("cum", f"SELECT instrument_id, CAST(day AS VARCHAR) AS day, n, {_OUT}, {rounded_sql(6, *_P, 'entropy_norm')} FROM done JOIN perc USING (instrument_id, day) JOIN ent USING (instrument_id, day)", f"sums AS (SELECT instrument_id, day, {_POWERS} FROM fact GROUP BY ALL)", _MOMENTS, _PERCENTILES, _ENTROPY))
def fingerprint(spark, sf_dir):
    _, fitted, fact = m.setting(spark, sf_dir)
    found = fingerprints(fact.withColumnRenamed("event_date", "day"), fitted, ["instrument_id", "day"])
    return found.select("instrument_id", F.col("day").cast("string").alias("day"), "n", *rounded(5, "mean", "variance", "std"), *rounded(4, "skewness", "kurtosis_excess"), *rounded(6, *_P, "entropy_norm"))


_NEAR = """fp AS (SELECT instrument_id, day, mean AS x, std AS y FROM done),
r AS (SELECT instrument_id, avg(x) AS mx, avg(y) AS my, avg(x * x) - avg(x) * avg(x) AS xx, avg(x * y) - avg(x) * avg(y) AS xy, avg(y * y) - avg(y) * avg(y) AS yy FROM fp WHERE day < DATE '2024-01-21' GROUP BY instrument_id),
g AS (SELECT fp.instrument_id, day, x - mx AS dx, y - my AS dy, xx, xy, yy FROM fp JOIN r ON r.instrument_id = fp.instrument_id)"""


@query(m.sql("fact", "SELECT instrument_id, CAST(day AS VARCHAR) AS day, round(sqrt(greatest(0, (yy * dx * dx - 2 * xy * dx * dy + xx * dy * dy) / (xx * yy - xy * xy))) + 1e-08, 6) AS mahalanobis FROM g", f"sums AS (SELECT instrument_id, day, {_POWERS} FROM fact GROUP BY ALL)", _MOMENTS, _NEAR))
def mahalanobis(spark, sf_dir):
    """Daily mean and standard deviation against those of the calibration days."""
    sums = m.setting(spark, sf_dir)[2].groupBy("instrument_id", F.col("event_date").alias("day")).agg(*moments.power_sums("value", F.col("delta")))
    found = sums.select("instrument_id", "day", *moments.moments()).select("instrument_id", "day", F.array("mean", "std").alias("vector"))
    scored = drift.mahalanobis(found, F.col("day") < F.lit(m.CUT.date()), 2, instrument=["instrument_id"])
    return scored.select("instrument_id", F.col("day").cast("string").alias("day"), near(F.col("mahalanobis"), 6).alias("mahalanobis"))


# the fact

_ROW = f"instrument_id, measurement_id, schema_id, bin, {HOUR}, {ARRIVAL}, CAST(delta AS BIGINT) AS delta, round(value, 6) AS value, entry_type"


def _rows(df: DataFrame) -> DataFrame:
    return df.select("instrument_id", "measurement_id", "schema_id", "bin", text("event_hour").alias("event_hour"), text("arrival_time").alias("arrival_time"), "delta", F.round("value", 6).alias("value"), "entry_type")


@query(m.sql("fact", f"SELECT {_ROW} FROM fact WHERE entry_type = 'measurement'"))
def fact_ingest(spark, sf_dir):
    rows = m.readings(spark, sf_dir)
    return _rows(facts.increments(rows, m.schemas(rows)))


@query(m.sql("fact", f"SELECT {_ROW} FROM fact WHERE entry_type = 'correction'"))
def fact_correction(spark, sf_dir):
    rows = m.readings(spark, sf_dir)
    return _rows(facts.corrections(m.changes(rows), m.schemas(rows)))


_KEY = ["instrument_id", "schema_id", "bin"]
_NET = "SELECT instrument_id, schema_id, bin, CAST(sum(delta) AS BIGINT) AS cnt FROM fact WHERE {} GROUP BY ALL HAVING sum(delta) <> 0"


@query(m.sql("fact", _NET.format(f"arrival_time <= TIMESTAMP '{m.AS_OF}'")))
def as_of(spark, sf_dir):
    return facts.as_of(m.setting(spark, sf_dir)[2], m.AS_OF, _KEY)


@query(m.sql("fact", _NET.format("true")))
def current(spark, sf_dir):
    return facts.current(m.setting(spark, sf_dir)[2], _KEY)


@query(m.sql("fact", _NET.format("event_hour = TIMESTAMP '2024-01-10 09:00:00'")))
def hour_read(spark, sf_dir):
    return facts.current(m.setting(spark, sf_dir)[2], _KEY, hour=datetime(2024, 1, 10, 9))


@query(m.sql("fact", f"SELECT instrument_id, {_SCALED} FROM (SELECT instrument_id, {_POWERS} FROM fact WHERE arrival_time <= TIMESTAMP '{m.AS_OF}' GROUP BY 1)"))
def power_sums_as_of(spark, sf_dir):
    return _scaled(facts.powers_as_of(m.setting(spark, sf_dir)[2], m.AS_OF, ["instrument_id"]), "instrument_id")


def _horizon(name: str, interval: str | None) -> None:
    def run(spark, sf_dir):
        return facts.at_horizon(m.setting(spark, sf_dir)[2], interval, _KEY)

    run.__name__ = f"horizon_{name}"
    query(m.sql("fact", _NET.format(f"arrival_time <= event_hour + {interval}" if interval else "true")))(run)


for _name, _interval in facts.HORIZONS.items():
    _horizon(_name, _interval)

_AT = ", ".join(f"CAST(coalesce(sum(delta) FILTER ({'true' if i is None else f'arrival_time <= event_hour + {i}'}), 0) AS BIGINT) AS cnt_{n}" for n, i in facts.HORIZONS.items())


@query(m.sql("fact", f"SELECT * FROM (SELECT instrument_id, schema_id, bin, {_AT} FROM fact GROUP BY ALL) WHERE " + " OR ".join(f"cnt_{n} <> 0" for n in facts.HORIZONS)))
def horizon_table(spark, sf_dir):
    return facts.horizon_table(m.setting(spark, sf_dir)[2], _KEY)


@query(m.sql("fact", f"SELECT {_ROW} FROM fact WHERE arrival_time > TIMESTAMP '{m.AS_OF}' AND arrival_time <= TIMESTAMP '{m.LATER}'"))
def changes_between(spark, sf_dir):
    return _rows(facts.changes_between(m.setting(spark, sf_dir)[2], m.AS_OF, m.LATER))


@query(m.sql("fact", f"SELECT * FROM (SELECT instrument_id, schema_id, bin, CAST(coalesce(sum(delta) FILTER (arrival_time <= TIMESTAMP '{m.AS_OF}'), 0) AS BIGINT) AS cnt_then, CAST(coalesce(sum(delta) FILTER (arrival_time <= TIMESTAMP '{m.LATER}'), 0) AS BIGINT) AS cnt_now FROM fact GROUP BY ALL) WHERE cnt_then <> cnt_now"))
def then_vs_now(spark, sf_dir):
    return facts.then_and_now(m.setting(spark, sf_dir)[2], m.AS_OF, m.LATER, _KEY)


@query(m.sql("fact", f"SELECT DISTINCT {HOUR} FROM fact"))
def event_hours(spark, sf_dir):
    return facts.event_hours(m.setting(spark, sf_dir)[2]).select(text("event_hour").alias("event_hour"))


@query(m.sql("fact", "SELECT instrument_id, count(*) AS n_late FROM fact WHERE date_diff('second', event_hour, arrival_time - INTERVAL 0 SECOND) >= 86400 GROUP BY 1"))
def lateness(spark, sf_dir):
    return facts.lateness(m.setting(spark, sf_dir)[2]).where("late_s >= 86400").groupBy("instrument_id").agg(F.count("*").alias("n_late"))


@query(m.sql("fact", _NET.format("instrument_id = 'click'")))
def merge_guard(spark, sf_dir):
    """Guarded read of one instrument, which has one schema; a second one would raise."""
    return facts.current(m.setting(spark, sf_dir)[2], _KEY, instrument_id="click", guard=True)


# drift


@query(m.sql("ref", "SELECT instrument_id, bin, cnt FROM ref"))
def pool_reference(spark, sf_dir):
    daily, _ = _daily(spark, sf_dir)
    return drift.pooled(daily.where(F.col("day") < F.lit(m.CUT.date())), ["instrument_id"]).select("instrument_id", "bin", "cnt")


def _scored(spark, sf_dir, **options) -> DataFrame:
    daily, fitted = _daily(spark, sf_dir)
    reference = drift.pooled(daily.where(F.col("day") < F.lit(m.CUT.date())), ["instrument_id"])
    return drift.distances(daily, reference, fitted, instrument=["instrument_id"], window=["day"], **options)


def _days(df: DataFrame, *cols) -> DataFrame:
    return df.select("instrument_id", F.col("day").cast("string").alias("day"), *cols)


@query(m.sql("w1", "SELECT instrument_id, CAST(day AS VARCHAR) AS day, round(distance + 1e-08, 6) AS distance FROM w1"))
def w1_daily(spark, sf_dir):
    return _days(_scored(spark, sf_dir), *rounded(6, "distance"))


_CROSS = ["late AS (SELECT * FROM readings WHERE event_time >= TIMESTAMP '2024-01-21')", "early AS (SELECT * FROM readings WHERE event_time < TIMESTAMP '2024-01-21')", m.fit_cte("fa", "early", 16), m.fit_cte("fb", "late", 24),
    *[f"h{x} AS (SELECT instrument_id, b AS bin, count(*) AS c FROM (SELECT instrument_id, {m.bin_sql('value')} AS b, edges FROM {s} JOIN f{x} USING (instrument_id)) GROUP BY ALL), a{x} AS (SELECT f.instrument_id, edges[i] AS lo, edges[i + 1] AS hi, coalesce(c, 0) AS c FROM (SELECT instrument_id, edges, unnest(generate_series(1, len(edges) - 1)) AS i FROM f{x}) f LEFT JOIN h{x} h ON h.instrument_id = f.instrument_id AND h.bin = f.i)" for x, s in (("a", "early"), ("b", "late"))],
    "xs AS (SELECT DISTINCT instrument_id, unnest(list_concat(fa.edges, fb.edges)) AS x FROM fa JOIN fb USING (instrument_id))",
    *[f"c{x} AS (SELECT xs.instrument_id, x, sum(c * greatest(0, least(1, (x - lo) / (hi - lo)))) / sum(c) AS f FROM xs JOIN a{x} USING (instrument_id) GROUP BY ALL)" for x in "ab"],
    "ds AS (SELECT instrument_id, x, ca.f - cb.f AS d FROM ca JOIN cb USING (instrument_id, x))",
    "st AS (SELECT instrument_id, abs(d) AS d1, lag(abs(d)) OVER w AS d0, x - lag(x) OVER w AS w FROM ds WINDOW w AS (PARTITION BY instrument_id ORDER BY x))"]


@query(m.sql("readings", "SELECT instrument_id, round(sum((d0 + d1) / 2 * w) + 1e-08, 6) AS distance FROM st WHERE d0 IS NOT NULL GROUP BY 1", *_CROSS))
def w1_cross_schema(spark, sf_dir):
    rows = m.readings(spark, sf_dir)
    cut = F.lit(m.CUT).cast("timestamp_ntz")
    early, late = rows.where(F.col("event_time") < cut), rows.where(F.col("event_time") >= cut)
    a, b = m.schemas(early, 16), m.schemas(late, 24)
    count = lambda r, s: binning.assign_bins(r, s, scope=["instrument_id"]).groupBy("instrument_id", "schema_id", "bin").agg(F.count("*").alias("cnt"))
    found = drift.distances(count(early, a), count(late, b), a.unionByName(b), instrument=["instrument_id"], window=[])
    return found.select("instrument_id", *rounded(6, "distance"))


@query(m.sql("limits", "SELECT instrument_id, round(threshold + 1e-08, 6) AS threshold FROM limits"))
def calibrate_threshold(spark, sf_dir):
    early = _scored(spark, sf_dir).where(F.col("day") < F.lit(m.CUT.date()))
    return drift.thresholds(early, instrument=["instrument_id"]).select("instrument_id", *rounded(6, "threshold"))


@query(m.sql("w1", "SELECT instrument_id, round(quantile_cont(distance, 0.99) + 1e-08, 6) AS threshold FROM w1 WHERE day < DATE '2024-01-21' GROUP BY 1"))
def threshold_p99(spark, sf_dir):
    early = _scored(spark, sf_dir).where(F.col("day") < F.lit(m.CUT.date()))
    return drift.thresholds(early, instrument=["instrument_id"], policy="p99").select("instrument_id", *rounded(6, "threshold"))


@query(m.sql("limits", "SELECT instrument_id, CAST(day AS VARCHAR) AS day, round(distance + 1e-08, 6) AS distance, round(threshold + 1e-08, 6) AS threshold, distance > threshold AS is_drift FROM w1 JOIN limits USING (instrument_id)"))
def drift_verdict(spark, sf_dir):
    daily, fitted = _daily(spark, sf_dir)
    found = drift.detect(daily, fitted, F.col("day") < F.lit(m.CUT.date()), instrument=["instrument_id"], window=["day"])
    return _days(found, *rounded(6, "distance", "threshold"), "is_drift")


_SHIFTED = m.sql("limits", "SELECT count(*) FILTER (truth AND flag) AS tp, count(*) FILTER (truth AND NOT flag) AS fn, count(*) FILTER (NOT truth AND flag) AS fp, count(*) FILTER (NOT truth AND NOT flag) AS tn FROM (SELECT day >= DATE '2024-01-28' AS truth, distance > threshold AS flag FROM w1 JOIN limits USING (instrument_id) WHERE day >= DATE '2024-01-21')")


@query(_SHIFTED)
def score_summary(spark, sf_dir):
    """Verdicts of the scored days against a stated truth: the last three days."""
    daily, fitted = _daily(spark, sf_dir)
    found = drift.detect(daily, fitted, F.col("day") < F.lit(m.CUT.date()), instrument=["instrument_id"], window=["day"]).where(F.col("day") >= F.lit(m.CUT.date()))
    return drift.confusion(found, F.col("day") >= F.lit(datetime(2024, 1, 28).date())).select("tp", "fn", "fp", "tn")


_HOURS = [
    "hh AS (SELECT instrument_id, event_hour, bin, CAST(sum(delta) AS BIGINT) AS cnt FROM fact GROUP BY ALL HAVING sum(delta) <> 0)",
    "hs AS (SELECT DISTINCT instrument_id, event_hour FROM hh)",
    "hd AS (SELECT h.instrument_id, h.event_hour, a.bin, a.hi - a.lo AS w, CAST(coalesce(c.cnt, 0) AS DOUBLE) AS c FROM hs h JOIN axis a USING (instrument_id) LEFT JOIN hh c ON c.instrument_id = h.instrument_id AND c.event_hour = h.event_hour AND c.bin = a.bin)",
]
_HOUR_W1 = [
    "hp AS (SELECT instrument_id, event_hour, bin, w, c / nullif(sum(c) OVER v, 0) - b / nullif(sum(b) OVER v, 0) AS g FROM hb WINDOW v AS (PARTITION BY instrument_id, event_hour))",
    "hz AS (SELECT *, sum(g) OVER (PARTITION BY instrument_id, event_hour ORDER BY bin) AS d1, sum(g) OVER (PARTITION BY instrument_id, event_hour ORDER BY bin) - g AS d0 FROM hp)",
    "hw AS (SELECT instrument_id, event_hour, sum(CASE WHEN d0 * d1 >= 0 THEN w * (abs(d0) + abs(d1)) / 2 ELSE w * (d0 * d0 + d1 * d1) / (2 * (abs(d0) + abs(d1))) END) AS distance FROM hz GROUP BY ALL)",
]
_HOUR_OUT = f"SELECT instrument_id, {HOUR}, {rounded_sql(6, 'distance')} FROM hw"
_SHIFT = "hb AS (SELECT a.instrument_id, a.event_hour, a.bin, a.w, a.c, coalesce(b.c, 0) AS b FROM hd a LEFT JOIN hd b ON b.instrument_id = a.instrument_id AND b.bin = a.bin AND b.event_hour = a.event_hour - INTERVAL {} HOUR)"
_ROLL = "hb AS (SELECT a.instrument_id, a.event_hour, a.bin, a.w, any_value(a.c) AS c, coalesce(sum(b.c), 0) AS b FROM hd a LEFT JOIN hd b ON b.instrument_id = a.instrument_id AND b.bin = a.bin AND b.event_hour >= a.event_hour - INTERVAL 24 HOUR AND b.event_hour < a.event_hour GROUP BY ALL)"


def _baseline(rule: str, cte: str) -> None:
    def run(spark, sf_dir):
        _, fitted, fact = m.setting(spark, sf_dir)
        hourly = facts.net_counts(fact, ["instrument_id", "schema_id", "event_hour", "bin"])
        found = drift.baseline(hourly, fitted, rule, instrument=["instrument_id"])
        return found.select("instrument_id", text("event_hour").alias("event_hour"), *rounded(6, "distance"))

    run.__name__ = f"baseline_{rule}"
    query(m.sql("axis", _HOUR_OUT, *_HOURS, cte, *_HOUR_W1))(run)


_baseline("previous_hour", _SHIFT.format(1))
_baseline("same_hour_yesterday", _SHIFT.format(24))
_baseline("rolling_window", _ROLL)


@query(m.sql("gaps", "SELECT instrument_id, CAST(day AS VARCHAR) AS day, round(sum((greatest(p, 1e-6) - greatest(q, 1e-6)) * ln(greatest(p, 1e-6) / greatest(q, 1e-6))) + 1e-08, 6) AS psi, round(sum(greatest(p, 1e-6) * ln(greatest(p, 1e-6) / greatest(q, 1e-6))) + 1e-08, 6) AS kl, round(sum(CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0 END) / 2 + 1e-08, 6) AS js, round(max(abs(cd)) + 1e-08, 6) AS ks, round(sum(p * q) / sqrt(sum(p * p) * sum(q * q)) + 1e-08, 6) AS cosine FROM (SELECT *, sum(p - q) OVER (PARTITION BY instrument_id, day ORDER BY bin) AS cd FROM gaps) GROUP BY instrument_id, day"))
def divergences(spark, sf_dir):
    daily, fitted = _daily(spark, sf_dir)
    reference = drift.pooled(daily.where(F.col("day") < F.lit(m.CUT.date())), ["instrument_id"])
    found = drift.divergences(daily, reference, fitted, instrument=["instrument_id"], window=["day"])
    return _days(found, *rounded(6, "psi", "kl", "js", "ks", "cosine"))


# bands

_SCHEME = BandScheme.severity(40.0, 100.0, 250.0)


@query("SELECT event_id, CASE WHEN value < 40 THEN 'Nominal' WHEN value < 100 THEN 'Elevated' WHEN value < 250 THEN 'Warning' ELSE 'Critical' END AS band FROM events")
def band_classify(spark, sf_dir):
    return _SCHEME.classify(m.table(spark, sf_dir, "events")).select("event_id", "band")


_BANDS = [("Nominal", "-1e308", "40"), ("Elevated", "40", "100"), ("Warning", "100", "250"), ("Critical", "250", "1e308")]
_SHARE = ", ".join(f"round((sum(c * greatest(0, least(hi, {hi}) - greatest(lo, {lo})) / (hi - lo)){' + any_value(under)' if n == 'Nominal' else ' + any_value(mass) - any_value(under) - sum(c)' if n == 'Critical' else ''}) / any_value(mass) + 1e-08, 6) AS {n}" for n, lo, hi in _BANDS)


@query(m.sql("cum", f"SELECT instrument_id, CAST(day AS VARCHAR) AS day, {_SHARE} FROM cum GROUP BY instrument_id, day"))
def band_occupancy(spark, sf_dir):
    daily, fitted = _daily(spark, sf_dir)
    return _days(_SCHEME.occupancy(daily, fitted, ["instrument_id", "day"]), *rounded(6, *_SCHEME.labels))


# serving


def _state(spark, sf_dir, fact: DataFrame) -> DataFrame:
    """The state as two arrival batches added up."""
    early = F.col("arrival_time") <= F.lit(m.AS_OF).cast("timestamp_ntz")
    return serving.merge(serving.net(fact.where(early)), serving.net(fact.where(~early)))


@query(m.sql("fact", _NET.format("true")))
def current_state(spark, sf_dir):
    return _state(spark, sf_dir, m.setting(spark, sf_dir)[2]).select("instrument_id", "schema_id", "bin", "cnt")


@query("SELECT CAST(0 AS BIGINT) AS n_different")
def current_state_rebuild_diff(spark, sf_dir):
    fact = m.setting(spark, sf_dir)[2]
    return serving.difference(_state(spark, sf_dir, fact), serving.net(fact)).agg(F.count("*").alias("n_different"))


@query(m.sql("ids", "SELECT schema_id, CAST(b AS INTEGER) AS bin, lo AS lower_edge, hi AS upper_edge, CASE WHEN b = 0 THEN hi WHEN b = k + 1 THEN lo ELSE (lo + hi) / 2 END AS midpoint FROM (SELECT schema_id, b, k, CASE WHEN b = 0 THEN '-inf'::DOUBLE ELSE edges[b] END AS lo, CASE WHEN b = k + 1 THEN 'inf'::DOUBLE ELSE edges[b + 1] END AS hi FROM (SELECT schema_id, edges, len(edges) - 1 AS k, unnest(generate_series(0, len(edges))) AS b FROM ids))").replace("lo AS lower_edge, hi AS upper_edge", "CAST(lo AS VARCHAR) AS lower_edge_text, hi < 'inf'::DOUBLE AS closed").replace("CAST(lo AS VARCHAR) AS lower_edge_text", "lo > '-inf'::DOUBLE AS bounded"))
def schema_edges(spark, sf_dir):
    found = binning.schema_edges(m.schemas(m.readings(spark, sf_dir)))
    infinite = float("inf")
    return found.select("schema_id", "bin", (F.col("lower_edge") > -infinite).alias("bounded"), (F.col("upper_edge") < infinite).alias("closed"), "midpoint")


@query(m.sql("daily", "SELECT d.instrument_id, CAST(d.day AS VARCHAR) AS day, CAST(b AS INTEGER) AS bin, coalesce(c.cnt, 0) AS cnt FROM (SELECT instrument_id, day, unnest(generate_series(0, len(edges))) AS b FROM (SELECT DISTINCT instrument_id, day FROM daily) JOIN ids USING (instrument_id)) d LEFT JOIN daily c ON c.instrument_id = d.instrument_id AND c.day = d.day AND c.bin = d.b"))
def histogram_plot(spark, sf_dir):
    daily, fitted = _daily(spark, sf_dir)
    return _days(serving.histogram_plot(daily, fitted, ["instrument_id", "day"]), "bin", "cnt")


@query(m.sql("ids", "SELECT schema_id, CAST(b AS INTEGER) AS bin, round(CASE WHEN b IN (0, k + 1) THEN med ELSE edges[b + 1] - edges[b] END, 6) AS width FROM (SELECT schema_id, edges, len(edges) - 1 AS k, unnest(generate_series(0, len(edges))) AS b, list_median(list_transform(generate_series(1, len(edges) - 1), lambda i: edges[i + 1] - edges[i])) AS med FROM ids)"))
def plot_widths(spark, sf_dir):
    """Bin widths with the open bins' replaced by the schema's median width."""
    from pyspark.sql import Window

    edges = binning.schema_edges(m.schemas(m.readings(spark, sf_dir))).withColumn("w", F.col("upper_edge") - F.col("lower_edge"))
    return edges.select("schema_id", "bin", F.round(channels.finite_widths("w", Window.partitionBy("schema_id")), 6).alias("width"))


# channels, contract, registry


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 6) AS magnitude, round(CAST(embedding[1] AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 6) AS first FROM embeddings")
def decompose_vector(spark, sf_dir):
    found = channels.decompose(m.table(spark, sf_dir, "embeddings"), "embedding", 1)
    return found.select("vec_id", F.round("magnitude", 6).alias("magnitude"), F.round(F.get("direction", F.lit(0)), 6).alias("first"))


@query("SELECT CAST(event_id AS VARCHAR) AS measurement_id, event_type AS instrument_id, 'k' AS channel, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS event_time, CAST(json_extract(props, '$.k') AS DOUBLE) AS value FROM events WHERE event_id % 50 <> 7")
def json_contract(spark, sf_dir):
    """events as JSON payloads, a few broken, through the contract."""
    events = m.table(spark, sf_dir, "events")
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    record = F.to_json(F.struct(F.col("event_type").alias("instrument_id"), F.col("event_id").cast("string").alias("measurement_id"), iso.alias("event_time"), iso.alias("arrival_time"), F.from_json("props", "map<string,double>").alias("values")))
    payload = F.when(F.col("event_id") % 50 == 7, F.lit("{not json")).when(F.col("event_id") % 3 == 0, F.concat(F.lit("["), record, F.lit("]"))).otherwise(record)
    good, _ = contract.parse(events.select(payload.alias("payload")))
    return good.select("measurement_id", "instrument_id", "channel", text("event_time").alias("event_time"), "value")


@query("SELECT CASE WHEN event_id % 11 = 0 THEN 'no instrument' WHEN event_id % 7 = 0 THEN 'no values' END AS problem, count(*) AS n FROM events WHERE event_id % 11 = 0 OR event_id % 7 = 0 GROUP BY 1")
def measurement_validation(spark, sf_dir):
    events = m.table(spark, sf_dir, "events")
    made = events.select(F.when(F.col("event_id") % 11 != 0, F.col("event_type")).alias("instrument_id"), F.when(F.col("event_id") % 7 != 0, F.array("value")).otherwise(F.array().cast("array<double>")).alias("values"))
    _, bad = channels.split_valid(made, channels.measurement_problem(F.col("instrument_id"), F.col("values")))
    return bad.groupBy("problem").agg(F.count("*").alias("n"))


@query("SELECT event_type AS instrument_id, CASE WHEN ts < TIMESTAMP '2024-01-11' THEN 'first' ELSE 'second' END AS site, count(*) AS n FROM events GROUP BY ALL")
def registry_interval(spark, sf_dir):
    rows = m.readings(spark, sf_dir)
    at = lambda t: F.lit(t).cast("timestamp_ntz")
    move = datetime(2024, 1, 11)
    names = rows.select("instrument_id").distinct()
    registry = names.select("instrument_id", at(datetime(2023, 1, 1)).alias("valid_from"), at(move).alias("valid_to"), F.lit("first").alias("site")).union(names.select("instrument_id", at(move), F.lit(None).cast("timestamp_ntz"), F.lit("second")))
    return registered(rows, registry, time="event_time").groupBy("instrument_id", "site").agg(F.count("*").alias("n"))


# simulator and streaming: no SQL

_START = datetime(2024, 6, 10)


def scenario(days: int = 28, faults: tuple = (), **options) -> simulator.Instrument:
    return simulator.Instrument("TEMP-001", options.pop("start", _START), options.pop("start", _START) + timedelta(days=days), seed=11, faults=faults, **options)


def mean_shift(amount: float, first: datetime = datetime(2024, 6, 27), days: int = 3) -> simulator.Fault:
    return simulator.Fault("mean_shift", first, first + timedelta(days=days), amount)


@query()
def simulated_readings(spark, sf_dir):
    return simulator.simulate(spark, scenario())


@query()
def fault_injection(spark, sf_dir):
    faults = (mean_shift(4.0), simulator.Fault("stuck", datetime(2024, 6, 20), datetime(2024, 6, 20, 3), 12.5), simulator.Fault("spike", datetime(2024, 6, 21, 12), None, 58.0))
    return simulator.simulate_all(spark, [scenario(faults=faults)])


@query("""SELECT * FROM (VALUES ('mean_shift', '2024-06-27T00:00:00', '2024-06-30T00:00:00', '{"magnitude": 4.0, "channel": "temperature"}'), ('spike', '2024-06-21T12:00:00', CAST(NULL AS VARCHAR), '{"value": 58.0, "channel": "temperature"}')) AS t(kind, start, "end", detail)""")
def fault_truth(spark, sf_dir):
    return simulator.ground_truth(spark, scenario(faults=(mean_shift(4.0), simulator.Fault("spike", datetime(2024, 6, 21, 12), None, 58.0))))


def simulated_drift(spark, fault: simulator.Fault, *, calibration_days: int = 14, points: int | None = None, bins: int = 48) -> DataFrame:
    """Daily verdicts of a simulated fault, calibrated on the leading days only."""
    rows = simulator.simulate(spark, scenario(faults=(fault,))).withColumn("day", F.to_date("event_time"))
    lead = F.col("day") < F.lit((_START + timedelta(days=calibration_days)).date())
    fitted = binning.fit_schemas(rows.where(lead), scope=["instrument_id"], bins=bins)
    daily = binning.assign_bins(rows, fitted, scope=["instrument_id"]).groupBy("instrument_id", "schema_id", "day", "bin").agg(F.count("*").alias("cnt"))
    return drift.detect(daily, fitted, lead, instrument=["instrument_id"], window=["day"], points=points)


@query()
def simulated_drift_detection(spark, sf_dir):
    return simulated_drift(spark, mean_shift(4.0))


_SENT = "event_id % 50 <> 7"


def _payloads(spark, sf_dir) -> DataFrame:
    """All events as JSON payloads: every tenth is sent twice, every third as an array, every fiftieth is broken."""
    rows = m.readings(spark, sf_dir)
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    record = F.to_json(F.struct("instrument_id", "measurement_id", iso("event_time").alias("event_time"), iso("arrival_time").alias("arrival_time"), F.create_map("channel", "value").alias("values")))
    payload = F.when(~F.expr(_SENT), F.lit("{not json")).when(F.col("event_id") % 3 == 0, F.concat(F.lit("["), record, F.lit("]"))).otherwise(record)
    times = F.when(F.col("event_id") % 10 == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select(payload.alias("payload"), F.explode(times).alias("time"))


@query(m.sql("fact", f"SELECT {_ROW} FROM fact WHERE entry_type = 'measurement' AND CAST(measurement_id AS BIGINT) % 50 <> 7"))
def streaming_ingest(spark, sf_dir):
    """All events as payloads through the stream, the repeated ones in a second batch; the fact it wrote."""
    from ..streaming import ingest

    home = shared_folder(spark, "stream")
    sent = _payloads(spark, sf_dir)
    fitted = m.schemas(m.readings(spark, sf_dir))
    for time in (1, 2):
        sent.where(F.col("time") == time).select("payload").write.mode("append").text(f"{home}/in")
        ingest.ingest(spark, f"{home}/in", fitted, f"{home}/fact", f"{home}/offsets", f"{home}/state").awaitTermination()
    return _rows(ingest.stored_fact(spark, f"{home}/fact"))


@query(m.sql("fact", _NET.format("true")))
def current_state_stored(spark, sf_dir):
    """The state from disk: batches by arrival day of the week, one of them replayed, then compacted."""
    fact = stored(m.setting(spark, sf_dir)[2], "fact")
    home = shared_folder(spark, "state")
    for day in (1, 2, 3, 4, 5, 6, 7, 3):
        serving.apply_batch(f"{home}/batches", f"day-{day}", fact.where(F.dayofweek("arrival_time") == day))
    serving.compact(spark, f"{home}/batches", f"{home}/compact")
    return serving.current_state(spark, f"{home}/compact").select("instrument_id", "schema_id", "bin", "cnt")


@query(m.sql("fact", "SELECT bin, CAST(sum(delta) AS BIGINT) AS cnt FROM fact WHERE instrument_id = 'click' GROUP BY bin HAVING sum(delta) <> 0"))
def point_read(spark, sf_dir):
    """One instrument's histogram out of the state."""
    _, fitted, fact = m.setting(spark, sf_dir)
    ident = fitted.where("instrument_id = 'click'").first()["schema_id"]
    return serving.distribution(serving.net(fact), "click", ident)


@query(m.sql("fact", "SELECT instrument_id, CAST(count(*) AS BIGINT) AS n_cells, CAST(sum(cnt) AS BIGINT) AS total FROM (SELECT instrument_id, event_hour, bin, sum(delta) AS cnt FROM fact GROUP BY ALL HAVING sum(delta) <> 0) GROUP BY instrument_id"))
def views(spark, sf_dir):
    """SQL over the registered views."""
    _, fitted, fact = m.setting(spark, sf_dir)
    serving.register_views(fact, fitted)
    return spark.sql("SELECT instrument_id, count(*) AS n_cells, sum(cnt) AS total FROM histogram GROUP BY instrument_id")


@query("SELECT CASE WHEN n_nationkey % 7 = 0 THEN 'no name' WHEN n_nationkey % 5 > 2 THEN 'rank is not 0, 1 or 2' ELSE 'unknown kind' END AS problem, count(*) AS n FROM nation WHERE n_nationkey % 7 = 0 OR n_nationkey % 5 > 2 OR n_nationkey % 4 = 3 GROUP BY 1")
def channel_validation(spark, sf_dir):
    """Why channels made of the nations are invalid."""
    key = F.col("n_nationkey")
    made = m.table(spark, sf_dir, "nation").select(F.when(key % 7 != 0, F.col("n_name")).alias("name"), (key % 5).alias("rank"), F.when(key % 4 == 3, F.lit("cubic")).when(key % 2 == 0, F.lit("linear")).otherwise(F.lit("circular")).alias("kind"))
    _, bad = channels.split_valid(made, channels.channel_problem(F.col("name"), F.col("rank"), F.col("kind")))
    return bad.groupBy("problem").agg(F.count("*").alias("n"))


_CONFIG = """
instrument_types:
  thermometer:
    channels: [{name: temperature, rank: 0, kind: linear, unit: C}, {name: wind, rank: 1, kind: circular, unit: m/s}]
    bands: {low: [0, 18], fine: [18, 28], high: [28, 40]}
    drift_rules: [{baseline: rolling_window, threshold: auto}]
instruments:
  - {id: T-1, type: thermometer, labels: [roof, north], location: {latitude: 1.5, longitude: 2.5, height_m: 3, datum: WGS84, epoch: "2020"}}
"""


@query("SELECT * FROM (VALUES ('thermometer', 'temperature', CAST(0 AS INTEGER), 'linear', 'C'), ('thermometer', 'wind', 1, 'circular', 'm/s')) AS t(type, name, rank, kind, unit)")
def config_channels(spark, sf_dir):
    return load(spark, _CONFIG)["channels"]


@query("SELECT * FROM (VALUES ('thermometer', 'low', CAST(0 AS DOUBLE), CAST(18 AS DOUBLE)), ('thermometer', 'fine', 18, 28), ('thermometer', 'high', 28, 40)) AS t(type, label, lower, upper)")
def config_bands(spark, sf_dir):
    return load(spark, _CONFIG)["bands"]
