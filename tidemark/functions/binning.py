"""Equal-mass bin schemas: fit, content id, bin assignment, axis normalisation.

A schema row has schema_id, scope, channel, edges (K+1 ascending doubles), fit_start and
fit_end.  Bin 0 is underflow, 1..K are [e[i-1], e[i]) with the maximum in K, K+1 is
overflow.  A null or NaN value has no bin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import stored

#: Readings per bin that the recommended count aims at, and its limits.  Fixed values.
PER_BIN, FEWEST, MOST = 20, 8, 256
ID_PREFIX = "bm_"
#: Edges that may become a literal decision tree in a plan, over all schemas together.
LITERAL_EDGES = 2048


def recommended_bins(n: Column) -> Column:
    """n // 20, at least 8 and at most 256."""
    return F.greatest(F.lit(FEWEST), F.least(F.lit(MOST), F.floor(n / PER_BIN))).cast("int")


def content_id(scope: Column, channel: Column, start: Column, end: Column, edges: Column) -> Column:
    """A hash of what defines a schema; equal content has an equal id."""
    text = F.concat_ws("|", scope, channel, start, end, F.array_join(F.transform(edges, lambda e: F.format_string("%.6f", e)), ","))
    return F.concat(F.lit(ID_PREFIX), F.substring(F.sha2(text.cast("binary"), 256), 1, 12))


def sorted_quantiles(rows: DataFrame, scope: list[str], value: str, fractions: list[float]) -> DataFrame:
    """scope, n, q: exact quantiles with linear interpolation, by one distributed sort.

    The sorted values are written with their places, so a task's memory is bounded however
    many values a scope has; then only the places that the quantiles need are read.
    """
    own = rows.select(*scope, F.col(value).cast("double").alias("_v"))
    placed = stored(own.repartitionByRange(*scope, "_v").sortWithinPartitions(*scope, "_v").withColumn("_at", F.monotonically_increasing_id()), "sorted")
    runs = placed.groupBy(*scope, F.shiftright("_at", 33).alias("_part")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    over = Window.partitionBy(*scope)  # of one row for each partition of the sort
    runs = runs.withColumns({"n": F.sum("_n").over(over), "_before": F.sum("_n").over(over.orderBy("_part")) - F.col("_n")})
    place = lambda f: (F.col("n") - 1) * F.lit(f)
    ends = [round_(place(f)).cast("bigint") for f in fractions for round_ in (F.floor, F.ceil)]
    needed = runs.withColumn("_rank", F.explode(F.array_distinct(F.array(*ends)))).where("_rank BETWEEN _before AND _before + _n - 1")
    needed = needed.select(*scope, "n", "_rank", (F.col("_first") + F.col("_rank") - F.col("_before")).alias("_at"))
    found = needed.join(placed.select("_at", "_v"), "_at").groupBy(*scope).agg(F.first("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("m"))

    def quantile(f: float) -> Column:
        at = place(f)
        lo, hi = F.floor(at).cast("bigint"), F.ceil(at).cast("bigint")
        return F.when(lo == hi, F.col("m")[lo]).otherwise((hi - at) * F.col("m")[lo] + (at - lo) * F.col("m")[hi])

    return found.select(*scope, "n", F.array(*[quantile(f) for f in fractions]).alias("q"))


def fit_schemas(readings: DataFrame, *, scope: list[str], value: str = "value", channel: str = "value", bins: int | None = None, fit_start: str = "", fit_end: str = "", strict: bool = True, accuracy: int | None = None, by_sort: bool = False) -> DataFrame:
    """One schema per scope: edges at equally spaced quantiles, rounded to 9 places, distinct.

    With `bins` None the recommended count for the number of readings is taken.  NaN and
    null values are left out.  A scope with fewer values than bins, or with fewer than two
    distinct edges, raises when the result is computed; with `strict` False it is dropped.

    Exact quantiles keep a scope's distinct values in one task's memory.  For scopes of
    many million distinct values `by_sort` finds the same ones by a distributed sort, whose
    memory is bounded; `accuracy` takes Spark's mergeable summaries of that size instead:
    one pass, ranks right to 1 / accuracy, but ids that another run need not repeat.
    """
    valid = readings.where(F.col(value).isNotNull() & ~F.isnan(value))
    n = F.count(F.lit(1))
    if bins is None:
        sized = valid.groupBy(*scope).agg(n.alias("n"))
        sized = sized.withColumn("target", recommended_bins(F.col("n")))
        counts = [r["target"] for r in sized.select("target").distinct().collect()]  # 249 values at most
        parts = [fit_schemas(valid.join(F.broadcast(sized.where(F.col("target") == k).select(*scope)), scope, "left_semi"), scope=scope, value=value, channel=channel, bins=k, fit_start=fit_start, fit_end=fit_end, strict=strict, accuracy=accuracy, by_sort=by_sort) for k in sorted(counts)]
        out = parts[0] if parts else fit_schemas(valid, scope=scope, value=value, channel=channel, bins=FEWEST, fit_start=fit_start, fit_end=fit_end, strict=strict)
        for p in parts[1:]:
            out = out.union(p)
        return out
    fractions = F.array(*[F.lit(i / bins) for i in range(bins + 1)])
    if by_sort:
        fitted = sorted_quantiles(valid, scope, value, [i / bins for i in range(bins + 1)])
    else:
        quantiles = F.percentile(value, fractions) if accuracy is None else F.percentile_approx(value, fractions, accuracy)
        fitted = valid.groupBy(*scope).agg(n.alias("n"), quantiles.alias("q"))
    edges = F.array_sort(F.array_distinct(F.transform("q", lambda e: F.round(e, 9))))
    fitted = fitted.withColumn("edges", edges)
    good = (F.col("n") >= bins) & (F.size("edges") >= 2)
    if strict:
        fitted = fitted.withColumn("edges", F.when(good, F.col("edges")).otherwise(F.raise_error(F.concat(F.lit(f"cannot fit {bins} bins to "), F.col("n").cast("string"), F.lit(" values")))))
    else:
        fitted = fitted.where(good)
    name = F.concat_ws("/", *[F.col(c).cast("string") for c in scope])
    ident = content_id(name, F.lit(channel), F.lit(fit_start), F.lit(fit_end), F.col("edges"))
    named = [x.alias(c) for c, x in (("scope", name), ("channel", F.lit(channel))) if c not in scope]
    return fitted.select(*scope, ident.alias("schema_id"), *named, "edges", F.lit(fit_start).alias("fit_start"), F.lit(fit_end).alias("fit_end"))


def _tree(value: Column, edges: list[float], lo: int, hi: int) -> Column:
    """How many of edges[lo:hi] are <= value, plus lo, as a balanced CASE."""
    if lo == hi:
        return F.lit(lo)
    mid = (lo + hi) // 2
    return F.when(value < F.lit(edges[mid]), _tree(value, edges, lo, mid)).otherwise(_tree(value, edges, mid + 1, hi))


def bin_of(value: Column, edges: list[float]) -> Column:
    """Bin of a value under fixed edges; stays inside whole-stage codegen."""
    k = len(edges) - 1
    inside = F.least(_tree(value, edges, 0, k + 1), F.lit(k))
    return F.when(value.isNull() | F.isnan(value), F.lit(None).cast("int")).when(value < edges[0], F.lit(0)).when(value > edges[-1], F.lit(k + 1)).otherwise(inside).cast("int")


def bin_in(value: Column, edges: Column) -> Column:
    """Bin of a value under an array column of edges."""
    k = F.size(edges) - 1
    inside = F.least(F.size(F.filter(edges, lambda e: e <= value)), k)
    return F.when(value.isNull() | F.isnan(value), F.lit(None).cast("int")).when(value < F.get(edges, F.lit(0)), F.lit(0)).when(value > F.get(edges, k), k + 1).otherwise(inside).cast("int")


def frozen(schemas: DataFrame) -> DataFrame:
    """The same schemas, fitted once: as literal rows, or as a table if they have over LITERAL_EDGES edges."""
    kept = stored(schemas, "schemas")
    rows = kept.limit(LITERAL_EDGES + 1).collect()
    if sum(len(r["edges"]) for r in rows) > LITERAL_EDGES:
        return kept
    return schemas.sparkSession.createDataFrame(rows, schemas.schema)


def assign_bins(readings: DataFrame, schemas: DataFrame, *, scope: list[str], value: str = "value") -> DataFrame:
    """readings with schema_id and bin, by the schema of each reading's scope.

    Few and small schemas (LITERAL_EDGES edges in all, checked) become a literal decision
    tree and no join; others are joined, broadcast by Spark if they are small enough.
    Readings without a schema, or without a value, have a null bin.
    """
    taken = schemas.select(*scope, "schema_id", "edges")
    rows = taken.limit(LITERAL_EDGES + 1).collect()
    if sum(len(r["edges"]) for r in rows) <= LITERAL_EDGES:
        which = lambda r: F.lit(True) if not scope else _all([F.col(c) == F.lit(r[c]) for c in scope])
        bin_, ident = None, None
        for r in rows:
            here = bin_of(F.col(value), r["edges"])
            bin_ = F.when(which(r), here) if bin_ is None else bin_.when(which(r), here)
            ident = F.when(which(r), F.lit(r["schema_id"])) if ident is None else ident.when(which(r), F.lit(r["schema_id"]))
        return readings.withColumns({"schema_id": ident if rows else F.lit(None).cast("string"), "bin": bin_ if rows else F.lit(None).cast("int")})
    joined = readings.join(taken, scope, "left")
    return joined.withColumn("bin", bin_in(F.col(value), F.col("edges"))).drop("edges")


def _all(terms: list[Column]) -> Column:
    out = terms[0]
    for t in terms[1:]:
        out = out & t
    return out


def normalised(value: Column, edges: Column) -> Column:
    """(value - min) / (max - min), not clamped."""
    lo, hi = F.get(edges, F.lit(0)), F.get(edges, F.size(edges) - 1)
    return F.try_divide(value - lo, hi - lo)


def schema_edges(schemas: DataFrame) -> DataFrame:
    """schema_id, bin, lower_edge, upper_edge, midpoint of every bin, open ones included.

    An open bin's midpoint is its finite edge; with both edges open it is 0.
    """
    infinite = F.lit(float("inf"))
    rows = schemas.select("schema_id", F.concat(F.array(-infinite), "edges", F.array(infinite)).alias("e"))
    rows = rows.select("schema_id", "e", F.explode(F.sequence(F.lit(0), F.size("e") - 2)).alias("bin"))
    lo, hi = F.get("e", F.col("bin")), F.get("e", F.col("bin") + 1)
    open_lo, open_hi = lo == -infinite, hi == infinite
    mid = F.when(open_lo & open_hi, F.lit(0.0)).when(open_lo, hi).when(open_hi, lo).otherwise((lo + hi) / 2)
    return rows.select("schema_id", F.col("bin").cast("int").alias("bin"), lo.alias("lower_edge"), hi.alias("upper_edge"), mid.alias("midpoint"))
