"""Near-duplicate groups of documents from bottom-k sketches of one hash function.

1. Every document gets its set of distinct word shingles as 64-bit hashes.  Documents
   with equal sets are one class; its sketch is the set's k least hashes.
2. Inverted lists of the first retained values count in how many classes each is.  A
   class that shares too few of them with any others cannot have a partner and leaves.
3. For the remaining classes inverted lists of the retained values generate the overlaps.
   Two sketches that share m of k values share one of their k-m+1 rarest (rarity by
   hashed counts, any total order being valid), so only these are listed: a value in
   thousands of sketches is listed for those that have little else.
4. Lists of a few members give their pairs.  In a long list one member is paired with
   all others; after these links are confirmed and the linked members are merged, only
   members of different components are compared by sketch, in bounded blocks.
5. The similarity estimated from the sketch of the union drops most pairs, the rest are
   confirmed on the full sets.  Components of confirmed links are the groups.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .frames import keyed, materialise, release, summed, table
from .textflat import chunks, shingles, splitmix, words


@dataclass(frozen=True)
class Settings:
    shingle: int = 5
    #: Similarity as a fraction: numerator, denominator.
    above: int = 80
    of: int = 100
    #: Retained values; those that the first inverted lists hold; those that blocks of a
    #: long list are compared by.
    sketch: int = 1024
    index: int = 32
    brief: int = 128
    #: Share of indexed values that a linked partner has at least (the chance of less, at
    #: similarity 0.8 and 32 values, is below 1e-6); for smaller sets it is exact.
    least: float = 0.4
    #: Members up to which a list gives all its pairs; members of one block of a longer one.
    short: int = 8
    block: int = 512
    #: Cells of the rarity counts: 4 bytes each are broadcast.
    cells: int = 1 << 20

    @property
    def similarity(self) -> float:
        return self.above / self.of

    def lowest(self, k: int) -> float:
        """Estimates from k retained values below this are dropped: five standard deviations under the similarity."""
        t = self.similarity
        return t - 5 * (t * (1 - t) / k) ** 0.5

    def needed(self, n: np.ndarray) -> np.ndarray:
        """Retained values that a set of n shares with a linked partner, at least.

        Exact where a partner retains its whole set too, else what the estimate demands.
        """
        exact = np.ceil(self.similarity * n - 1e-9)
        return np.where(self.whole(n), exact, np.floor(self.lowest(self.sketch) * np.minimum(n, self.sketch))).astype(np.int64)

    def whole(self, n: np.ndarray) -> np.ndarray:
        """Sets of n and all their possible partners are retained whole."""
        return n <= self.similarity * self.sketch


def _sets(texts: pa.Array, n: int):
    """For each chunk of rows: first row, set sizes, the sorted distinct shingle hashes of all rows."""
    for lo, hi, data, offsets in chunks(texts):
        found = words(data, offsets)
        value, row = shingles(found.hashes(), found.counts, n)
        order = np.lexsort((value, row))
        value, row = value[order], row[order]
        keep = np.ones(len(value), dtype=bool)
        keep[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
        value, row = value[keep], row[keep]
        yield lo, np.bincount(row, minlength=hi - lo), value


def _signatures(value: np.ndarray, sizes: np.ndarray) -> list[bytes | None]:
    """16 bytes per set: two independent sums of mixed hashes."""
    total = np.zeros((2, len(value) + 1), dtype=np.uint64)
    for k, salt in enumerate((0x243F6A8885A308D3, 0x13198A2E03707344)):
        np.cumsum(splitmix(value ^ np.uint64(salt)), out=total[k, 1:])
    ends = np.cumsum(sizes)
    both = np.stack([total[k, ends] - total[k, ends - sizes] for k in range(2)], axis=1)
    return [x.tobytes() if n else None for x, n in zip(both, sizes.tolist(), strict=True)]


def _ragged(value: np.ndarray, sizes: np.ndarray, most: int | None = None) -> pa.Array:
    """Lists of int64, one per row; with `most`, only the first ones of each."""
    if most is not None:
        place = np.arange(len(value)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        value, sizes = value[place < most], np.minimum(sizes, most)
    ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(value.view(np.int64)))


def sketches(own: DataFrame, s: Settings) -> DataFrame:
    """doc_id, t, cls, n_shingles, sketch of each row of (doc_id, t, text)."""
    kind = own.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for lo, sizes, value in _sets(batch.column(2), s.shingle):
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column(0).slice(lo, len(sizes)),
                    "t": batch.column(1).slice(lo, len(sizes)),
                    "cls": pa.array(_signatures(value, sizes), pa.binary()),
                    "n_shingles": pa.array(sizes, pa.int64()),
                    "sketch": _ragged(value, sizes, s.index),
                })

    return own.mapInArrow(run, f"doc_id {kind}, t binary, cls binary, n_shingles bigint, sketch array<bigint>")


def _candidates(classes: DataFrame, s: Settings) -> DataFrame:
    """cls of classes whose indexed values others share often enough."""
    value = classes.select("cls", "n", F.explode("sketch").alias("v"))
    # counts are written before they are joined back: a join straight above an aggregate
    # on the same key cannot be split where one value has very many rows
    shared = materialise(value.groupBy("v").agg(F.count("*").alias("df")).where("df > 1").select("v"), "shared")
    kept = F.least(F.col("n"), F.lit(s.index))
    return value.join(shared, "v").groupBy("cls", "n").agg(F.count("*").alias("m")).where(F.col("m") >= F.ceil(kept * s.least)).select("cls")


def _retained(members: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, row of each, set sizes) of the k least values of each set."""
    sizes = np.diff(np.asarray(members.offsets))
    value = np.asarray(members.flatten()).view(np.uint64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    keep = np.arange(len(value)) - np.repeat(np.cumsum(sizes) - sizes, sizes) < k
    return value[keep], row[keep], sizes


def _rarity(sets: DataFrame, s: Settings) -> np.ndarray:
    """How many retained values of all sets fall in each cell; the array's size is fixed."""

    def count(batches):
        total = np.zeros(s.cells, dtype=np.int64)
        for batch in batches:
            value, _, _ = _retained(batch.column(0), s.sketch)
            total += np.bincount((value % np.uint64(s.cells)).astype(np.int64), minlength=s.cells)
        return total

    return np.minimum(summed(sets.select("members"), count, s.cells), np.iinfo(np.int32).max).astype(np.int32)


def _entries(sets: DataFrame, s: Settings) -> DataFrame:
    """v, cls, n, cap: the inverted lists of the rarest retained values of each set; a partner has `cap` values at most."""
    rarity = sets.sparkSession.sparkContext.broadcast(_rarity(sets, s))
    t = s.similarity

    def run(batches):
        counts = rarity.value
        for batch in batches:
            value, row, sizes = _retained(batch.column(2), s.sketch)
            held = np.minimum(sizes, s.sketch)
            rare = counts[value % np.uint64(s.cells)]
            order = np.lexsort((value, rare, row))
            place = np.arange(len(value)) - np.repeat(np.cumsum(held) - held, held)
            n = sizes[row]
            at = np.flatnonzero((place <= (held - s.needed(sizes))[row]) & (rare[order] > 1))
            # if a whole set's first shared value is at `place`, n - place bounds the overlap
            most = np.where(s.whole(n), (n - place) * (1 + t) / t - n, n / t)
            cap = np.floor(most + 1e-9).astype(np.int64)
            yield pa.RecordBatch.from_pydict({"v": pa.array(value[order][at].view(np.int64)), "cls": batch.column(0).take(pa.array(row[at])), "n": pa.array(n[at], pa.int64()), "cap": pa.array(cap[at], pa.int64())})

    found = materialise(sets.select("cls", "n", "members").mapInArrow(run, "v bigint, cls binary, n bigint, cap bigint"), "rarest")
    # what no other member of the list can be small enough for leaves it
    sized = materialise(found.groupBy("v").agg(F.min("n").alias("least"), F.count("*").alias("c")).where("c > 1"), "sizes")
    fit = materialise(found.join(sized.select("v", "least"), "v").where("cap >= least").drop("least"), "lists")
    release(found, sized)
    return fit


def _fits(a: str, b: str) -> Column:
    return (F.col(f"{a}.n") <= F.col(f"{b}.cap")) & (F.col(f"{b}.n") <= F.col(f"{a}.cap"))


def union_similarity(x: np.ndarray, y: np.ndarray, k: int) -> float:
    """Estimate from the retained values of the union: those up to the least limit of the two sketches.

    x and y are whole sorted sets; a set of k values or fewer has no limit.
    """
    limit = min([z[k - 1] for z in (x, y) if len(z) > k], default=None)
    x, y = (z[:k] if limit is None else z[: min(k, int(np.searchsorted(z, limit, side="right")))] for z in (x, y))
    shared = int(np.isin(x, y, assume_unique=True).sum())
    return shared / max(1, len(x) + len(y) - shared)


def _confirm(pairs: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """The pairs (a, b) whose sets are similar: estimate on the union's sketch, then exactly."""
    a = sets.select(F.col("cls").alias("a"), F.col("members").alias("x"))
    b = sets.select(F.col("cls").alias("b"), F.col("members").alias("y"))
    low = s.lowest(s.sketch)

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.asarray(x.values).view(np.uint64), np.asarray(y.values).view(np.uint64)
                if union_similarity(x, y, s.sketch) < low:
                    keep.append(False)
                    continue
                common = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(s.of * common >= s.above * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(a, "a").join(b, "b").select("a", "b", "x", "y").mapInArrow(run, "a binary, b binary")


#: Values of one step of the product that counts the overlaps of two blocks.
STEP = 2048


def block_estimates(left: list[np.ndarray], right: list[np.ndarray], n_left: np.ndarray, n_right: np.ndarray, k: int) -> np.ndarray:
    """union_similarity of each sketch on the left with each on the right."""
    sizes = [np.array([len(x) for x in side], dtype=np.int64) for side in (left, right)]
    value = [np.concatenate(side) for side in (left, right)]
    row = [np.repeat(np.arange(len(n)), n) for n in sizes]
    common = np.intersect1d(*value)
    shared = np.zeros((len(left), len(right)), dtype=np.float32)
    at = [np.searchsorted(common, v) for v in value]
    hit = [a < len(common) for a in at]
    for side in range(2):
        hit[side][hit[side]] = common[at[side][hit[side]]] == value[side][hit[side]]
    for lo in range(0, len(common), STEP):
        dense = []
        for side in range(2):
            here = hit[side] & (at[side] >= lo) & (at[side] < lo + STEP)
            x = np.zeros((len(sizes[side]), min(STEP, len(common) - lo)), dtype=np.float32)
            x[row[side][here], at[side][here] - lo] = 1
            dense.append(x)
        shared += dense[0] @ dense[1].T
    top = np.uint64(2**64 - 1)
    limit = [np.array([x[-1] if m > k else top for x, m in zip(side, n, strict=True)], dtype=np.uint64) for side, n in ((left, n_left), (right, n_right))]
    within = np.empty((2, len(left), len(right)), dtype=np.float32)  # retained values up to the pair's limit
    for i, x in enumerate(left):
        within[0, i] = np.searchsorted(x, limit[1], side="right")
    for j, y in enumerate(right):
        within[1, :, j] = np.searchsorted(y, limit[0], side="right")
    return shared / np.maximum(1, within[0] + within[1] - shared)


def _block_pairs(long: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """Pairs of members of long lists, in different components, that the sketches do not rule out."""
    k, low = s.brief, s.lowest(s.brief)
    own = long.join(sets.select("cls", F.slice("members", 1, k).alias("sketch")), "cls")
    blocks = F.ceil(F.col("c") / s.block)
    own = own.withColumn("mine", F.pmod(F.xxhash64("cls"), blocks))
    own = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)))
    own = own.select("v", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "cls", "n", "cap", "component", "sketch")

    def run(group: pa.Table) -> pa.Table:
        sizes, caps = np.asarray(group["n"]), np.asarray(group["cap"])
        cls = np.array(group["cls"].to_pylist(), dtype=object)
        _, label = np.unique(np.array(group["component"].to_pylist(), dtype=object), return_inverse=True)
        block, i, j = np.asarray(group["mine"]), group["i"][0].as_py(), group["j"][0].as_py()
        sketch = [np.asarray(x.values).view(np.uint64) for x in group["sketch"]]
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        if not len(left) or not len(right):
            return pa.table({"a": pa.array([], pa.binary()), "b": pa.array([], pa.binary())})
        near = block_estimates([sketch[x] for x in left], [sketch[y] for y in right], sizes[left], sizes[right], k) >= low
        near &= label[left][:, None] != label[right][None, :]
        x, y = (side[at] for side, at in zip((left, right), np.nonzero(near), strict=True))
        fit = (sizes[x] <= caps[y]) & (sizes[y] <= caps[x]) & ((i != j) | (x < y))
        both = [(min(p, q), max(p, q)) for p, q in zip(cls[x[fit]], cls[y[fit]], strict=True)]
        return pa.table({"a": pa.array([p for p, _ in both], pa.binary()), "b": pa.array([q for _, q in both], pa.binary())})

    return own.groupBy("v", "i", "j").applyInArrow(run, "a binary, b binary").distinct()


def _links(sets: DataFrame, s: Settings) -> list[DataFrame]:
    """Tables of confirmed links (a, b) whose components are those of all links between the sets."""
    entries = _entries(sets, s)
    sized = entries.groupBy("v").agg(F.count("*").alias("c"), F.min(F.struct(-F.col("cap"), "n", "cls")).alias("first")).where("c > 1")
    sized = materialise(sized, "sizes")
    lists = entries.join(sized.select("v", "c"), "v")
    few = lists.where(F.col("c") <= s.short).select("v", F.struct("cls", "n", "cap").alias("x"))
    held = few.groupBy("v").agg(F.array_sort(F.collect_list("x")).alias("held"))  # of s.short at most
    pair = held.select(F.posexplode("held").alias("i", "x"), "held").select("x", F.explode(F.slice("held", F.col("i") + 2, s.short)).alias("y"))
    pair = pair.where(_fits("x", "y")).select(F.col("x.cls").alias("a"), F.col("y.cls").alias("b"))
    long = lists.where(F.col("c") > s.short)
    pivot = sized.where(F.col("c") > s.short).select("v", F.col("first.cls").alias("p"), F.col("first.n").alias("pn"), (-F.col("first.col1")).alias("pc"))
    star = long.join(pivot, "v").where((F.col("cls") != F.col("p")) & (F.col("n") <= F.col("pc")) & (F.col("pn") <= F.col("cap")))
    star = star.select(F.least("cls", "p").alias("a"), F.greatest("cls", "p").alias("b"))
    links = materialise(_confirm(pair.union(star).distinct(), sets, s), "links", batch_rows=200)
    if long.isEmpty():
        release(entries, sized)
        return [links]
    label = components(links) if not links.isEmpty() else None
    split = long.withColumn("component", F.col("cls"))
    if label is not None:
        split = long.join(label.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("label", "cls")).drop("label")
    mixed = split.groupBy("v").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("v")
    mixed = materialise(mixed, "mixed")
    more = materialise(_confirm(_block_pairs(split.join(mixed, "v"), sets, s), sets, s), "links", batch_rows=200)
    release(entries, sized, mixed)
    return [links, more]


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs.

    component_id is the least doc_id reachable by links, the row's own included.  Words
    are `[^\\x20\\x09-\\x0D]+` after A-Z became a-z; a text of fewer words than a shingle
    is one shingle.  Null and empty texts have no shingles and are linked with nothing.  A
    text of any length has its whole set.  Equal texts are always linked, so repeated rows
    each get the same component and, if their id is the least, are all kept.  A row
    without an id links others as any row does and takes their component; it has none of
    its own to give and counts as kept.  An empty table gives no rows.
    """
    s = settings
    own = keyed(docs, id_col, text_col).select("doc_id", F.unhex(F.md5(F.col("text").cast("binary"))).alias("t"), "text")
    found = materialise(sketches(own, s), "sketches")
    filled = found.where(F.col("cls").isNotNull())
    # the row whose text stands for a class is known by id and digest, as ids can be null or repeat
    classes = filled.groupBy("cls").agg(F.min("n_shingles").alias("n"), F.min("sketch").alias("sketch"), F.min("doc_id").alias("least_id"), F.min(F.struct("doc_id", "t")).alias("of"))
    classes = materialise(classes, "classes")
    chosen = materialise(_candidates(classes, s), "candidates")
    picked = classes.join(chosen, "cls").select(F.col("of.doc_id").alias("at"), F.col("of.t").alias("of_t"))
    sets = materialise(_full_sets(own, picked, s), "sets")
    release(chosen)
    links = _links(sets, s)
    release(sets)
    label = components(reduce(DataFrame.union, links))
    release(*links)
    # written, so that the joins with a hot label or class can be split
    named = classes.select("cls", "least_id").join(label.withColumnRenamed("node", "cls"), "cls", "left").select("cls", "least_id", F.coalesce("label", "cls").alias("label"))
    named = materialise(named, "named")
    least = materialise(named.groupBy("label").agg(F.min("least_id").alias("component_id")), "least")
    groups = materialise(named.join(least, "label").select("cls", "component_id"), "groups")
    release(classes, label, named, least)
    out = filled.join(groups, "cls").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    out = out.union(found.where(F.col("cls").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _full_sets(own: DataFrame, picked: DataFrame, s: Settings) -> DataFrame:
    """cls, n, members (sorted) of the picked classes, from the texts that stand for them."""

    def run(batches):
        for batch in batches:
            for _, sizes, value in _sets(batch.column(0), s.shingle):
                yield pa.RecordBatch.from_pydict({"cls": pa.array(_signatures(value, sizes), pa.binary()), "n": pa.array(sizes, pa.int64()), "members": _ragged(value, sizes)})

    texts = own.join(picked, F.col("doc_id").eqNullSafe(F.col("at")) & (F.col("t") == F.col("of_t")), "left_semi").select("text")
    got = texts.mapInArrow(run, "cls binary, n bigint, members array<bigint>").where(F.col("cls").isNotNull())
    return got.dropDuplicates(["cls"])


def op6_neardup(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents: four-word shingles, similarity 0.8 or more.

    One row per row of `documents`; null and empty texts are groups of their own.  See
    near_duplicates for null ids, repeated rows and long texts.
    """
    return near_duplicates(table(spark, sf_dir, "documents"), settings=Settings(shingle=4))
