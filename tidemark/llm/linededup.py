"""Line dedup across documents by pairwise alignment.

Equal texts are one class, the copy with the least id being the first; later copies align
with it as a whole.  Among the classes, the hash of a line that has the words of a block,
or of a run of lines that just reaches them, pairs each later holder with the first one:
never more than three pairs a line, however many hold it, and together these partners
share every block that any earlier document does.  Each pair is aligned by patience diff,
moved blocks by their first shared run, and common blocks of enough words are deleted from
the later document.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import materialise, release, table
from .textflat import _powers, chunks, splitmix, words

#: Words that a common block needs to be deleted.
BLOCK_WORDS = 8


def line_hashes(texts: pa.Array):
    """For each chunk: first row, lines of each row, hash and word count of every line.

    Lines end at \\n; two lines are equal if their words are, so blanks do not count.  A
    line without words has hash 0.
    """
    for lo, _, data, offsets in chunks(texts):
        found = words(data, offsets, lower=False)
        ends = np.flatnonzero(data == 10)
        before = np.searchsorted(ends, offsets)
        per_row = np.diff(before) + 1
        line = np.searchsorted(ends, found.starts) + found.row
        total = int(per_row.sum())
        counts = np.bincount(line, minlength=total)
        power, inverse = _powers(len(found.starts) + 1)
        sums = np.zeros(len(found.starts) + 1, dtype=np.uint64)
        np.cumsum(found.hashes() * power[: len(found.starts)], out=sums[1:])
        stop = np.cumsum(counts)
        start = stop - counts
        hashes = splitmix((sums[stop] - sums[start]) * inverse[start] + counts.astype(np.uint64))
        hashes[counts == 0] = 0
        yield lo, per_row, hashes.view(np.int64), counts


def run_hashes(hashes: np.ndarray, counts: np.ndarray, per_row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first line, number of lines) of the runs of lines that just reach BLOCK_WORDS, in the order of first lines.

    One such run at most begins, and one ends, at each line that has words; a line of
    enough words is a run by itself.  So every line with words of a common block of enough
    words is in a run within the block.
    """
    stop = np.cumsum(counts)
    ends = np.cumsum(per_row)
    row = np.repeat(np.arange(len(per_row)), per_row)
    last = np.searchsorted(stop, stop - counts + BLOCK_WORDS)
    begins = np.flatnonzero((counts > 0) & (last < ends[row]))
    back = np.searchsorted(stop - counts, stop - BLOCK_WORDS, side="right") - 1
    final = np.flatnonzero((counts > 0) & (back >= (ends - per_row)[row]))
    first = np.concatenate((begins, back[final]))
    size = np.concatenate((last[begins] + 1 - begins, final + 1 - back[final]))
    both = np.unique(first << 32 | size)
    first, size = both >> 32, both & 0xFFFFFFFF
    power, inverse = _powers(len(counts) + 1)
    sums = np.zeros(len(counts) + 1, dtype=np.uint64)
    np.cumsum(hashes.view(np.uint64) * power[: len(counts)], out=sums[1:])
    found = splitmix((sums[first + size] - sums[first]) * inverse[first] + size.astype(np.uint64))
    return found.view(np.int64), first, size


def _anchors(a: list, b: list, a_lo: int, a_hi: int, b_lo: int, b_hi: int) -> list[tuple[int, int]]:
    """Lines that occur once in either range, as the longest sequence that ascends in both.

    Without such lines, the k-th occurrences of a line are paired instead.
    """
    once: dict = {}
    for i in range(a_lo, a_hi):
        once[a[i]] = -1 if a[i] in once else i
    there: dict = {}
    for j in range(b_lo, b_hi):
        there[b[j]] = -1 if b[j] in there else j
    pairs = [(i, there[x]) for x, i in once.items() if i >= 0 and there.get(x, -1) >= 0]
    if not pairs:
        places: dict = {}
        for j in range(b_hi - 1, b_lo - 1, -1):
            places.setdefault(b[j], []).append(j)
        pairs = [(i, places[a[i]].pop()) for i in range(a_lo, a_hi) if places.get(a[i])]
    pairs.sort()
    tails: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for k, (_, j) in enumerate(pairs):
        p = bisect_left(tails, j)
        back.append(at[p - 1] if p else -1)
        if p == len(tails):
            tails.append(j)
            at.append(k)
        else:
            tails[p], at[p] = j, k
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned equal lines (index in a, index in b), ascending, by patience diff."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a_lo, a_hi, b_lo, b_hi = todo.pop()
        while a_lo < a_hi and b_lo < b_hi and a[a_lo] == b[b_lo]:
            out.append((a_lo, b_lo))
            a_lo, b_lo = a_lo + 1, b_lo + 1
        while a_lo < a_hi and b_lo < b_hi and a[a_hi - 1] == b[b_hi - 1]:
            a_hi, b_hi = a_hi - 1, b_hi - 1
            out.append((a_hi, b_hi))
        if a_lo == a_hi or b_lo == b_hi:
            continue
        last = (a_lo, b_lo)
        anchors = _anchors(a, b, a_lo, a_hi, b_lo, b_hi)
        for i, j in anchors:
            out.append((i, j))
            todo.append((last[0], i, last[1], j))
            last = (i + 1, j + 1)
        if anchors:
            todo.append((last[0], a_hi, last[1], b_hi))
    return sorted(out)


def common_blocks(a: list, b: list, sizes: list, a_runs: dict, b_runs: list[tuple[int, int, int]], least: int = BLOCK_WORDS) -> list[int]:
    """Lines of b in aligned common blocks of `least` words or more; sizes: words of b's lines.

    a_runs: first line by hash; b_runs: (hash, first line, lines).  A shared run that the
    alignment leaves out, as it stands elsewhere in a, is an anchor of its own: the block
    around it goes too.
    """
    gone: set[int] = set()
    run: list[int] = []
    before = None
    for i, j in [*patience(a, b), (-9, -9)]:
        if before is not None and (i, j) != (before[0] + 1, before[1] + 1):
            if sum(sizes[x] for x in run) >= least:
                gone.update(run)
            run = []
        run.append(j)
        before = (i, j)
    for h, j, n in b_runs:
        i = a_runs.get(h, -1)
        if i < 0 or (j in gone and j + n - 1 in gone and all(x in gone for x in range(j, j + n))) or a[i : i + n] != b[j : j + n]:
            continue
        lo, hi = j, j + n
        while lo and i + lo - j and a[i + lo - j - 1] == b[lo - 1]:
            lo -= 1
        while hi < len(b) and i + hi - j < len(a) and a[i + hi - j] == b[hi]:
            hi += 1
        gone.update(range(lo, hi))
    return sorted(gone)


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values of all lists, length of each)."""
    return np.asarray(column.flatten()), np.diff(np.asarray(column.offsets))


def _align(batches):
    """(t, a, a_sizes, b, sizes) to (t, lines): what the alignment with a deletes from b."""
    for batch in batches:
        held = []
        for k in (1, 3):
            (hashes, per_row), (counts, _) = _lists(batch.column(k)), _lists(batch.column(k + 1))
            found, first, size = run_hashes(hashes, counts, per_row)
            base = np.concatenate(([0], np.cumsum(per_row)))
            cut = np.searchsorted(first, base)
            row = np.repeat(np.arange(len(per_row)), np.diff(cut))
            held.append((cut.tolist(), found.tolist(), (first - base[row]).tolist(), size.tolist()))
        (ac, ah, af, _), (bc, bh, bf, bs) = held
        lines = []
        for k, (a, b, sizes) in enumerate(zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)):
            x, y = slice(ac[k], ac[k + 1]), slice(bc[k], bc[k + 1])
            lines.append(common_blocks(a, b, sizes, dict(zip(ah[x][::-1], af[x][::-1])), list(zip(bh[y], bf[y], bs[y]))))
        yield pa.RecordBatch.from_pydict({"t": batch.column(0), "lines": pa.array(lines, pa.list_(pa.int32()))})


def blanks_between(lines: list[int], sizes: list[int]) -> list[int]:
    """Deleted lines with words, and the blank lines that only they surround."""
    own = sorted({x for x in lines if sizes[x]})
    out = []
    for x, following in zip(own, [*own[1:], -1]):
        out.append(x)
        if following > x + 1 and not any(sizes[x + 1 : following]):
            out += range(x + 1, following)
    return out


def _settle(batches):
    """(t, id, lines or null, sizes) to (t, id, lines)."""
    for batch in batches:
        found = [blanks_between(lines or [], sizes) for lines, sizes in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_pydict({"t": batch.column(0), "id": batch.column(1), "lines": pa.array(found, pa.list_(pa.int32()))})


def repeated_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows: doc_id, t, n_lines, n_words; deleted: t, id, lines) where t is a text's digest.

    `lines` are the positions to delete from the class's first document (id); every other
    row of the class is a later copy.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    own = own.select("doc_id", F.unhex(F.md5(F.col("text").cast("binary"))).alias("t"), "text")
    kind = own.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for lo, per_row, hashes, counts in line_hashes(batch.column(2)):
                ends = pa.array(np.concatenate(([0], np.cumsum(per_row))).astype(np.int32))
                part = batch.slice(lo, len(per_row))
                found, first, _ = run_hashes(hashes, counts, per_row)
                run_ends = pa.array(np.searchsorted(first, np.concatenate(([0], np.cumsum(per_row)))).astype(np.int32))
                yield pa.RecordBatch.from_pydict({"doc_id": part.column(0), "t": part.column(1), "runs": pa.ListArray.from_arrays(run_ends, pa.array(found)), "hashes": pa.ListArray.from_arrays(ends, pa.array(hashes)), "sizes": pa.ListArray.from_arrays(ends, pa.array(counts.astype(np.int32)))})

    rows = materialise(own.mapInArrow(run, f"doc_id {kind}, t binary, runs array<bigint>, hashes array<bigint>, sizes array<int>"), "lines")
    classes = materialise(rows.groupBy("t").agg(F.min("doc_id").alias("id"), F.min("runs").alias("runs"), F.min("hashes").alias("hashes"), F.min("sizes").alias("sizes")), "classes")
    held = classes.select("t", "id", F.explode(F.array_distinct("runs")).alias("h"))
    # written, so that the join with a hot line's holders can be split
    shared = materialise(held.groupBy("h").agg(F.count("*").alias("df"), F.min(F.struct("id", "t")).alias("first")).where("df > 1").select("h", F.col("first.t").alias("owner")), "held")
    pairs = held.join(shared, "h").where(F.col("t") != F.col("owner")).select("t", "owner").distinct()
    a = classes.select(F.col("t").alias("owner"), F.col("hashes").alias("a"), F.col("sizes").alias("a_sizes"))
    b = classes.select("t", F.col("hashes").alias("b"), "sizes")
    aligned = pairs.join(b, "t").join(a, "owner").select("t", "a", "a_sizes", "b", "sizes").mapInArrow(_align, "t binary, lines array<int>")
    aligned = aligned.groupBy("t").agg(F.array_distinct(F.flatten(F.collect_list("lines"))).alias("lines"))
    id_kind = classes.schema["id"].dataType.simpleString()
    settled = classes.select("t", "id", "sizes").join(aligned, "t", "left").select("t", "id", "lines", "sizes").mapInArrow(_settle, f"t binary, id {id_kind}, lines array<int>")
    deleted = materialise(settled, "deleted", batch_rows=500)  # so a join with a hot text's copies can be split
    release(shared, classes)
    total = F.aggregate("sizes", F.lit(0), lambda a, x: a + x)
    return rows.select("doc_id", "t", F.size("hashes").alias("n_lines"), total.alias("n_words")), deleted


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with deleted lines taken out of the text, and a column `removed_lines` of their positions.

    A line with words goes if it is in consecutive lines of BLOCK_WORDS words or more that
    an earlier text holds too; blank lines go where all lines around them do.  Of several
    documents that share a block, the one with the least id keeps it (a text that only
    rows without an id have comes before all others; of equal ids the least digest).  A
    text that an earlier row holds in full loses all its lines if it has BLOCK_WORDS words
    or more; rows equal in id and text stay as they are.  Null texts stay null, empty ones
    empty, and the longest text is aligned whole.  Other columns are untouched, an existing
    removed_lines is replaced.  An empty table gives no rows.
    """
    _, deleted = repeated_lines(docs, id_col=id_col, text_col=text_col)
    names = [c for c in docs.columns if c != "removed_lines"]
    text = F.col(f"row.{text_col}").cast("string")
    own = docs.select(F.struct(*names).alias("row"), F.unhex(F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"))).alias("t"))
    own = own.join(deleted, "t", "left")
    lines = F.split(text, "\n", -1)
    long = F.size(F.array_remove(F.split(F.regexp_replace(text, "[\\x20\\x09-\\x0D]+", " "), " "), "")) >= BLOCK_WORDS
    copy = ~F.col(f"row.{id_col}").eqNullSafe(F.col("id"))
    gone = F.when(text.isNull(), F.array().cast("array<int>")).when(copy & long, F.sequence(F.lit(0), F.size(lines) - 1)).otherwise(F.when(copy, F.array().cast("array<int>")).otherwise(F.col("lines")))
    own = own.withColumn("removed_lines", gone)
    left = F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("removed_lines")), lambda i: F.get(lines, i)), "\n")
    new = F.when(text.isNull() | (F.size("removed_lines") == 0), text).otherwise(left)
    return own.select(*[(new if c == text_col else F.col(f"row.{c}")).alias(c) for c in names], "removed_lines")


def op7_linededup(spark, sf_dir: str) -> DataFrame:
    """Lines deleted from each document, and the digest of what is left.

    One row per row of `documents`; a null text loses nothing and counts as empty in the
    digest.  See dedup_lines for ties, repeated rows and long texts.
    """
    found = dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.size("removed_lines").cast("bigint").alias("n_removed"), F.array_join(F.col("removed_lines").cast("array<string>"), ",").alias("removed_lines"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))
