"""Benchmark decontamination: Wu-Manber search for benchmark word windows in documents.

Texts become sequences of word hashes (A-Z lower-cased, `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`).
The alphabet of the search is the word: a block is two adjacent words.  For each window
length a shift table says how far the search may jump after reading one block, so most
words are never looked at.  A block with shift 0 can end some windows; the bucket of the
hashes of the last and the first block holds those to test, and comparing all words
confirms an occurrence.  All documents of a chunk advance together.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import keyed, table
from .textflat import NON_WORD, chunks, splitmix, words

#: Words of one window.
WINDOW = 10
#: Bytes of item texts that one search pass holds; more items are searched in more passes.
#: The tables take about ten times as much, in the driver and in each worker.
PASS_BYTES = 16 << 20
#: Cells of a shift table, a byte each; cells that blocks share have the least shift.
CELLS = 1 << 20

_MIX = np.uint64(0x9E3779B97F4A7C15)


def _blocks(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of the block that begins at each word; the last ones, of too few words, are of no use."""
    return hashes if size == 1 else splitmix(hashes * _MIX + np.append(hashes[1:], np.uint64(0)))


def _expand(lo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of ranges lo .. lo + n."""
    row = np.repeat(np.arange(len(n)), n)
    return row, lo[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)


@dataclass
class WuManber:
    """Tables for windows of one length: their words' hashes, and which items hold each."""

    length: int
    text: np.ndarray  # word hashes of the items
    at: np.ndarray  # where each distinct window is in `text`, in the order of `keys`
    keys: np.ndarray  # buckets, ascending
    shift: np.ndarray
    cut: np.ndarray  # the items of window k are owners[cut[k] : cut[k + 1]]
    owners: np.ndarray

    @classmethod
    def of(cls, length: int, text: np.ndarray, at: np.ndarray, item: np.ndarray) -> WuManber:
        """From the places of all windows in the items' words, and the item of each."""
        m, b = length, min(2, length)
        whole = np.zeros(len(at), dtype=np.uint64)
        for k in range(m):
            whole = splitmix(whole * _MIX + text[at + k])
        both = np.unique(np.stack((np.unique(whole, return_inverse=True)[1], item)), axis=1)
        _, first = np.unique(whole, return_index=True)
        at, block = at[first], _blocks(text, b)
        shift = np.full(CELLS, m - b + 1, dtype=np.uint8)
        for end in range(b - 1, m):
            np.minimum.at(shift, (block[at + end - b + 1] % np.uint64(CELLS)).astype(np.int64), np.uint8(m - 1 - end))
        keys = splitmix(block[at + m - b] + block[at] * _MIX)
        order = np.argsort(keys, kind="stable")
        ends = np.searchsorted(both[0], np.arange(len(at) + 1))
        n = np.diff(ends)[order]
        _, own = _expand(ends[:-1][order], n)
        return cls(m, text, at[order], keys[order], shift, np.concatenate(([0], np.cumsum(n))), both[1][own])

    def search(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, window) of each occurrence; first: where each document begins, and the end of all."""
        m, b = self.length, min(2, self.length)
        block = _blocks(hashes, b)
        step = self.shift[(block % np.uint64(CELLS)).astype(np.int64)]  # of the block that begins at a word
        i, end = first[:-1] + m - 1, first[1:]
        found = []
        while True:
            inside = i < end
            if not inside.all():
                i, end = i[inside], end[inside]
            if not len(i):
                break
            jump = step[i - b + 1].astype(np.int64)
            found.append(i[jump == 0])
            i = i + np.maximum(jump, 1)
        start = (np.concatenate(found) if found else np.zeros(0, np.int64)) - m + 1
        keys = splitmix(block[start + m - b] + block[start] * _MIX)
        lo = np.searchsorted(self.keys, keys)
        row, window = _expand(lo, np.searchsorted(self.keys, keys, side="right") - lo)
        start, same = start[row], np.ones(len(row), dtype=bool)
        for k in range(m):
            same &= self.text[self.at[window] + k] == hashes[start + k]
        return start[same], window[same]


def searchers(texts: list[str | None], window: int = WINDOW) -> list[WuManber]:
    """One WuManber for each window length, owners being places in `texts`; a text of fewer words is one window."""
    places: dict[int, list] = {}
    held, base = [], 0
    for lo, _, data, offsets in chunks(pa.array(texts, pa.large_string())):
        found = words(data, offsets, NON_WORD)
        held.append(found.hashes())
        length = np.minimum(found.counts, window)
        many = found.counts - length + 1
        for m in np.unique(length[length > 0]).tolist():
            own = np.flatnonzero(length == m)
            row, at = _expand((found.first[:-1] + base)[own], many[own])
            places.setdefault(m, []).append((at, own[row] + lo))
        base += len(found.starts)
    text = np.concatenate(held) if held else np.zeros(0, np.uint64)
    return [WuManber.of(m, text, np.concatenate([x for x, _ in places[m]]), np.concatenate([y for _, y in places[m]])) for m in sorted(places, reverse=True)]


_SPANS = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))


def _item_passes(items: DataFrame, limit: int):
    """(items of a pass, is it the last) one after another: the driver holds one pass."""
    own = items.where(F.col("text").isNotNull()).select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("item"), "text")
    size = own.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    n = max(1, math.ceil(size / limit))
    part = own.withColumn("pass", F.pmod(F.xxhash64("item", "text"), F.lit(n)))
    for k in range(n):
        yield [(r["item"], r["text"]) for r in part.where(F.col("pass") == k).select("item", "text").toArrow().to_pylist()], k == n - 1


def _lists(values: pa.Array, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), values).cast(kind)


def _search_pass(sent, carried: bool, last: bool, keep_text: bool):
    """A mapInArrow function for a broadcast (item ids, list of WuManber); with `carried`, hits of earlier passes come in and are joined."""

    def run(batches):
        names, machines = sent.value
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column(1)):
                found = words(data, offsets, NON_WORD)
                first, hashes, n = found.first, found.hashes(), hi - lo
                change = np.zeros(len(hashes) + 1, dtype=np.int64)
                seen = []
                for machine in machines:
                    start, window = machine.search(hashes, first)
                    np.add.at(change, start, 1)
                    np.add.at(change, start + machine.length, -1)
                    row, at = _expand(machine.cut[window], machine.cut[window + 1] - machine.cut[window])
                    doc = np.searchsorted(first, start[row], side="right") - 1
                    seen.append(np.unique(np.stack((doc, machine.owners[at])), axis=1))
                part = batch.slice(lo, n)
                if carried:
                    for k, spans in enumerate(part.column(2).to_pylist()):
                        for x in spans:
                            change[first[k] + x["lo"]] += 1
                            change[first[k] + x["hi"]] -= 1
                hit = np.cumsum(change[:-1]) > 0
                head = np.concatenate(([True], ~hit[:-1])) if len(hit) else hit
                head[first[:-1][first[:-1] < len(hit)]] = True
                tail = np.concatenate((~hit[1:], [True])) if len(hit) else hit
                tail[first[1:][first[1:] > 0] - 1] = True
                begin, stop = np.flatnonzero(hit & head), np.flatnonzero(hit & tail) + 1
                doc = np.searchsorted(first, begin, side="right") - 1
                spans = pa.StructArray.from_arrays([pa.array(begin - first[doc]), pa.array(stop - first[doc])], ["lo", "hi"])
                items = part.column(3).to_pylist() if carried else [[] for _ in range(n)]
                for k, item in np.concatenate(seen, axis=1).T.tolist() if seen else ():
                    items[k].append(names[item])
                out = {"doc_id": part.column(0)}
                if keep_text:
                    out["text"] = part.column(1)
                if last:
                    out["n_words"] = pa.array(found.counts, pa.int64())
                yield pa.RecordBatch.from_pydict(out | {"spans": _lists(spans, np.bincount(doc, minlength=n), _SPANS), "items": pa.array([sorted(set(x)) for x in items], pa.list_(pa.string()))})

    return run


def find_contamination(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, pass_bytes: int = PASS_BYTES, keep_text: bool = False) -> DataFrame:
    """Occurrences of item windows in documents.

    Returns a row per row of docs: doc_id, n_words, spans (disjoint word spans
    [lo, hi) inside occurrences), items (sorted distinct item ids, as strings); with
    `keep_text` the text too, so a filter needs no join.

    Nulls and empty texts have no words and no hits; a text of any length is searched
    whole.  Null item texts are ignored; a null item id is the empty string.  Null and
    repeated ids of documents are as good as any: each row gets a result, and items of
    one id are one.  Without documents there are no rows; without items nothing is hit.
    Items are a query set: their size is measured, and beyond `pass_bytes` they are
    searched in several passes over the documents, so memory stays bounded.
    """
    own = keyed(docs, id_col, text_col)
    kind = own.schema["doc_id"].dataType.simpleString()
    found = "spans array<struct<lo:bigint,hi:bigint>>, items array<string>"
    for k, (held, last) in enumerate(_item_passes(keyed(items, item_id, item_text), pass_bytes)):
        tables = [item for item, _ in held], searchers([text for _, text in held], window)
        sent = docs.sparkSession.sparkContext.broadcast(tables)  # bounded by pass_bytes
        step = _search_pass(sent, k > 0, last, keep_text or not last)
        names = f"doc_id {kind}{', text string' if keep_text or not last else ''}{', n_words bigint' if last else ''}, {found}"
        own = own.mapInArrow(step, names).select("doc_id", "text", "spans", "items") if not last else own.mapInArrow(step, names)
    return own


def decontaminate(docs: DataFrame, items: DataFrame, *, text_col: str = "text", min_hit_words: int = 1, **options) -> DataFrame:
    """docs without the rows that hold benchmark windows; all columns stay.

    A row goes if at least `min_hit_words` of its words are inside occurrences.  Rows are
    tested one by one, so null or repeated ids do no harm.
    """
    names = docs.columns
    rest = [c for c in names if c != text_col]
    packed = docs.select(F.struct(*(rest or [F.lit(0).alias("none")])).alias("doc_id"), F.col(text_col).alias("text"))
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda total, x: total + x["hi"] - x["lo"])
    found = find_contamination(packed, items, keep_text=True, **options)
    return found.where(hit < min_hit_words).select(*[F.col("text").alias(c) if c == text_col else F.col("doc_id")[c].alias(c) for c in names])


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Benchmark windows in all documents: one row per row of `documents`, null texts without words.

    See find_contamination.
    """
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda total, x: total + x["hi"] - x["lo"])
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )
