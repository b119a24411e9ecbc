"""Quality classifier: nearest-neighbour voting among labelled latent-semantic vectors.

Terms are hashed words and word shapes (case, signs, digits, length, repetition).  Inverse
document frequencies come from all documents.  A bounded, documented number of labelled
rows of each class is weighted, factored by truncated SVD and broadcast as unit vectors;
every document's exact cosine with each of them is computed block by block, and its
nearest neighbours vote, weighted by similarity and by the share of their class.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import held_out, keyed, table
from .textflat import chunks, words

#: Cells of hashed words; word shapes; latent dimensions.
WORD_CELLS, SHAPES, RANK = 4096, 512, 48
TERMS = WORD_CELLS + SHAPES
#: Labelled rows of each class that are learned from, at most; neighbours that vote.
SAMPLE, NEIGHBOURS = 2000, 25
#: Share of the weight of a word's cell against a shape's.
WORD_WEIGHT = 0.35

_CLASS = np.zeros(256, dtype=np.uint8)  # 1 upper, 2 lower or beyond ASCII, 3 digit, 4 symbol, 5 other sign
_CLASS[33:127] = 5
_CLASS[65:91] = 1
_CLASS[97:123] = _CLASS[128:] = 2
_CLASS[48:58] = 3
_CLASS[[ord(c) for c in "#*$%&|<>@_=~^\\{}"]] = 4


def term_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(rows, TERMS) counts of word cells and of word shapes."""
    found = words(data, offsets, lower=False)
    n = len(offsets) - 1
    out = np.zeros((n, TERMS), dtype=np.float32)
    if not len(found.starts):
        return out
    kind, row = _CLASS[data], found.row
    has = []
    for k in range(1, 6):
        total = np.concatenate(([0], np.cumsum(kind == k, dtype=np.int32)))
        has.append(total[found.ends] - total[found.starts])
    upper, lower, digit, symbol, sign = has
    size = found.ends - found.starts
    own = words(data, offsets)
    hashes = own.hashes()
    same = np.zeros(len(hashes), dtype=bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    length = np.digitize(size, [3, 7, 13])
    shape = np.zeros(len(hashes), dtype=np.int64)
    for bit in ((upper > 1) & (lower == 0), (upper > 0) & (lower > 0), digit > 0, symbol > 0, sign > 1, (lower + upper) == 0, same):
        shape = shape * 2 + bit
    shape = shape * 4 + length
    cell = (hashes % np.uint64(WORD_CELLS)).astype(np.int64)
    both = np.concatenate((row * TERMS + cell, row * TERMS + WORD_CELLS + shape))
    return np.bincount(both, minlength=n * TERMS).reshape(n, TERMS).astype(np.float32)


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit rows of log-damped shares; a row without terms is zero."""
    n = np.maximum(1, counts[:, WORD_CELLS:].sum(axis=1, keepdims=True))
    x = np.log1p(1000 * counts / n) * idf
    return x / np.maximum(1e-9, np.linalg.norm(x, axis=1, keepdims=True))


@dataclass
class Model:
    idf: np.ndarray
    axes: np.ndarray  # (TERMS, RANK)
    vectors: np.ndarray  # (labelled rows, RANK), unit rows
    labels: np.ndarray
    votes: np.ndarray  # weight of a row's vote, so that classes weigh as in the corpus

    def project(self, counts: np.ndarray) -> np.ndarray:
        x = weighted(counts, self.idf) @ self.axes
        return x / np.maximum(1e-9, np.linalg.norm(x, axis=1, keepdims=True))

    def score(self, counts: np.ndarray) -> np.ndarray:
        """Weighted share of label 1 among the nearest rows; 0 for texts without a word."""
        x = self.project(counts)
        out = np.zeros(len(x))
        k = min(NEIGHBOURS, len(self.labels))
        for lo in range(0, len(x), 512):
            cosine = x[lo : lo + 512] @ self.vectors.T
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k] if k < cosine.shape[1] else np.tile(np.arange(k), (len(cosine), 1))
            w = np.maximum(np.take_along_axis(cosine, near, axis=1), 1e-6) ** 8 * self.votes[near]
            out[lo : lo + 512] = (w * self.labels[near]).sum(axis=1) / w.sum(axis=1)
        out[counts[:, WORD_CELLS:].sum(axis=1) == 0] = 0.0
        return np.clip(out, 0.0, 1.0)


def document_frequencies(docs: DataFrame, *, text_col: str = "text") -> np.ndarray:
    """idf of each term over all rows; a fixed number of sums reaches the driver."""

    def count(batches):
        total = np.zeros(TERMS + 1, dtype=np.int64)
        for batch in batches:
            for _, _, data, offsets in chunks(batch.column(0)):
                total[:TERMS] += (term_counts(data, offsets) > 0).sum(axis=0)
                total[TERMS] += len(offsets) - 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"at": pa.array(at, pa.int32()), "n": pa.array(total[at], pa.int64())})

    own = docs.select(F.col(text_col).cast("string").alias("text"))
    total = np.zeros(TERMS + 1)
    for r in own.mapInArrow(count, "at int, n bigint").groupBy("at").agg(F.sum("n").alias("n")).collect():
        total[r["at"]] = r["n"]
    idf = np.log((1 + total[TERMS]) / (1 + total[:TERMS])) + 0.1
    idf[:WORD_CELLS] *= WORD_WEIGHT
    return idf.astype(np.float32)


def train(docs: DataFrame, labels: DataFrame, idf: np.ndarray, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Model | None:
    """Fit on at most `sample` rows of each class, those with the least hash of the id.

    Rows without a label are left out; of an id with several labels the greatest counts.
    """
    marked = labels.select(F.col(id_col).alias("doc_id"), (F.col(label_col) == 1).cast("int").alias("y")).where("doc_id IS NOT NULL AND y IS NOT NULL").groupBy("doc_id").agg(F.max("y").alias("y"))
    share = {r["y"]: r["n"] for r in marked.groupBy("y").agg(F.count("*").alias("n")).collect()}
    picked = [marked.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for y in (0, 1)]
    texts = keyed(docs, id_col, text_col).join(F.broadcast(picked[0].union(picked[1])), "doc_id")  # 2 * sample ids at most

    def count(batches):
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column(0)):
                counts = term_counts(data, offsets)
                row, col = np.nonzero(counts)
                cut = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=hi - lo)))).astype(np.int32)
                yield pa.RecordBatch.from_pydict({
                    "y": batch.column(1).slice(lo, hi - lo),
                    "order": batch.column(2).slice(lo, hi - lo),
                    "terms": pa.ListArray.from_arrays(pa.array(cut), pa.array(col.astype(np.int32))),
                    "n": pa.ListArray.from_arrays(pa.array(cut), pa.array(counts[row, col])),
                })

    rows = texts.select("text", "y", F.xxhash64("doc_id", "text").alias("order")).mapInArrow(count, "y int, `order` bigint, terms array<int>, n array<float>")
    rows = sorted(rows.collect(), key=lambda r: (r["order"], r["y"]))
    if not rows:
        return None
    x = np.zeros((len(rows), TERMS), dtype=np.float32)
    for k, r in enumerate(rows):
        x[k, r["terms"]] = r["n"]
    y = np.array([r["y"] for r in rows])
    unit = weighted(x, idf)
    rank = min(RANK, *unit.shape)
    probe = np.random.default_rng(7).normal(size=(TERMS, min(rank + 16, len(rows)))).astype(np.float32)
    basis, _ = np.linalg.qr(unit @ probe)
    for _ in range(4):
        basis, _ = np.linalg.qr(unit @ (unit.T @ basis))
    _, _, axes = np.linalg.svd(basis.T @ unit, full_matrices=False)
    votes = np.array([share[k] / max(1, (y == k).sum()) for k in y])
    model = Model(idf, np.ascontiguousarray(axes[:rank].T), np.zeros((0, rank)), y.astype(float), votes / votes.sum())
    model.vectors = model.project(x)
    return model


def score_quality(docs: DataFrame, model: Model | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted for each row of docs.

    score is in [0, 1]; null and empty texts, and all texts under an empty model, have 0.
    A text of any length counts whole.  Of neighbours that are equally near at the last
    place some vote and some do not.  Null and repeated ids are as good as any: each row
    gets a row; an empty table gives none.
    """
    own = keyed(docs, id_col, text_col)
    kind = own.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column(1)):
                score = np.zeros(hi - lo) if sent.value is None else sent.value.score(term_counts(data, offsets))
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).slice(lo, hi - lo), "score": pa.array(score, pa.float64()), "predicted": pa.array((score >= 0.5).astype(np.int32))})

    return own.mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def op5_knn_quality(spark, sf_dir: str) -> DataFrame:
    """Quality of all documents, learned from labelled rows whose crc32(doc_id) mod 3 is not 1.

    One row per row of `documents`; null and empty texts have score 0.  See score_quality.
    """
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = held_out(F.col("doc_id"), 3)
    model = train(docs, labels.where(~held), document_frequencies(docs))
    return score_quality(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")
