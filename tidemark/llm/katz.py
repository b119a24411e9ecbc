"""Katz backoff language model over words, counted and scored in partitioned tables.

The model is a bigram over plain words.  A bigram seen in training has its Good-Turing
discounted count over its history's; else the history's backoff weight times the word's
unigram probability, which is a discounted count again or, for a word never seen, the
Good-Turing mass of one unseen type.  Each history's weight is what its discounted
successors leave, over the unigram mass of the words not seen after it, so every
history's probabilities sum to one.  The vocabulary is every word of the training texts,
at any corpus size.  Neither the driver nor a broadcast holds anything per word.

1. Texts become blocks of word-hash streams (a table; a block is bounded in tokens).
2. The blocks' distinct words with their training counts are dealt to parts by hash; a
   part has each of its words' total count and returns it to the blocks.
3. The same for bigrams, dealt by the hash of the pair, so a frequent history is in all
   parts.  The part also tells one block of each bigram that it stands for it.
4. A block adds up, for each of its histories, the bigrams that it stands for.  These sums
   meet by the hash of the history and return to the blocks as divisor and weight.
5. A block then has all that its documents' scores need.

A part gets one row of packed keys from a block, so never more rows than a block has
distinct keys, and a frequent word or pair is one key of each block.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import keyed, materialise, release, summed, table
from .textflat import chunks, splitmix, words

#: Counts up to this are discounted.
DISCOUNTED = 5
#: Tokens and documents of one block, and about how many tokens a part has.
BLOCK_TOKENS, BLOCK_DOCS, PART_TOKENS = 1_000_000, 60_000, 4_000_000
#: Places of the end and the start in a block's vocabulary, and their hashes; its words follow.
END, START, FIRST = range(3)


def _blob(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def _squeezed(x: np.ndarray) -> bytes:
    """Compressed byte planes: of small numbers most are zero."""
    return zlib.compress(_blob(x.view(np.uint8).reshape(-1, x.itemsize).T), 1)


def _loosened(data: bytes, kind) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(data), dtype=np.uint8).reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def _rows(**columns) -> pa.RecordBatch:
    kinds = {"block": pa.int64(), "part": pa.int32(), "kind": pa.string()}
    return pa.RecordBatch.from_pydict({k: pa.array(v, kinds.get(k, pa.binary())) for k, v in columns.items()})


def token_blocks(own: DataFrame) -> DataFrame:
    """Blocks of (doc_id, text, held): ids, held flags, word counts, distinct word hashes, word stream."""
    kind = own.schema["doc_id"].dataType.simpleString()

    def run(batches):
        held_rows: list = []
        tokens = docs = number = 0
        task = TaskContext.get().partitionId()

        def block():
            nonlocal held_rows, tokens, docs, number
            ids = pa.concat_arrays([x[0] for x in held_rows])
            counts = np.concatenate([x[2] for x in held_rows])
            unique, stream = np.unique(np.concatenate([x[3] for x in held_rows]), return_inverse=True)
            ends = pa.array([0, len(ids)], pa.int32())
            out = pa.RecordBatch.from_pydict({
                "block": pa.array([task << 32 | number], pa.int64()),
                "ids": pa.ListArray.from_arrays(ends, ids),
                "held": pa.array([_blob(np.concatenate([x[1] for x in held_rows]))], pa.binary()),
                "counts": pa.array([_blob(counts.astype(np.int32))], pa.binary()),
                "words": pa.array([_blob(unique)], pa.binary()),
                "stream": pa.array([_blob(stream.astype(np.int32))], pa.binary()),
            })
            held_rows, tokens, docs, number = [], 0, 0, number + 1
            return out

        for batch in batches:
            held = np.array(batch.column(2).to_pylist(), dtype=bool)
            for lo, hi, data, offsets in chunks(batch.column(1)):
                found = words(data, offsets)
                if held_rows and (tokens + len(found.starts) > BLOCK_TOKENS or docs + hi - lo > BLOCK_DOCS):
                    yield block()
                held_rows.append((batch.column(0).slice(lo, hi - lo), held[lo:hi], found.counts, found.hashes()))
                tokens, docs = tokens + len(found.starts), docs + hi - lo
        if held_rows:
            yield block()

    shape = f"block bigint, ids array<{kind}>, held binary, counts binary, words binary, stream binary"
    return own.mapInArrow(run, shape)


def _deal(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The order that puts keys by part, and where in it each part begins."""
    part = (splitmix(keys) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(parts + 1))


def _shares(order: np.ndarray, cut: np.ndarray):
    """Each part that has keys, and where these are."""
    for p in np.flatnonzero(np.diff(cut)).tolist():
        yield p, order[cut[p] : cut[p + 1]]


def good_turing(n: dict[int, float]) -> np.ndarray:
    """Katz discounts d[r], r = 0..DISCOUNTED, from counts of counts; 1 where the counts do not give one in (0, 1)."""
    k = DISCOUNTED
    out = np.ones(k + 1)
    n1, far = n.get(1, 0), n.get(k + 1, 0)
    common = (k + 1) * far / n1 if n1 else 1.0
    for r in range(1, k + 1):
        if n.get(r, 0) and n.get(r + 1, 0) and common < 1:
            d = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common)
            out[r] = d if 0 < d < 1 else 1.0
    return out


def _discounted(counts: np.ndarray, d: np.ndarray) -> np.ndarray:
    return counts * np.where(counts <= DISCOUNTED, d[np.minimum(counts, DISCOUNTED)], 1.0)


@dataclass
class Unigrams:
    total: int  # training tokens, ends included
    texts: int  # training documents, so also how often the end occurs
    types: int  # the end included
    discounts: np.ndarray
    scale: float  # what discounted counts are divided by
    unseen: float  # probability of the unseen type

    def probability(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, _discounted(counts, self.discounts) / self.scale, self.unseen)


def unigram_model(n: dict[int, float], total: int, texts: int, types: int) -> Unigrams:
    """From counts of counts of all types; the unseen type has at least half a token."""
    if not total:
        return Unigrams(0, 0, 0, np.ones(DISCOUNTED + 1), 1.0, 1.0)
    d = good_turing(n)
    lost = sum(r * n.get(r, 0) * (1 - d[r]) for r in range(1, DISCOUNTED + 1))
    scale = total if lost >= 0.5 else total - lost + 0.5
    return Unigrams(total, texts, types, d, scale, 1 - (total - lost) / scale)


def backoff(history: np.ndarray, kept: np.ndarray, covered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(divisor of discounted counts, backoff weight) per history; (1, 1) for one never seen.

    history: its count; kept: its discounted counts; covered: unigram probability of its
    seen successors, which is below 1 as the unseen type has a share.
    """
    scale = np.where(history - kept >= 0.5, history, kept + 0.5)
    scale = np.where(history > 0, scale, 1.0)
    return scale, np.where(history > 0, (1 - kept / scale) / (1 - covered), 1.0)


class _Pairs:
    """A block's words, end and start included, and its distinct bigrams."""

    def __init__(self, r: dict, texts: int):
        self.counts = np.frombuffer(r["counts"], dtype=np.int32).astype(np.int64)
        self.held = np.frombuffer(r["held"], dtype=bool)
        self.hashes = np.concatenate((np.array([END, START], np.uint64), np.frombuffer(r["words"], dtype=np.uint64)))
        #: training counts as a history: the start precedes each text, nothing follows the end
        self.known = np.concatenate(([texts, texts], np.frombuffer(r["known"], dtype=np.int64)))
        counts, n = self.counts, len(self.counts)
        self.doc = np.repeat(np.arange(n), counts + 1)
        place = np.arange(len(self.doc)) - np.repeat(np.cumsum(counts) - counts + np.arange(n), counts + 1)
        end = place == counts[self.doc]
        target = np.full(len(self.doc), END, dtype=np.int64)
        target[~end] = np.frombuffer(r["stream"], dtype=np.int32) + FIRST
        history = np.concatenate(([START], target[:-1]))
        history[place == 0] = START
        pairs, self.stream = np.unique(history << 32 | target, return_inverse=True)
        self.a, self.b = pairs >> 32, pairs & 0xFFFFFFFF
        self.keys = splitmix(splitmix(self.hashes[self.a] + np.uint64(0x9E3779B97F4A7C15)) + self.hashes[self.b])

    def trained(self) -> np.ndarray:
        return np.bincount(self.stream[~self.held[self.doc]], minlength=len(self.keys)).astype(np.int32)


def _merged(group: pa.Table, flagged: bool) -> tuple[np.ndarray, pa.Table]:
    """A part's distinct training counts, and rows that return each block its keys' counts.

    With `flagged`, twice the count, plus one for the row that stands for the key.
    """
    keys = np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in group["keys"]])
    trained = np.concatenate([_loosened(x.as_py(), np.int32) for x in group["trained"]])
    _, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
    counts = np.bincount(inverse, weights=trained, minlength=len(first)).astype(np.int64)
    found = counts[inverse]
    if flagged:
        found *= 2
        found[first[counts > 0]] += 1
    cut = np.cumsum([0, *(len(x.as_py()) // 8 for x in group["keys"])])
    n, part = len(cut) - 1, group["part"][0].as_py()
    stat = np.bincount(np.minimum(counts, DISCOUNTED + 2), minlength=DISCOUNTED + 3)
    return counts, pa.Table.from_batches([_rows(kind=[*["back"] * n, "stat"], part=[part] * (n + 1), block=[*group["block"].to_pylist(), -1], data=[*(_squeezed(found[a:b]) for a, b in zip(cut, cut[1:])), _blob(stat.astype(np.int64))])])


_DEALT = "part int, block bigint, keys binary, trained binary"
_BACK = "kind string, part int, block bigint, data binary"


def _returned(rows: list[tuple[int, bytes]], order: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """What the parts sent back for a block's keys, in the order of the keys."""
    out = np.zeros(len(order), dtype=np.int64)
    for p, data in rows:
        out[order[cut[p] : cut[p + 1]]] = _loosened(data, np.int64)
    return out


def _word_parts(blocks: DataFrame, parts: int) -> DataFrame:
    """Training counts back to the blocks, and a part's counts of counts."""

    def deal(batches):
        for batch in batches:
            for r in batch.to_pylist():
                keys = np.frombuffer(r["words"], dtype=np.uint64)
                train = np.repeat(~np.frombuffer(r["held"], dtype=bool), np.frombuffer(r["counts"], dtype=np.int32))
                trained = np.bincount(np.frombuffer(r["stream"], dtype=np.int32)[train], minlength=len(keys)).astype(np.int32)
                for p, k in _shares(*_deal(keys, parts)):
                    yield _rows(part=[p], block=[r["block"]], keys=[_blob(keys[k])], trained=[_squeezed(trained[k])])

    return blocks.select("block", "held", "counts", "words", "stream").mapInArrow(deal, _DEALT).groupBy("part").applyInArrow(lambda group: _merged(group, False)[1], _BACK)


def _record(row: pa.Table | pa.RecordBatch) -> dict:
    """A block's row as bytes."""
    r = {c: row[c][0].as_py() for c in ("held", "counts", "words", "stream")}
    return r | {c: _blob(_loosened(row[c][0].as_py(), np.int64)) for c in ("known", "seen") if c in row.schema.names}


def _records(batches):
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch["block"][k].as_py(), _record(batch.slice(k, 1))


def _bigram_parts(blocks: DataFrame, texts: int, parts: int) -> DataFrame:
    """The same for bigrams, with the flags of the blocks that stand for them."""

    def deal(batches):
        for block, r in _records(batches):
            x = _Pairs(r, texts)
            trained = x.trained()
            for p, k in _shares(*_deal(x.keys, parts)):
                yield _rows(part=[p], block=[block], keys=[_blob(x.keys[k])], trained=[_squeezed(trained[k])])

    return blocks.select("block", "held", "counts", "words", "stream", "known").mapInArrow(deal, _DEALT).groupBy("part").applyInArrow(lambda group: _merged(group, True)[1], _BACK)


def _stats(found: DataFrame) -> dict[int, float]:
    """Counts of counts; the last cell holds all types of higher counts."""

    def count(batches):
        total = np.zeros(DISCOUNTED + 3, dtype=np.int64)
        for batch in batches:
            for x in batch.column(0):
                total += np.frombuffer(x.as_py(), dtype=np.int64)
        return total

    return dict(enumerate(summed(found.where("kind = 'stat'").select("data"), count, DISCOUNTED + 3).tolist()))


def _together(blocks: DataFrame, found: DataFrame):
    """Blocks and the rows that parts sent back to them, by block."""
    names = [c for c in blocks.columns if c != "block"]
    homes = blocks.select("block", F.lit("block").alias("kind"), F.lit(None).cast("int").alias("part"), F.lit(None).cast("binary").alias("data"), *names)
    return homes.union(found.select("block", "kind", "part", "data", *[F.lit(None).cast(blocks.schema[c].dataType).alias(c) for c in names])).groupBy("block")


def _split(group: pa.Table) -> tuple[pa.Table, list[tuple[int, bytes]]]:
    """A block's own row, and (part, data) of what was returned to it."""
    kinds = group["kind"].to_pylist()
    at = kinds.index("block")
    return group.slice(at, 1), [(p, x.as_py()) for k, (p, x) in enumerate(zip(group["part"].to_pylist(), group["data"], strict=True)) if k != at]


def _placed(blocks: DataFrame, found: DataFrame, name: str, keys) -> DataFrame:
    """The blocks with a column of what the parts returned for keys(row), in that order."""
    names = blocks.columns

    def place(group: pa.Table) -> pa.Table:
        home, rows = _split(group)
        home = home.select(names)
        return home.append_column(name, pa.array([_squeezed(_returned(rows, *keys(home)))], pa.binary()))

    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in blocks.schema) + f", {name} binary"
    return _together(blocks, found.where("kind = 'back'")).applyInArrow(place, shape)


def _history_parts(blocks: DataFrame, uni: Unigrams, parts: int) -> DataFrame:
    """Per history of a block that training knows: numbers of its bigrams of each discounted count, and the unigram probability of its seen successors."""

    def ask(batches):
        for block, r in _records(batches):
            x = _Pairs(r, uni.texts)
            seen = np.frombuffer(r["seen"], dtype=np.int64)
            mine = np.flatnonzero(seen & 1)
            n, width = len(x.hashes), DISCOUNTED + 2
            few = np.bincount(x.a[mine] * width + np.minimum(seen[mine] >> 1, DISCOUNTED + 1), minlength=n * width).reshape(n, width)[:, 1 : DISCOUNTED + 1]
            covered = np.bincount(x.a[mine], weights=uni.probability(x.known[x.b[mine]]), minlength=n)
            for p, k in _shares(*_known_deal(x, parts)):
                yield _rows(part=[p], block=[block], keys=[_blob(x.hashes[k])], few=[_squeezed(np.ascontiguousarray(few[k].T.reshape(-1)))], covered=[_blob(covered[k])])

    def reduce(group: pa.Table) -> pa.Table:
        keys = [np.frombuffer(x.as_py(), np.uint64) for x in group["keys"]]
        known, at = np.unique(np.concatenate(keys), return_inverse=True)
        few = np.zeros((DISCOUNTED, len(known)), dtype=np.int64)
        own = np.concatenate([_loosened(x.as_py(), np.int64).reshape(DISCOUNTED, -1) for x in group["few"]], axis=1)
        for row, values in zip(few, own, strict=True):
            row += np.bincount(at, weights=values, minlength=len(known)).astype(np.int64)
        covered = np.bincount(at, weights=np.concatenate([np.frombuffer(x.as_py(), np.float64) for x in group["covered"]]), minlength=len(known))
        cut = np.cumsum([0, *map(len, keys)])
        n = len(keys)
        back = [_squeezed(few[:, at[a:b]].reshape(-1)) for a, b in zip(cut, cut[1:])]
        mass = [_blob(covered[at[a:b]]) for a, b in zip(cut, cut[1:])]
        data = [np.int64(len(x)).tobytes() + x + y for x, y in zip(back, mass, strict=True)]
        return pa.Table.from_batches([_rows(kind=["back"] * n, part=[group["part"][0].as_py()] * n, block=group["block"].to_pylist(), data=data)])

    asked = blocks.select("block", "held", "counts", "words", "stream", "known", "seen").mapInArrow(ask, "part int, block bigint, keys binary, few binary, covered binary")
    return asked.groupBy("part").applyInArrow(reduce, _BACK)


def _known_deal(x: _Pairs, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """_deal of the block's histories that training knows, as places in its vocabulary."""
    own = np.flatnonzero(x.known > 0)
    order, cut = _deal(x.hashes[own], parts)
    return own[order], cut


def _written(df: DataFrame, name: str) -> DataFrame:
    """df as a table; Spark then drops the shuffle files that only led to it."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key)
    conf.set(key, "true")
    try:
        return materialise(df.select("*"), name, compression="zstd", batch_rows=1)
    finally:
        conf.set(key, before)


def katz_scores(docs: DataFrame, held: Column, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs.

    Learns from rows where `held` is false.  Words are `[^\\x20\\x09-\\x0D]+` after A-Z became
    a-z; each text has one end token more.  Null and empty texts have only that; a text of
    any length is scored whole, in a block of its own if it is very long.  Without training
    rows nothing is known: base_score is then 0 per token (one type in all), and so is
    score, as the unseen type has everything.  Null and repeated ids are as good as any:
    each row gets a row and counts in training.  An empty table gives no rows.
    """
    own = keyed(docs, id_col, text_col, F.coalesce(held, F.lit(True)).alias("held"))
    blocks = materialise(token_blocks(own), "blocks", compression="zstd")

    def sizes(batches):
        for batch in batches:
            n = t = a = 0
            for h, c in zip(batch.column(0), batch.column(1), strict=True):
                train, counts = ~np.frombuffer(h.as_py(), dtype=bool), np.frombuffer(c.as_py(), dtype=np.int32)
                n, t, a = n + int(counts[train].sum()), t + int(train.sum()), a + int(counts.sum())
            yield pa.RecordBatch.from_pydict({"n": [n], "t": [t], "a": [a]})

    row = blocks.select("held", "counts").mapInArrow(sizes, "n bigint, t bigint, a bigint").agg(F.sum("n").alias("n"), F.sum("t").alias("t"), F.sum("a").alias("a")).first()
    total, texts = (row["n"] or 0) + (row["t"] or 0), row["t"] or 0
    parts = max(1, math.ceil((row["a"] or 0) / PART_TOKENS))
    by_word = _written(_word_parts(blocks, parts), "words")
    n = _stats(by_word)
    if texts:  # the end is a type
        n[min(texts, DISCOUNTED + 2)] += 1
    uni = unigram_model(n, total, texts, sum(n[r] for r in range(1, DISCOUNTED + 3)))
    counted = _written(_placed(blocks, by_word, "known", lambda home: _deal(np.frombuffer(home["words"][0].as_py(), dtype=np.uint64), parts)), "counted")
    release(blocks, by_word)
    by_pair = _written(_bigram_parts(counted, texts, parts), "bigrams")
    discounts = good_turing(_stats(by_pair))
    paired = _written(_placed(counted, by_pair, "seen", lambda home: _deal(_Pairs(_record(home), texts).keys, parts)), "paired")
    release(counted, by_pair)
    models = _written(_history_parts(paired, uni, parts), "models")
    divisor = math.log10(total + 0.5 * (uni.types + 1))
    kind = own.schema["doc_id"].dataType.simpleString()

    def collect(group: pa.Table) -> pa.Table:
        home, rows = _split(group)
        ids, r = home["ids"].combine_chunks()[0].values, _record(home)
        x, seen = _Pairs(r, texts), np.frombuffer(r["seen"], dtype=np.int64) >> 1
        few, covered = np.zeros((DISCOUNTED, len(x.hashes))), np.zeros(len(x.hashes))
        order, cut = _known_deal(x, parts)
        for p, data in rows:
            size = int(np.frombuffer(data[:8], dtype=np.int64)[0])
            k = order[cut[p] : cut[p + 1]]
            few[:, k] = _loosened(data[8 : 8 + size], np.int64).reshape(DISCOUNTED, -1)
            covered[k] = np.frombuffer(data[8 + size :], dtype=np.float64)
        lost = np.arange(1, DISCOUNTED + 1) * (1 - discounts[1:])
        scale, weight = backoff(x.known.astype(float), x.known - lost @ few, covered)
        # the discounted count if the bigram was seen, else the history's weight times the unigram
        value = np.log10(np.where(seen > 0, _discounted(seen, discounts) / scale[x.a], weight[x.a] * uni.probability(x.known[x.b])))
        target = x.known[x.b]
        add = lambda v: np.bincount(x.doc, weights=v[x.stream], minlength=len(ids))
        tokens = x.counts + 1
        return pa.table({"doc_id": ids, "held_out": x.held, "n_tokens": tokens, "n_known": add((target > 0).astype(float)).astype(np.int64), "train_tokens": np.full(len(ids), total), "base_score": add(np.log10(target + 0.5)) - tokens * divisor, "score": add(value)})

    shape = f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return _together(paired, models).applyInArrow(collect, shape)


def op3_katz(spark, sf_dir: str) -> DataFrame:
    """Katz scores of all documents, learned from those whose crc32(doc_id) mod 5 is not 1.

    One row per row of `documents`; a null text has only the end token, a null id is held
    out.  See katz_scores for empty, very long and repeated rows.
    """
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    return katz_scores(table(spark, sf_dir, "documents"), held)
