"""BPE encoding and decoding by batched numpy merge rounds.

The symbols of many distinct pre-tokens lie in one flat array.  A round looks up the rank
of every adjacent pair by binary search over the sorted pair keys, takes each word's
lowest rank and merges that pair wherever it occurs in the word; words without a
mergeable pair leave the array.  A round costs as much as the array is long, so a pre-token
of very many symbols is merged by itself, its pairs in a heap by rank and place.  A
pre-token's result is kept while its worker lives, in a table of bounded size, so a
frequent word is merged once.
"""

from __future__ import annotations

import hashlib
import json
from heapq import heapify, heappop, heappush
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .frames import keyed, table

#: Pre-tokens whose results a worker keeps, and symbols of those that aren't kept and have a heap.
KEPT, LONG = 100_000, 512
#: Characters of one batch of distinct pre-tokens that is merged at once.
BATCH_CHARS = 1 << 20


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies.

    Printable Latin-1 bytes stand for themselves, the others for U+0100 onwards in order.
    """
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    extra = iter(range(256, 512))
    return [chr(b if b in plain else next(extra)) for b in range(256)]


class Bpe:
    """Tables of one tokenizer file: byte-level BPE with an end-of-word suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.text_of = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        symbols = byte_symbols()
        self.inner = np.array([vocab[c] for c in symbols], dtype=np.int64)
        self.final = np.array([vocab[c + suffix] for c in symbols], dtype=np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made
        self.pairs: dict[int, tuple[int, int]] = {}  # of merge_long, made when it is first needed
        self.kept: dict[str, tuple[str, int, str]] = {}
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.split = regex.compile(pattern).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    NONE = np.iinfo(np.int64).max

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pair = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        return np.where(self.keys[at] == pair, self.ranks[at], self.NONE)

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, flat and in order, and how many each word has."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        symbol = self.inner[data]
        last = np.cumsum(sizes) - 1
        symbol[last] = self.final[data[last]]
        word = np.repeat(np.arange(len(words)), sizes)
        done_symbols, done_words = [], []
        while len(symbol):
            same = word[1:] == word[:-1]
            rank = np.full(len(symbol), self.NONE)
            rank[:-1][same] = self._rank(symbol[:-1][same], symbol[1:][same])
            starts = np.flatnonzero(np.concatenate(([True], ~same)))
            lengths = np.diff(np.append(starts, len(symbol)))
            lowest = np.repeat(np.minimum.reduceat(rank, starts), lengths)
            over = lowest == self.NONE
            if over.any():
                done_symbols.append(symbol[over])
                done_words.append(word[over])
            here = (rank == lowest) & ~over
            # of a run of overlapping occurrences (a a a), every second one is merged
            at = np.flatnonzero(here)
            if len(at):
                run = np.concatenate(([True], np.diff(at) != 1))
                first = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - first) % 2 == 0]
            symbol = symbol.copy()
            symbol[at] = self.made[rank[at]]
            keep = ~over
            keep[at + 1] = False
            symbol, word = symbol[keep], word[keep]
        if not done_symbols:
            return np.zeros(0, np.int64), np.zeros(len(words), np.int64)
        symbol, word = np.concatenate(done_symbols), np.concatenate(done_words)
        order = np.argsort(word, kind="stable")
        return symbol[order], np.bincount(word, minlength=len(words))

    def merge_long(self, word: str) -> list[int]:
        """Ids of one word; of equal pairs the first is merged first."""
        if not self.pairs:
            self.pairs = dict(zip(self.keys.tolist(), zip(self.ranks.tolist(), self.made[self.ranks].tolist(), strict=True), strict=True))
        data = np.frombuffer(word.encode("utf-8", "surrogatepass"), dtype=np.uint8)
        symbol = [*self.inner[data[:-1]].tolist(), int(self.final[data[-1]])]
        n, find = len(symbol), self.pairs.get
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(found[0], k) for k in range(n - 1) if (found := find(symbol[k] << 32 | symbol[k + 1]))]
        heapify(heap)
        while heap:
            rank, k = heappop(heap)
            right = after[k]
            if symbol[k] < 0 or right >= n:
                continue
            found = find(symbol[k] << 32 | symbol[right])
            if not found or found[0] != rank:
                continue  # one of the two has been merged since
            symbol[k], symbol[right] = found[1], -1
            after[k] = following = after[right]
            if following < n:
                before[following] = k
            for a, b in ((before[k], k), (k, following)):
                if a >= 0 and b < n and (found := find(symbol[a] << 32 | symbol[b])):
                    heappush(heap, (found[0], a))
        return [x for x in symbol if x >= 0]

    def _learn(self, words: list[str]) -> None:
        """Put the results of distinct words into `kept`."""
        text_of, at = self.text_of, 0
        while at < len(words):
            end, chars = at, 0
            while end < len(words) and (end == at or chars < BATCH_CHARS):
                chars += len(words[end])
                end += 1
            part = words[at:end]
            ids, counts = self.merge(part)
            ids, stops = ids.tolist(), np.cumsum(counts).tolist()
            begin = 0
            for word, stop in zip(part, stops, strict=True):
                own = ids[begin:stop]
                self.kept[word] = (" ".join(map(str, own)), len(own), self.decode(own))
                begin = stop
            at = end

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens in order; a special token in the text is one of its own, after a space."""
        out: list[str] = []
        for k, part in enumerate(self.cut.split(text) if self.cut and "<|" in text else [text]):
            if k % 2:
                out.append(" " + part)
            elif part:
                if not part.isascii():
                    part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
                out += self.split(part.lower())
        return out

    def encode_batch(self, texts: list[str | None]) -> list[list[tuple[str, int, str]]]:
        """For each text, of each pre-token: ids as decimal text, their number, the decoded text."""
        split = [self.pieces(t) if t else [] for t in texts]
        if len(self.kept) > KEPT:
            self.kept = {}
        fresh = set().union(*split) - self.kept.keys() if split else set()
        for word in [w for w in fresh if w[0] == " "]:
            self.kept[word] = (str(i := self.special[word[1:]]), 1, self.decode([i]))
            fresh.discard(word)
        long = {w for w in fresh if len(w) > LONG}
        for word in long:
            own = self.merge_long(word)
            self.kept[word] = (" ".join(map(str, own)), len(own), self.decode(own))
        self._learn(list(fresh - long))
        kept = self.kept
        out = [[kept[w] for w in one] for one in split]
        for word in long:
            del kept[word]
        return out

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for part in self.encode_batch([text])[0] for i in part[0].split()]

    def decode(self, ids: list[int]) -> str:
        """Token texts joined by spaces, as for a tokenizer file that names no decoder."""
        return " ".join([self.text_of[i] for i in ids if i in self.text_of])


_OPEN: dict[str, Bpe] = {}


def opened(path: str) -> Bpe:
    if path not in _OPEN:
        _OPEN.clear()
        _OPEN[path] = Bpe(path)
    return _OPEN[path]


def _slices(texts: list[str | None], size: int = 1 << 20):
    at = 0
    while at < len(texts):
        end, chars = at, 0
        while end < len(texts) and (end == at or chars < size):
            chars += len(texts[end] or "")
            end += 1
        yield at, end
        at = end


def encode(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, digests: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids (array<int>), decoded; a row per row of docs.

    With `digests`, ids_sha256 and decoded_sha256 replace ids and decoded, so that long
    texts aren't sent back.  A null or empty text has no tokens and decodes to the empty
    string.  Very long texts are batches of their own; null and repeated ids are as good
    as any: each row gets a row.  An empty table gives none.
    """
    own = keyed(docs, id_col, text_col)
    kind = own.schema["doc_id"].dataType.simpleString()
    path = vocabulary or default_vocabulary()

    def run(batches):
        bpe = opened(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in _slices(texts):
                found = bpe.encode_batch(texts[lo:hi])
                ids = [" ".join([x[0] for x in one]) for one in found]
                decoded = [" ".join([x[2] for x in one]) for one in found]
                out = {"doc_id": batch.column(0).slice(lo, hi - lo), "n_tokens": pa.array([sum([x[1] for x in one]) for one in found], pa.int64())}
                if digests:
                    sha = lambda texts: [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in texts]
                    out |= {"ids_sha256": pa.array(sha(ids), pa.string()), "decoded_sha256": pa.array(sha(decoded), pa.string())}
                else:
                    out |= {"ids": pa.array([np.fromstring(x, dtype=np.int32, sep=" ") if x else np.zeros(0, np.int32) for x in ids], pa.list_(pa.int32())), "decoded": pa.array(decoded, pa.string())}
                yield pa.RecordBatch.from_pydict(out)

    more = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    return own.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, {more}")


def decode(tokens: DataFrame, *, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """doc_id, decoded for rows with an array of ids; null ids and unknown ids are left out."""
    path = vocabulary or default_vocabulary()
    own = tokens.selectExpr(f"`{id_col}` AS doc_id", f"CAST(`{ids_col}` AS array<int>) AS ids")
    kind = own.schema["doc_id"].dataType.simpleString()

    def run(batches):
        bpe = opened(path)
        for batch in batches:
            texts = [bpe.decode([i for i in ids or () if i is not None]) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "decoded": pa.array(texts, pa.string())})

    return own.mapInArrow(run, f"doc_id {kind}, decoded string")


def op1_bpe(spark, sf_dir: str) -> DataFrame:
    """Tokens of all documents and digests of ids and decoded text; null texts are empty.  See encode."""
    return encode(table(spark, sf_dir, "documents"), digests=True)
