"""Token counts by trie-shared dynamic programming over a unigram vocabulary.

The distinct pre-tokens of a batch form a trie.  The forward score of a node, the best
score of any segmentation of its prefix, is computed once for all pre-tokens that share
the prefix, level by level: the pieces that may end at a node are found by the hash of
its last characters and extend the score of the ancestor they start at.  A pre-token's
token count is stored at its terminal node.

Pieces come from a sentencepiece file.  Its scores are ranks; a piece's log-probability is
that of Zipf's law for its rank.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .frames import keyed, table
from .textflat import chunks, words

#: Characters of text per trie, and the longest pre-token that goes in one; longer ones are segmented alone.
BATCH_BYTES, LONGEST = 4 << 20, 200
#: The mark before each pre-token.
MARK = "▁"
#: Scores are whole multiples of 1/UNITS nats; of equal scores fewer tokens win.
UNITS, ROOM = 1_000_000, 4096
#: What an unknown character scores below the least piece, as in the public libraries.
UNKNOWN = 10.0

_B = np.uint64(0x9E3779B97F4A7C15 | 5)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def zipf_scores(path: str) -> tuple[dict[str, float], float]:
    """(log-probability of each ordinary piece, score of an unknown character)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    ids.sort(key=lambda i: (-model.get_score(i), i))
    norm = math.log(sum(1 / k for k in range(1, len(ids) + 1)))
    scores = {model.id_to_piece(i): -math.log(k) - norm for k, i in enumerate(ids, start=1)}
    return scores, min(scores.values()) - UNKNOWN


class Unigram:
    def __init__(self, scores: dict[str, float], unknown: float):
        #: a segmentation's value: score * UNITS * ROOM - tokens
        self.value = {p: round(s * UNITS) * ROOM - 1 for p, s in scores.items()}
        self.unknown = round(unknown * UNITS) * ROOM
        self.longest = max(map(len, scores))
        by: dict[int, list] = {}
        for piece, v in self.value.items():
            h = np.uint64(0)
            with np.errstate(over="ignore"):
                for c in piece:
                    h = h * _B + np.uint64(ord(c))
            by.setdefault(len(piece), []).append((h, v))
        self.tables = {}
        for n, rows in by.items():
            keys = np.array([r[0] for r in rows], dtype=np.uint64)
            order = np.argsort(keys)
            self.tables[n] = (keys[order], np.array([r[1] for r in rows], dtype=np.int64)[order])

    def alone(self, text: str) -> int:
        """Tokens of one pre-token, by the plain recurrence (for very long ones)."""
        best = [(0, 0)]
        for end in range(1, len(text) + 1):
            c = text[end - 1]
            size = len(c.encode("utf-8", "replace"))
            now = (best[-1][0] + self.unknown // ROOM, best[-1][1] + size) if c not in self.value else None
            for n in range(1, min(self.longest, end) + 1):
                v = self.value.get(text[end - n : end])
                if v is not None:
                    s, t = best[end - n]
                    got = (s + (v + 1) // ROOM, t + 1)
                    if now is None or (got[0], -got[1]) > (now[0], -now[1]):
                        now = got
            best.append(now)
        return best[-1][1]

    def counts(self, pretokens: list[str]) -> np.ndarray:
        """Tokens of each distinct pre-token (marked), through their trie."""
        out = np.zeros(len(pretokens), dtype=np.int64)
        size = np.fromiter(map(len, pretokens), dtype=np.int64, count=len(pretokens))
        for k in np.flatnonzero(size > LONGEST):
            out[k] = self.alone(pretokens[k])
        short = np.flatnonzero((size <= LONGEST) & (size > 0))
        if not len(short):
            return out
        code = np.frombuffer("".join([pretokens[k] for k in short]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        size = size[short]
        first = np.cumsum(size) - size
        node = np.zeros(len(short), dtype=np.int64)  # each pre-token's node of the level above
        active = np.arange(len(short))
        #: levels of the trie: hash, parent (in the level above) and value of each node
        hashes, parents, values = [np.zeros(1, np.uint64)], [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
        power = [1]  # of the hash's base, modulo 2**64
        for depth in range(1, int(size.max()) + 1):
            active = active[size[active] >= depth]
            step = code[first[active] + depth - 1]
            unique, place = np.unique(node[active] << 21 | step, return_inverse=True)
            parent, char = unique >> 21, unique & 0x1FFFFF
            node[active] = place
            hashed = hashes[-1][parent] * _B + char.astype(np.uint64)
            power.append(power[-1] * int(_B) % (1 << 64))
            best = np.full(len(unique), np.iinfo(np.int64).min)
            above = parent
            for n in range(1, min(self.longest, depth) + 1):
                level = depth - n
                if n in self.tables:
                    keys, value = self.tables[n]
                    want = hashed - hashes[level][above] * np.uint64(power[n])
                    at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
                    hit = keys[at] == want
                    best = np.where(hit, np.maximum(best, values[level][above] + value[at]), best)
                    if n == 1:
                        # an unknown character is as many tokens as UTF-8 has bytes for it
                        width = 1 + (char >= 0x80) + (char >= 0x800) + (char >= 0x10000)
                        best = np.where(hit, best, values[level][above] + self.unknown - width)
                if level:
                    above = parents[level][above]
            hashes.append(hashed)
            parents.append(parent)
            values.append(best)
            last = active[size[active] == depth]
            out[short[last]] = -values[-1][node[last]] % ROOM
        return out


_OPEN: dict[str, Unigram] = {}


def opened(path: str) -> Unigram:
    if path not in _OPEN:
        _OPEN.clear()
        _OPEN[path] = Unigram(*zipf_scores(path))
    return _OPEN[path]


def count_tokens(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_words, n_tokens for each row of docs.

    Pre-tokens are the words `[^\\x20\\x09-\\x0D]+`, each with the mark before it.  Null and
    empty texts have none and count 0; a text of any length counts whole.  Null and
    repeated ids are as good as any: each row gets a row; an empty table gives none.  A
    pre-token of more than LONGEST characters is segmented outside the trie, with the same
    result.
    """
    own = keyed(docs, id_col, text_col)
    kind = own.schema["doc_id"].dataType.simpleString()
    path = vocabulary or default_vocabulary()

    def run(batches):
        model = opened(path)
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column(1), BATCH_BYTES):
                found = words(data, offsets, lower=False)
                _, at, stream = np.unique(found.hashes(), return_index=True, return_inverse=True)
                raw = data.tobytes()
                distinct = [MARK + raw[a:b].decode("utf-8", "replace") for a, b in zip(found.starts[at].tolist(), found.ends[at].tolist(), strict=True)]
                tokens = model.counts(distinct)
                total = np.bincount(found.row, weights=tokens[stream], minlength=hi - lo).astype(np.int64) if len(distinct) else np.zeros(hi - lo, np.int64)
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).slice(lo, hi - lo), "n_words": pa.array(found.counts, pa.int64()), "n_tokens": pa.array(total)})

    return own.mapInArrow(run, f"doc_id {kind}, n_words bigint, n_tokens bigint")


def op4_token_counts(spark, sf_dir: str) -> DataFrame:
    """Words and tokens of all documents: one row per row of `documents`, null texts with none.  See count_tokens."""
    return count_tokens(table(spark, sf_dir, "documents"))
