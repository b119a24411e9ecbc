"""Language identification of mixed-language text.

Every letter run is a word.  The script of its first letter narrows the candidate
languages; the word's score for each is the log-likelihood of its letter trigrams.
Viterbi over the words of a document, with a penalty for switching the language, labels
spans; the document's language is the label with the most letters.

Trigram counts are hashed into a fixed number of cells, so the model's size is bounded
by the number of languages, not by the corpus.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import held_out, keyed, table

#: Cells of the hashed trigram table of one language.
CELLS = 1 << 16
#: Log-probability that a change of language between two words costs.
SWITCH = 6.0
#: Added to each trigram count.
SMOOTHING = 0.5
#: Characters scored at once, and of the documents labelled at once.
SCORE_CHARS, LABEL_CHARS = 1 << 20, 12 << 20
#: Bytes of the model that is broadcast, at most; more languages need fewer cells.
MODEL_BYTES = 1 << 29

#: First code point, last code point, script; other letters are script 0.  Fixed values of the Unicode blocks.
SCRIPTS = [
    (0x0041, 0x024F, "latin"),
    (0x1E00, 0x1EFF, "latin"),
    (0x0370, 0x03FF, "greek"),
    (0x1F00, 0x1FFF, "greek"),
    (0x0400, 0x052F, "cyrillic"),
    (0x0530, 0x058F, "armenian"),
    (0x0590, 0x05FF, "hebrew"),
    (0x0600, 0x06FF, "arabic"),
    (0x0750, 0x077F, "arabic"),
    (0x0900, 0x097F, "devanagari"),
    (0x0980, 0x09FF, "bengali"),
    (0x0B80, 0x0BFF, "tamil"),
    (0x0C00, 0x0C7F, "telugu"),
    (0x0E00, 0x0E7F, "thai"),
    (0x10A0, 0x10FF, "georgian"),
    (0x1100, 0x11FF, "hangul"),
    (0xAC00, 0xD7AF, "hangul"),
    (0x3040, 0x30FF, "kana"),
    (0x3400, 0x4DBF, "han"),
    (0x4E00, 0x9FFF, "han"),
]
_NAMES = ["other", *dict.fromkeys(s for _, _, s in SCRIPTS)]
_TABLES: list[np.ndarray] = []


def _tables() -> list[np.ndarray]:
    """For each code point: is it a letter, does it continue a word, its script."""
    if not _TABLES:
        kinds = [unicodedata.category(chr(c))[0] for c in range(0x110000)]
        letter = np.fromiter((k == "L" for k in kinds), dtype=bool, count=len(kinds))
        inside = letter | np.fromiter((k == "M" for k in kinds), dtype=bool, count=len(kinds))
        script = np.zeros(len(kinds), dtype=np.uint8)
        for lo, hi, name in SCRIPTS:
            script[lo : hi + 1] = _NAMES.index(name)
        _TABLES.extend([letter, inside, script])
    return _TABLES


class Letters:
    """Words of several texts: trigram cell of each character in a word, word starts, scripts."""

    def __init__(self, texts: list[str]):
        letter, inside, script = _tables()
        low = [t.lower() for t in texts]
        ends = np.cumsum([len(t) for t in low], dtype=np.int64)
        code = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        within = inside[code]
        before = np.zeros(len(code), dtype=bool)
        before[1:] = within[:-1]
        cut = ends[:-1]
        before[cut[cut < len(code)]] = False
        at = np.flatnonzero(within)
        begin = ~before[at]
        last = np.append(begin[1:], True) if len(at) else begin
        own = code[at].astype(np.uint64)
        left = np.where(begin, 32, np.concatenate(([32], own[:-1])) if len(at) else own).astype(np.uint64)
        right = np.where(last, 32, np.concatenate((own[1:], [32])) if len(at) else own).astype(np.uint64)
        mixed = (left * np.uint64(0x9E3779B97F4A7C15)) ^ (own * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (right * np.uint64(0x165667B19E3779F9))
        mixed *= np.uint64(0xFF51AFD7ED558CCD)
        self.cells = (mixed >> np.uint64(48)).astype(np.int64)
        self.starts = np.flatnonzero(begin)
        self.sizes = np.diff(np.append(self.starts, len(at)))
        self.scripts = script[code[at[self.starts]]]
        self.counts = np.diff(np.searchsorted(at[self.starts], np.concatenate(([0], ends))))
        seen = np.concatenate(([0], np.cumsum(letter[code])))
        self.letters = np.diff(seen[np.concatenate(([0], ends))])


def _groups(texts: list[str], size: int):
    at = 0
    while at < len(texts):
        end, chars = at, 0
        while end < len(texts) and (end == at or chars < size):
            chars += len(texts[end])
            end += 1
        yield at, end
        at = end


def count_trigrams(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, at, n: cells and (from CELLS on) scripts counted over all rows with a language."""
    own = keyed(docs, id_col, text_col, F.col(lang_col).cast("string").alias("lang")).where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")

    def run(batches):
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            texts = batch.column(0).to_pylist()
            langs = np.array(batch.column(1).to_pylist(), dtype=object)
            for lang in set(langs):
                mine = [texts[i] for i in np.flatnonzero(langs == lang)]
                total = counts.setdefault(lang, np.zeros(CELLS + len(_NAMES), dtype=np.int64))
                for lo, hi in _groups(mine, SCORE_CHARS):
                    found = Letters(mine[lo:hi])
                    total += np.bincount(np.concatenate((found.cells, CELLS + found.scripts.astype(np.int64))), minlength=len(total))
        for lang, total in counts.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(at), pa.string()), "at": pa.array(at, pa.int32()), "n": pa.array(total[at], pa.int64())})

    found = own.mapInArrow(run, "lang string, at int, n bigint")
    return found.groupBy("lang", "at").agg(F.sum("n").alias("n"))


class Model:
    """Log-probabilities of cells and candidate languages of scripts, from {language: counts}."""

    def __init__(self, counts: dict[str, np.ndarray]):
        self.langs = sorted(counts)
        if CELLS * len(self.langs) * 4 > MODEL_BYTES:
            raise ValueError(f"{len(self.langs)} languages take more than MODEL_BYTES with {CELLS} cells each")
        self.logs = np.empty((CELLS, len(self.langs)), dtype=np.float32)
        scripts = np.zeros((len(_NAMES), len(self.langs)))
        for k, lang in enumerate(self.langs):
            cells = counts[lang][:CELLS] + SMOOTHING
            self.logs[:, k] = np.log(cells / cells.sum())
            scripts[:, k] = counts[lang][CELLS:]
        #: a language is a candidate of a script that holds a thousandth of its words or more
        allowed = scripts >= np.maximum(1, 0.001 * scripts.sum(axis=0, keepdims=True))
        allowed[~allowed.any(axis=1)] = True
        self.barred = np.where(allowed, 0, -1e4).astype(np.float32)

    def scores(self, found: Letters) -> np.ndarray:
        """Log-likelihood of each word in each language."""
        if not len(found.starts):
            return np.zeros((0, len(self.langs)), dtype=np.float32)
        return np.add.reduceat(self.logs[found.cells], found.starts, axis=0) + self.barred[found.scripts]


def viterbi(scores: np.ndarray, counts: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best label of each word; scores of all documents' words lie one after another.

    All documents advance together, word by word, longest first, so that the active ones
    are always a prefix.  Of equal paths the one that stays, then the lower label, wins.
    """
    labels = np.zeros(len(scores), dtype=np.int16)
    order = np.argsort(-counts, kind="stable")
    order = order[counts[order] > 0]
    if not len(order):
        return labels
    first = (np.cumsum(counts) - counts)[order]
    size = counts[order]
    active = np.searchsorted(-size, -np.arange(size[0]), side="left")  # documents with more than t words
    back = np.zeros(scores.shape, dtype=np.int16)
    own = np.arange(scores.shape[1], dtype=np.int16)
    value = scores[first].astype(np.float64)
    for t in range(1, size[0]):
        n = active[t]
        at = first[:n] + t
        held = value[:n]
        best = held.argmax(axis=1)
        other = held[np.arange(n), best] - switch
        stay = held >= other[:, None]
        back[at] = np.where(stay, own, best[:, None])
        value[:n] = np.where(stay, held, other[:, None]) + scores[at]
    now = value.argmax(axis=1).astype(np.int16)
    for t in range(size[0] - 1, -1, -1):
        n = active[t]
        at = first[:n] + t
        labels[at] = now[:n]
        if t:
            now[:n] = back[at, now[:n]]
    return labels


def train(docs: DataFrame, **columns) -> Model | None:
    """Fit on all rows with a language; None without any.

    The counts reach the driver as Arrow columns, at most CELLS and the scripts a language.
    """
    found = count_trigrams(docs, **columns).toArrow()
    names = found["lang"].combine_chunks().dictionary_encode()
    at, n, code = found["at"].to_numpy(), found["n"].to_numpy(), np.asarray(names.indices)
    counts = {}
    for k, lang in enumerate(names.dictionary.to_pylist()):
        counts[lang] = np.bincount(at[code == k], weights=n[code == k], minlength=CELLS + len(_NAMES))
    return Model(counts) if counts else None


_OUT = "lang_pred string, score double"


def identify(docs: DataFrame, model: Model | None, *, id_col: str = "doc_id", text_col: str = "text", spans: bool = False, keep_text: bool = False) -> DataFrame:
    """doc_id, lang_pred, score for each row; with `spans` also spans of words and labels.

    With `keep_text` the text comes back too, so a filter needs no join.

    score is the share of the letters that lie in spans of lang_pred, in [0, 1].  Null
    and empty texts, texts without a letter and an empty model give 'und' and 0.  Ties go
    to the language first in alphabetical order.  A text of any length is labelled whole.
    Null and repeated ids are as good as any: each row gets a row; an empty table gives none.
    """
    own = keyed(docs, id_col, text_col)
    kind = own.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)
    more = (", spans array<struct<lo:bigint,hi:bigint,lang:string>>" if spans else "") + (", text string" if keep_text else "")

    def label(texts: list[str], model: Model):
        parts = [Letters(texts[lo:hi]) for lo, hi in _groups(texts, SCORE_CHARS)]
        scores = np.concatenate([model.scores(p) for p in parts])
        counts = np.concatenate([p.counts for p in parts])
        letters = np.concatenate([p.letters for p in parts])
        sizes = np.concatenate([p.sizes for p in parts])
        labels = viterbi(scores, counts)
        n = len(model.langs)
        doc = np.repeat(np.arange(len(texts)), counts)
        share = np.bincount(doc * n + labels, weights=sizes, minlength=len(texts) * n).reshape(-1, n)
        best = share.argmax(axis=1)
        total = share.sum(axis=1)
        good = (letters > 0) & (total > 0)
        score = np.where(good, share[np.arange(len(texts)), best] / np.maximum(total, 1), 0.0)
        return [model.langs[b] if g else "und" for b, g in zip(best, good, strict=True)], score, labels, counts

    def run(batches):
        model = sent.value
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for lo, hi in _groups(texts, LABEL_CHARS):
                ids, part = batch.column(0).slice(lo, hi - lo), texts[lo:hi]
                if model is None:
                    langs, score, labels, counts = ["und"] * len(part), np.zeros(len(part)), None, np.zeros(len(part), int)
                else:
                    langs, score, labels, counts = label(part, model)
                out = {"doc_id": ids, "lang_pred": pa.array(langs, pa.string()), "score": pa.array(score, pa.float64())}
                if spans:
                    got, at = [], 0
                    for c in counts.tolist():
                        own = labels[at : at + c] if c else np.zeros(0, int)
                        cuts = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), c] if c else [0]
                        got.append([{"lo": a, "hi": b, "lang": model.langs[own[a]]} for a, b in zip(cuts, cuts[1:])])
                        at += c
                    out["spans"] = pa.array(got, pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64()), ("lang", pa.string())])))
                if keep_text:
                    out["text"] = batch.column(1).slice(lo, hi - lo)
                yield pa.RecordBatch.from_pydict(out)

    return own.mapInArrow(run, f"doc_id {kind}, {_OUT}{more}")


def op10_langid(spark, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned from those whose crc32(doc_id) mod 3 is not 1.

    One row per row of `documents`; 'und' without a letter.  See identify.
    """
    docs = table(spark, sf_dir, "documents")
    held = held_out(F.col("doc_id"), 3)
    model = train(docs.where(~held))
    return identify(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")
