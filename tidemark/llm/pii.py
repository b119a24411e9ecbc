"""Personal data: base patterns and a skip-chain conditional random field.

Base spans come from fixed patterns with checks.  The field labels every chunk of
non-blank characters that holds a digit or '@'; chunks of base spans are clamped to their
kind.  What the base checks (check digits, numbers of digits, complete addresses) is
hidden from the field, so it learns what such data look like and where they stand, not
the rule again.  Its factors are a log-linear one on each chunk's shape, one on the words
before it, one on adjacent chunks, and one on chunks that repeat (equal text or equal last
digits, wherever they are), so the label of one occurrence supports the others.  Loopy message passing gives the marginals; confident chunks that no
base span touches become added spans.  Besides the base's kinds there is 'secret', seeded
by long runs of mixed letters and digits.

The weights are fitted piecewise on counts over the whole corpus, with the base spans and
the seeds as labels: the counts have a fixed number of cells.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import keyed, table

KINDS = ["email", "ip", "card", "phone"]
#: Kinds of added spans, in the order of spans that begin together.
ALL_KINDS = [*KINDS, "secret"]
LABELS = ["none", *ALL_KINDS]
NONE, EMAIL, IP, CARD, PHONE, SECRET = range(6)

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a match cannot begin inside a run of digits unless it could begin at the run's head
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"(?<![0-9])[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]")
_CHUNK = re.compile(r"[^\x20\x09-\x0D]+")
_NO_DIGIT = re.compile(r"[^0-9]+")

#: Posterior that an added span needs.
CONFIDENT = 0.8
#: Message passing rounds, and the share of the old message that stays.
ROUNDS, DAMPING = 12, 0.3
#: Digits that two chunks must end in alike to be linked.
TAIL = 7


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 if k % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), sorted; kind is an index of KINDS."""
    out = []
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, 0, m.end()))
            last = m.end()
        else:
            last = max(last, at)
        at = text.find("@", max(at + 1, last))
    for m in _IP.finditer(text):
        if all(len(p) < 20 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m[0].split("."))):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = _NO_DIGIT.sub("", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= len(_NO_DIGIT.sub("", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


#: What surrounds a chunk's own text.
_SIGNS = "\"'[]{}<>.,;:!?#*$%&|="
#: Shape features of a chunk, each with so many values; the shape is their mixed-radix number.
RADIX = [2, 7, 4, 2, 2, 2, 2, 4, 2]
#: Hash cells of the words before a chunk.
CONTEXTS = 1024


def _shape(chunk: str) -> int:
    core = chunk.strip(_SIGNS)
    n = len(_NO_DIGIT.sub("", core))
    values = [
        "@" in core[1:-1],
        0 if not n else 1 if n < 3 else 2 if n < 7 else 3 if n < 10 else 4 if n < 14 else 5 if n < 20 else 6,
        min(3, core.count(".")),
        core.startswith("+"),
        "(" in core or ")" in core,
        "-" in core.strip("-"),
        any(c.isalpha() for c in core),
        0 if len(core) < 8 else 1 if len(core) < 20 else 2 if len(core) < 32 else 3,
        core.isascii() and core.isalnum(),
    ]
    code = 0
    for v, radix in zip(values, RADIX, strict=True):
        code = code * radix + int(v)
    return code


SHAPES = int(np.prod(RADIX))


def seed(chunk: str) -> bool:
    """A label for training: a long run of letters and digits of many kinds, as keys and tokens are."""
    core = chunk.strip(_SIGNS)
    return len(core) >= 20 and core.isascii() and core.replace("_", "").replace("-", "").isalnum() and any(c.isalpha() for c in core) and sum(c.isdigit() for c in core) >= 4 and len(set(core.lower())) >= 9


def _context(before: str, last: str) -> int:
    """Cell of the two words before a chunk."""
    return zlib.crc32(f"{before.strip(_SIGNS).lower()} {last.lower()}".encode("utf-8", "surrogatepass")) % CONTEXTS


def _design() -> np.ndarray:
    """One row per shape: indicators of each feature's values, a constant, and of pairs of small features."""
    codes, rest = [], np.arange(SHAPES)
    for radix in reversed(RADIX):
        codes.append(rest % radix)
        rest = rest // radix
    codes = codes[::-1]
    cols = [np.ones(SHAPES)]
    for c, radix in zip(codes, RADIX, strict=True):
        cols += [(c == v).astype(float) for v in range(radix)]
    cols += [((codes[1] == n) & (codes[k] == 1)).astype(float) for n in range(7) for k in (4, 5, 6, 8)]
    cols += [((codes[7] == n) & (codes[8] == 1) & (codes[6] == a)).astype(float) for n in range(4) for a in range(2)]
    return np.stack(cols, axis=1)


@dataclass
class Graph:
    """The field's nodes and edges for several texts."""

    text: np.ndarray  # index of the text
    start: np.ndarray
    end: np.ndarray
    shape: np.ndarray
    context: np.ndarray  # cell of the words before
    chain: np.ndarray  # nodes k with k+1 adjacent in the text
    skip: np.ndarray  # (2, n): consecutive occurrences of one key
    label: np.ndarray  # from the base spans; these nodes are clamped
    seeded: np.ndarray  # the label that training takes

    def __len__(self) -> int:
        return len(self.shape)


def graph(texts: list[str], spans: list[list[tuple[int, int, int]]]) -> Graph:
    rows: list[tuple] = []
    chain, skips = [], []
    for t, text in enumerate(texts):
        if not _ANY.search(text):
            continue
        before, keys, own = -2, {}, spans[t]
        s = 0
        two, one = "", ""
        for k, m in enumerate(_CHUNK.finditer(text)):
            chunk = m[0]
            if not _ANY.search(chunk):
                two, one = one, chunk
                continue
            node = len(rows)
            while s < len(own) and own[s][2] <= m.start():
                s += 1
            label = next((x[1] + 1 for x in own[s:] if x[0] < m.end() and x[2] > m.start()), NONE) if s < len(own) and own[s][0] < m.end() else NONE
            rows.append((t, m.start(), m.end(), _shape(chunk), _context(two, one), label, SECRET if label == NONE and seed(chunk) else label))
            two, one = one, chunk
            if before == k - 1 and k:
                chain.append(node - 1)
            before = k
            digits = _NO_DIGIT.sub("", chunk)
            core = chunk.strip(_SIGNS + "()").lower()
            for key in {("text", core)} | ({("tail", digits[-TAIL:])} if len(digits) >= TAIL and "@" not in chunk else set()):
                if key in keys:
                    skips.append((keys[key], node))
                keys[key] = node
    cols = np.array(rows, dtype=np.int64).reshape(-1, 7).T
    skip = np.array(sorted(set(skips)), dtype=np.int64).reshape(-1, 2).T
    return Graph(*cols[:5], np.array(chain, dtype=np.int64), skip, *cols[5:])


#: What a clamped node's other labels lose.
CLAMP = 1e3


@dataclass
class Field:
    unary: np.ndarray  # (SHAPES, labels)
    context: np.ndarray  # (CONTEXTS, labels)
    chain: np.ndarray  # (labels, labels)
    skip: np.ndarray

    def marginals(self, g: Graph) -> np.ndarray:
        n = len(LABELS)
        if not len(g):
            return np.zeros((0, n))
        unary = self.unary[g.shape] + self.context[g.context]
        held = np.flatnonzero(g.label != NONE)
        unary[held] = -CLAMP
        unary[held, g.label[held]] = 0
        u = np.concatenate((g.chain, g.skip[0]))
        v = np.concatenate((g.chain + 1, g.skip[1]))
        kind = np.concatenate((np.zeros(len(g.chain), int), np.ones(len(g.skip[0]), int)))
        pair = np.stack((self.chain, self.skip))[kind]
        source, target = np.concatenate((u, v)), np.concatenate((v, u))
        pair = np.concatenate((pair, pair.transpose(0, 2, 1)))
        reverse = np.concatenate((np.arange(len(u)) + len(u), np.arange(len(u))))
        message = np.zeros((len(source), n))
        for _ in range(ROUNDS if len(source) else 0):
            belief = unary.copy()
            np.add.at(belief, target, message)
            x = (belief[source] - message[reverse])[:, :, None] + pair
            top = x.max(axis=1, keepdims=True)
            new = np.log(np.exp(x - top).sum(axis=1)) + top[:, 0]
            new -= new.max(axis=1, keepdims=True)
            message = DAMPING * message + (1 - DAMPING) * new
        belief = unary.copy()
        np.add.at(belief, target, message)
        return _softmax(belief)


def _softmax(x: np.ndarray) -> np.ndarray:
    p = np.exp(x - x.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def fit(shapes: np.ndarray, contexts: np.ndarray, chain: np.ndarray, skip: np.ndarray, steps: int = 400) -> Field:
    """Piecewise training on counts: (SHAPES, labels), (CONTEXTS, labels), pairs of labels of chain and skip edges.

    A chunk without a base label may still be personal data, so an edge from a labelled
    chunk to one without says nothing about skip edges and is left out.
    """
    x = _design()
    seen = shapes.sum(axis=1) > 0
    n = max(1.0, shapes.sum())
    weight = np.zeros((x.shape[1], len(LABELS)))
    moment, square = np.zeros_like(weight), np.zeros_like(weight)
    for k in range(1, steps + 1):
        p = _softmax(x[seen] @ weight)
        total = shapes[seen].sum(axis=1, keepdims=True)
        gradient = x[seen].T @ (shapes[seen] - total * p) / n - 1e-5 * weight
        moment, square = 0.9 * moment + 0.1 * gradient, 0.99 * square + 0.01 * gradient**2
        weight += 0.3 * (moment / (1 - 0.9**k)) / (np.sqrt(square / (1 - 0.99**k)) + 1e-8)

    def association(counts: np.ndarray) -> np.ndarray:
        p = counts + 1.0
        p /= p.sum()
        return np.clip(np.log(p / (p.sum(axis=1, keepdims=True) * p.sum(axis=0, keepdims=True))), -2.0, 2.0)

    same = skip.copy()
    same[NONE, 1:] = same[1:, NONE] = 0
    # a cell's few observations are drawn towards the labels' overall shares
    share = contexts.sum(axis=0) + 1.0
    share /= share.sum()
    near = (contexts + 4 * share) / (contexts.sum(axis=1, keepdims=True) + 4)
    return Field(np.log(_softmax(x @ weight) + 1e-9), np.clip(np.log(near / share), -2.0, 2.0), association(chain + chain.T), association(same + same.T))


def train(docs: DataFrame, *, text_col: str = "text") -> Field:
    """Fit on all texts.  What reaches the driver are sums of a fixed number of cells."""
    n = len(LABELS)
    ends = np.cumsum([0, SHAPES * n, CONTEXTS * n, n * n, n * n]).tolist()
    own = docs.select(F.col(text_col).cast("string").alias("text")).where(F.col("text").rlike("[0-9@]"))

    def count(batches):
        total = np.zeros(ends[-1], dtype=np.int64)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            g = graph(texts, [base_spans(t) for t in texts])
            y = g.seeded
            for at, cell in zip(ends, (g.shape * n + y, g.context * n + y, y[g.chain] * n + y[g.chain + 1], y[g.skip[0]] * n + y[g.skip[1]])):
                total += np.bincount(at + cell, minlength=ends[-1])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"at": pa.array(at, pa.int32()), "n": pa.array(total[at], pa.int64())})

    got = own.mapInArrow(count, "at int, n bigint").groupBy("at").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(ends[-1])
    for r in got:
        total[r["at"]] = r["n"]
    return fit(*(total[a:b].reshape(-1, n) for a, b in zip(ends, ends[1:])))


def added_spans(texts: list[str], base: list[list[tuple[int, int, int]]], field: Field) -> list[list[tuple[int, int, int]]]:
    """Spans of confident chunks that no base span touches; adjacent ones of a card or phone are one."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    g = graph(texts, base)
    p = field.marginals(g)
    if not len(p):
        return out
    best = p.argmax(axis=1)
    linked, joined = set(g.chain.tolist()), -2
    for k in np.flatnonzero((best != NONE) & (p[np.arange(len(p)), best] >= CONFIDENT) & (g.label == NONE)).tolist():
        t, kind = g.text[k], int(best[k]) - 1
        start, end = int(g.start[k]), int(g.end[k])
        core = texts[t][start:end]
        left = core.lstrip(_SIGNS + ("" if kind == PHONE - 1 else "()"))
        start, core = end - len(left), left.rstrip(_SIGNS + "()")
        end = start + len(core)
        if start >= end:
            continue
        own = out[t]
        if own and joined == k - 1 and k - 1 in linked and best[k - 1] == best[k] and best[k] in (CARD, PHONE):
            own[-1] = (own[-1][0], kind, end)
        else:
            own.append((start, kind, end))
        joined = k
    return out


def find_personal_data(docs: DataFrame, field: Field, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base and added: arrays of (kind, start, end) in code points, a row per row of docs.

    Null and empty texts have no spans; a text of any length is searched whole.  Spans of
    different kinds may overlap, as the patterns do; an added span overlaps no base span.
    Of equally probable labels the first counts.  Null and repeated ids are as good as any:
    each row gets a row.  An empty table gives none.
    """
    own = keyed(docs, id_col, text_col)
    kind = own.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(field)
    spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    rows = lambda xs: [{"kind": ALL_KINDS[k], "start": a, "end": b} for a, k, b in xs]

    def run(batches):
        for batch in batches:
            texts = [t if t and _ANY.search(t) else "" for t in batch.column(1).to_pylist()]
            base = [base_spans(t) for t in texts]
            added = added_spans(texts, base, sent.value)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "base": pa.array([rows(x) for x in base], spans), "added": pa.array([rows(x) for x in added], spans)})

    shape = "array<struct<kind:string,start:bigint,end:bigint>>"
    return own.mapInArrow(run, f"doc_id {kind}, base {shape}, added {shape}")


def op8_pii(spark, sf_dir: str) -> DataFrame:
    """Personal data of all documents: base counts and digest, and all spans.

    One row per row of `documents`; a null text is empty.  n_spans counts all spans,
    n_added those of the field, n_secret its keys and tokens.
    """
    docs = table(spark, sf_dir, "documents")
    found = find_personal_data(docs, train(docs))
    rank = lambda x: F.array_position(F.array(*[F.lit(k) for k in ALL_KINDS]), x["kind"])
    ordered = lambda xs: F.array_sort(F.transform(xs, lambda x: F.struct(x["start"].alias("start"), rank(x).alias("rank"), x["end"].alias("end"), x["kind"].alias("kind"))))
    joined = lambda xs: F.array_join(F.transform(ordered(xs), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    of = lambda spans, kind: F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("bigint")
    return found.select(
        "doc_id",
        *[of("base", k).alias(f"n_{k}") for k in KINDS],
        F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        joined(F.concat("base", "added")).alias("spans"),
        (F.size("base") + F.size("added")).cast("bigint").alias("n_spans"),
        F.size("added").cast("bigint").alias("n_added"),
        of("added", "secret").alias("n_secret"),
    )
