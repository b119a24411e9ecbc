"""Quality classifier, quality rules and language identification against plain restatements."""

import collections
import math
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import knn_quality, langid, quality_rules, textflat
from tidemark.llm.frames import held_out, table

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


# nearest neighbours


def brute_terms(text):
    """Counts of word cells and word shapes, word by word."""
    out, before = collections.Counter(), None
    for w in WORD.findall((text or "").encode()):
        kinds = [5 if 33 <= b < 127 else 2 if b >= 128 else 0 for b in w]
        for k, b in enumerate(w):
            kinds[k] = 1 if 65 <= b <= 90 else 2 if 97 <= b <= 122 else 3 if 48 <= b <= 57 else 4 if b in b"#*$%&|<>@_=~^\\{}" else kinds[k]
        n = collections.Counter(kinds)
        low = w.translate(textflat.LOWER_BYTES)
        shape = 0
        for bit in (n[1] > 1 and not n[2], n[1] > 0 and n[2] > 0, n[3] > 0, n[4] > 0, n[5] > 1, not n[1] + n[2], low == before):
            shape = shape * 2 + bit
        out[knn_quality.WORD_CELLS + shape * 4 + sum(len(w) >= x for x in (3, 7, 13))] += 1
        (hashed,) = textflat.words(np.frombuffer(low, np.uint8), np.array([0, len(low)])).hashes()
        out[int(hashed) % knn_quality.WORD_CELLS] += 1
        before = low
    return out


def test_neighbours_vote_as_in_brute_force(spark, sf_dir, docs):
    idf = knn_quality.document_frequencies(docs)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    terms = {i: brute_terms(t) for i, t in texts.items()}
    df = collections.Counter(k for t in terms.values() for k in t)
    want = [(math.log((1 + len(texts)) / (1 + df[k])) + 0.1) * (knn_quality.WORD_WEIGHT if k < knn_quality.WORD_CELLS else 1) for k in range(knn_quality.TERMS)]
    assert np.allclose(idf, want, atol=1e-5)
    model = knn_quality.train(docs, table(spark, sf_dir, "labels"), idf)

    def vector(t):
        n = sum(c for k, c in t.items() if k >= knn_quality.WORD_CELLS)
        x = np.zeros(knn_quality.TERMS)
        for k, c in t.items():
            x[k] = math.log1p(1000 * c / n) * idf[k]
        x = (x / np.linalg.norm(x)) @ model.axes
        return x / np.linalg.norm(x)

    for r in knn_quality.score_quality(docs, model).collect():
        t = terms[r["doc_id"]]
        if not t:
            assert r["score"] == 0
            continue
        cosine = sorted(((float(vector(t) @ v), y, w) for v, y, w in zip(model.vectors, model.labels, model.votes)), reverse=True)[: knn_quality.NEIGHBOURS]
        weights = [(max(c, 1e-6) ** 8 * w, y) for c, y, w in cosine]
        score = sum(w * y for w, y in weights) / sum(w for w, _ in weights)
        assert r["score"] == pytest.approx(score, abs=1e-3) and r["predicted"] == (r["score"] >= 0.5)


# quality rules


def brute_distance(p, q):
    def part(a, b):
        return sum(x * math.log2(x / ((x + y) / 2)) for x, y in zip(a, b) if x > 0)

    return math.sqrt(max(0.0, (part(p, q) + part(q, p)) / 2))


def shares(n):
    return [x / sum(n) for x in n]


def test_distances_and_verdict_are_brute_force(docs):
    rows = docs.select("doc_id", F.when(F.col("doc_id") % 7 != 0, F.col("lang")).alias("lang"), "text")
    own = {r["doc_id"]: (r["lang"] or "", r["text"] or "") for r in rows.collect()}
    split = re.compile(r"[^\x20\x09-\x0D]+").findall
    cell = lambda w: xxhash.xxh64(w.encode(), seed=42).intdigest() % quality_rules.CELLS
    words, classes = {}, {}
    for i, (_, t) in own.items():
        words[i] = collections.Counter(map(cell, split(t)))
        symbol, sign = sum(c in "#*$%&|<>" for c in t), sum(33 <= ord(c) < 127 and not c.isalnum() for c in t)
        upper, digit, blank = sum(unicodedata.category(c) == "Lu" for c in t), sum(c in "0123456789" for c in t), len(t) - sum(map(len, split(t)))
        classes[i] = [len(t) - blank - upper - digit - sign, upper, digit, blank, symbol, sign - symbol]
    langs = {lang for lang, _ in own.values()} - {""}
    ref = {}
    for lang in [*langs, ""]:
        mine = [i for i in own if not lang or own[i][0] == lang]
        total = sum((words[i] for i in mine), collections.Counter())
        top = sorted(total, key=lambda c: (-total[c], c))[: quality_rules.COMMON]
        share = [total[c] / sum(total.values()) for c in top]
        ref[lang] = top, [*share, 1 - sum(share)], shares([sum(classes[i][k] for i in mine) for k in range(6)])
    flagged = 0
    for r in quality_rules.quality(rows).collect():
        top, word_ref, class_ref = ref[own[r["doc_id"]][0]]
        n = sum(words[r["doc_id"]].values())
        if not n:
            assert r["base_failed"] and not r["kept"] and r["word_distance"] is None
            continue
        held = [words[r["doc_id"]][c] for c in top]
        a, b = brute_distance(shares(classes[r["doc_id"]]), class_ref), brute_distance(shares([*held, n - sum(held)]), word_ref)
        assert r["class_distance"] == pytest.approx(a, abs=1e-9) and r["word_distance"] == pytest.approx(b, abs=1e-9)
        far = len(own[r["doc_id"]][1]) >= quality_rules.CLASS_GUARD and a > quality_rules.MAX_CLASS_DISTANCE
        far |= n >= quality_rules.WORD_GUARD and b > quality_rules.MAX_WORD_DISTANCE + quality_rules.WORD_SLACK / math.sqrt(n)
        assert r["kept"] == (not r["base_failed"] and not far)
        flagged += far
    assert flagged


# language


def brute_words(text):
    """(letters, trigram cells, script) of each run of letters and marks."""
    low, out, run = text.lower(), [], []
    for c in [*low, " "]:
        if unicodedata.category(c)[0] in "LM":
            run.append(ord(c))
        elif run:
            cells = []
            for a, b, c2 in zip([32, *run[:-1]], run, [*run[1:], 32]):
                mixed = (a * 0x9E3779B97F4A7C15 ^ b * 0xC2B2AE3D27D4EB4F ^ c2 * 0x165667B19E3779F9) % 2**64
                cells.append(mixed * 0xFF51AFD7ED558CCD % 2**64 >> 48)
            script = next((s for lo, hi, s in reversed(langid.SCRIPTS) if lo <= run[0] <= hi), "other")
            out.append((len(run), cells, langid._NAMES.index(script)))
            run = []
    return out


def brute_path(scores, switch):
    value, back = scores[0], []
    for s in scores[1:]:
        best = max(range(len(value)), key=lambda k: value[k])
        back.append([k if value[k] >= value[best] - switch else best for k in range(len(s))])
        value = [max(value[k], value[best] - switch) + s[k] for k in range(len(s))]
    path = [max(range(len(value)), key=lambda k: value[k])]
    for b in reversed(back):
        path.append(b[path[-1]])
    return path[::-1]


def test_labels_and_scores_are_brute_force(docs):
    train = {r["doc_id"]: (r["lang"], r["text"]) for r in docs.where(~held_out(F.col("doc_id"), 3) & F.col("lang").isNotNull()).collect()}
    langs = sorted({lang for lang, _ in train.values()})
    cells = {k: collections.Counter() for k in langs}
    scripts = {k: collections.Counter() for k in langs}
    for lang, text in train.values():
        for _, own, script in brute_words(text or ""):
            cells[lang].update(own)
            scripts[lang][script] += 1
    total = {k: sum(cells[k].values()) + langid.SMOOTHING * langid.CELLS for k in langs}
    allowed = {s: [scripts[k][s] >= max(1, 0.001 * sum(scripts[k].values())) for k in langs] for s in range(len(langid._NAMES))}
    log = lambda k, c: math.log((cells[k][c] + langid.SMOOTHING) / total[k])
    model = langid.train(docs.where(~held_out(F.col("doc_id"), 3)))
    assert model.langs == langs
    some = docs.where("length(text) < 1500").limit(60).union(docs.where("doc_id = 0").selectExpr("-1", "'und 123 Привет мир ' || text", "lang", "source", "n_chars"))
    texts = {r["doc_id"]: r["text"] or "" for r in some.collect()}
    for r in langid.identify(some, model).collect():
        own = brute_words(texts[r["doc_id"]])
        if not own:
            assert (r["lang_pred"], r["score"]) == ("und", 0)
            continue
        scores = [[sum(log(k, c) for c in w) + (0 if not any(allowed[s]) or allowed[s][j] else -1e4) for j, k in enumerate(langs)] for _, w, s in own]
        letters = collections.Counter()
        for (n, _, _), label in zip(own, brute_path(scores, langid.SWITCH)):
            letters[label] += n
        best = min(range(len(langs)), key=lambda k: (-letters[k], k))
        assert r["lang_pred"] == langs[best] and r["score"] == pytest.approx(letters[best] / sum(letters.values()), abs=1e-6)
