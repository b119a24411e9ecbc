"""Operators on single texts: BPE, decontamination, language, tokens, quality, personal data."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontaminate, knn_quality, langid, pii, quality_rules, token_counts
from tidemark.llm.frames import held_out, table

LONG = "word " * 30_000
ODD = [None, "", "   \n\t ", "a", "Don't <|endoftext|> x<|startoftext|> 12 ½", "ΑΣ Σ İ é 日本語 😀 \x00​　a\x85b", "aaaaaaa" * 40, "x" * 5000, LONG]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "c", t) for i, t in enumerate(ODD)] + [(3, "a", "c", "a"), (None, "no id here", None, "z")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, score string, n_words string")


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


def empty(df):
    return df.limit(0)


# BPE


def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    return t


def test_bpe_is_the_librarys(spark, docs, odd, texts):
    t = library()
    for df, want in ((odd, None), (docs, texts)):
        for r in bpe.encode(df).collect():
            text = (want[r["doc_id"]] if want else "no id here" if r["doc_id"] is None else ODD[r["doc_id"]]) or ""
            e = t.encode(text, add_special_tokens=False)
            assert r["ids"] == e.ids and r["n_tokens"] == len(e.ids)
            assert r["decoded"] == t.decode(e.ids, skip_special_tokens=False)


def test_long_pre_tokens_are_the_librarys():
    import random
    import time

    import public_tokenizers

    rng, lib, own = random.Random(3), library(), bpe.Bpe(public_tokenizers.path("word_bpe_49k.json"))
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(n)) for n in (513, 2000, 20_000)] + ["ab" * 3000, "é" * 900, "z" * 4001]
    for w in words:
        assert own.encode(w) == lib.encode(w, add_special_tokens=False).ids
        assert not own.kept or max(map(len, own.kept)) <= bpe.LONG
    began = time.time()
    own.encode("".join(rng.choice("etaoinshrdlu") for _ in range(200_000)))
    assert time.time() - began < 20


def test_bpe_digests_and_decode(spark, odd):
    full, short = bpe.encode(odd), bpe.encode(odd, digests=True)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = sorted((sha(" ".join(map(str, r["ids"]))), sha(r["decoded"])) for r in full.collect())
    assert sorted((r["ids_sha256"], r["decoded_sha256"]) for r in short.collect()) == want
    back = bpe.decode(full).collect()
    assert sorted(r["decoded"] for r in back) == sorted(r["decoded"] for r in full.collect())
    assert bpe.encode(empty(odd)).count() == 0


# decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_hits(text, items):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        v = words(t)
        n = min(10, len(v))
        windows = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
        for i in range(len(w) - n + 1) if n else ():
            if tuple(w[i : i + n]) in windows:
                hit.update(range(i, i + n))
                found.add(str(item))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("limit", [32 << 20, 3000])
def test_decontamination_is_brute_force(spark, sf_dir, docs, texts, limit):
    items = [(r["item_id"], r["text"]) for r in table(spark, sf_dir, "benchmark").collect()]
    some = spark.createDataFrame([*items, (900, "of"), (901, None), (902, " "), (903, "The of the of the of the of the of the")], "item_id bigint, text string")
    items = [(r["item_id"], r["text"]) for r in some.collect()]
    found = {r["doc_id"]: r for r in decontaminate.find_contamination(docs.limit(60), some, pass_bytes=limit).collect()}
    for i, r in found.items():
        assert (r["n_words"], sum(x["hi"] - x["lo"] for x in r["spans"]), r["items"]) == brute_hits(texts[i], items)


def test_decontamination_edges(spark, odd, docs):
    items = spark.createDataFrame([(1, "no id here")], "item_id bigint, text string")
    assert [r["doc_id"] for r in decontaminate.find_contamination(odd, items).where("size(items) > 0").collect()] == [None]
    left = decontaminate.decontaminate(odd, items)
    assert left.count() == len(ODD) + 1 and left.columns == odd.columns
    assert decontaminate.find_contamination(odd, empty(items)).where("size(items) > 0").isEmpty()
    assert decontaminate.find_contamination(empty(odd), items).isEmpty()


def test_shifts_never_skip_an_occurrence():
    import random

    from tidemark.llm import textflat

    rng = random.Random(8)
    for _ in range(100):
        m = rng.choice([1, 2, 3, 10])
        docs = [" ".join(rng.choice("ab") for _ in range(rng.randrange(60))) for _ in range(3)]
        patterns = [" ".join(rng.choice("ab") for _ in range(m)) for _ in range(3)]
        (machine,) = decontaminate.searchers(patterns)
        found = textflat.words(*next(textflat.chunks(pa.array(docs)))[2:], textflat.NON_WORD)
        start, window = machine.search(found.hashes(), found.first)
        got = {(s, x) for s, w in zip(start.tolist(), window.tolist()) for x in machine.owners[machine.cut[w] : machine.cut[w + 1]].tolist()}
        flat = [w for d in docs for w in d.split()]
        ends = np.cumsum([0, *(len(d.split()) for d in docs)])
        want = {(i, k) for a, b in zip(ends, ends[1:]) for i in range(a, b - m + 1) for k, p in enumerate(patterns) if flat[i : i + m] == p.split()}
        assert got == want


def test_decontamination_tables_grow_as_the_items():
    import random

    rng = random.Random(2)
    vocabulary = [f"w{k}" for k in range(3000)]
    texts = [" ".join(rng.choices(vocabulary, k=200)) for _ in range(2000)]
    (machine,) = decontaminate.searchers(texts)
    held = sum(getattr(machine, k).nbytes for k in ("text", "at", "keys", "shift", "cut", "owners"))
    assert held < 25 * sum(map(len, texts)) and np.diff(np.searchsorted(machine.keys, np.unique(machine.keys))).max(initial=1) <= 3


# language


def test_language_accuracy_held_out(spark, docs):
    held = held_out(F.col("doc_id"), 3)
    model = langid.train(docs.where(~held))
    rows = langid.identify(docs, model).join(docs.where(held).select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_edges_and_spans(spark, odd, docs):
    model = langid.train(docs)
    got = {r["doc_id"]: r for r in langid.identify(odd, model).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (0, 1, 2))
    assert langid.identify(odd, None).where("lang_pred <> 'und'").isEmpty()
    assert langid.train(empty(docs)) is None and langid.identify(empty(odd), model).isEmpty()
    de = docs.where("lang = 'de'").first()["text"][:600]
    en = docs.where("lang = 'en' AND length(text) > 700").first()["text"][:600]
    mixed = spark.createDataFrame([(1, en + "\n" + de)], "doc_id bigint, text string")
    spans = langid.identify(mixed, model, spans=True).first()["spans"]
    assert {s["lang"] for s in spans} >= {"en", "de"} and spans[0]["lo"] == 0


def brute_viterbi(scores, switch):
    value, back = scores[0].astype(float), []
    for s in scores[1:]:
        best = int(value.argmax())
        stay = value >= value[best] - switch
        back.append(np.where(stay, np.arange(len(s)), best))
        value = np.where(stay, value, value[best] - switch) + s
    at, out = int(value.argmax()), []
    for b in [*back[::-1], None]:
        out.append(at)
        if b is not None:
            at = int(b[at])
    return out[::-1]


def test_viterbi_of_many_is_viterbi_of_each():
    rng = np.random.default_rng(0)
    counts = np.array([5, 0, 1, 12, 7])
    scores = rng.normal(size=(counts.sum(), 3)).astype(np.float32)
    got = langid.viterbi(scores, counts, 1.0)
    at = 0
    for c in counts:
        assert c == 0 or got[at : at + c].tolist() == brute_viterbi(scores[at : at + c], 1.0)
        at += c


# token counts


def test_token_counts_are_a_unigram_librarys(spark, docs, odd, texts):
    from tokenizers import Tokenizer, models

    scores, unknown = token_counts.zipf_scores(token_counts.default_vocabulary())
    byte = [(f"<0x{i:02X}>", -1e4) for i in range(256)]
    lib = Tokenizer(models.Unigram([("<unk>", 0.0), *scores.items(), *byte], 0, True))
    memo = {}
    count = lambda w: memo.setdefault(w, len(lib.model.tokenize("▁" + w)))
    split = re.compile(r"[^\x20\x09-\x0D]+").findall
    for r in token_counts.count_tokens(docs).collect():
        own = split(texts[r["doc_id"]])
        assert (r["n_words"], r["n_tokens"]) == (len(own), sum(map(count, own)))
    for r in token_counts.count_tokens(odd).where("doc_id IS NOT NULL").collect():
        own = split(ODD[r["doc_id"]] or "")
        assert r["n_words"] == len(own)
        assert r["n_tokens"] == sum(map(count, own))
    assert token_counts.count_tokens(empty(odd)).isEmpty()


# quality


def test_quality_classifier_held_out(spark, sf_dir, docs):
    labels = table(spark, sf_dir, "labels")
    held = held_out(F.col("doc_id"), 3)
    model = knn_quality.train(docs, labels.where(~held), knn_quality.document_frequencies(docs))
    rows = knn_quality.score_quality(docs, model).join(labels.where(held), "doc_id").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.9
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_quality_classifier_edges(spark, sf_dir, docs, odd):
    idf = knn_quality.document_frequencies(docs)
    model = knn_quality.train(docs, table(spark, sf_dir, "labels"), idf, sample=20)
    assert len(model.labels) <= 40
    got = {r["doc_id"]: r["score"] for r in knn_quality.score_quality(odd, model).collect()}
    assert got[0] == got[1] == got[2] == 0 and len(got) == len(ODD) + 1
    labels = table(spark, sf_dir, "labels")
    assert knn_quality.train(docs, empty(labels), idf) is None
    assert knn_quality.score_quality(odd, None).where("score > 0").isEmpty()


BLANK_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_rules(text):
    w = BLANK_WORD.findall(text)
    seen, cover = {}, set()
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i : i + 8]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            for i in at:
                cover.update(range(i, i + 8))
    lines = [x for x in text.split("\n") if BLANK_WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(cover)


def test_quality_rules_are_brute_force(spark, sf_dir, docs, texts, odd):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    rows = quality_rules.quality(docs).collect()
    for r in rows:
        assert tuple(r[n] for n in names) == brute_rules(texts[r["doc_id"]])
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
    more = quality_rules.quality(odd, lang_col=None).collect()
    for r in more:
        text = "no id here" if r["doc_id"] is None else ODD[r["doc_id"]] or ""
        assert tuple(r[n] for n in names) == brute_rules(text)
    labels = {r["doc_id"]: r["quality"] for r in table(spark, sf_dir, "labels").collect()}
    judged = [(labels[r["doc_id"]], r["kept"]) for r in rows if r["doc_id"] in labels and not r["base_failed"]]
    assert np.mean([k for q, k in judged if q == 1]) > 0.95
    assert quality_rules.quality(empty(docs)).isEmpty()


def test_quality_rules_use_no_python(docs):
    plan = quality_rules.features(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# personal data

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def brute_spans(text):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = [True, all(int(x) <= 255 for x in m[0].split(".")) if k == 1 else False, 14 <= len(d) <= 19 and pii.luhn(d), 10 <= len(d) <= 15][k]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


EXTRA = ["a@b@c.de x..y@z.q. @a.b a@b.c@d.e.f", "1.2.3.4.5.6.7.8 300.1.1.1 01.02.03.004 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1111", "+1 (017) 555-7713 22 +12 +1((((", "é+49 (30) 1234567 é x@é.de"]


def test_base_spans_are_the_patterns(texts):
    for t in [*texts.values(), *EXTRA, "1" * 3000, "a@" * 500]:
        assert pii.base_spans(t) == brute_spans(t)


def test_personal_data_edges_and_added_spans(spark, docs, odd):
    field = pii.train(docs)
    found = pii.find_personal_data(docs, field).collect()
    for r in found:
        taken = [(s["start"], s["end"]) for s in r["base"]]
        assert all(s["start"] >= b or s["end"] <= a for s in r["added"] for a, b in taken)
    assert pii.find_personal_data(odd, field).where("doc_id < 3 AND size(base) > 0").isEmpty()
    assert pii.find_personal_data(empty(odd), pii.train(empty(odd))).isEmpty()


def test_personal_data_columns(spark, sf_dir, texts):
    for r in pii.op8_pii(spark, sf_dir).collect():
        base = brute_spans(texts[r["doc_id"]])
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x[1] == k for x in base) for k in range(4)]
        as_text = [f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base]
        assert r["base_sha256"] == hashlib.sha256(",".join(as_text).encode()).hexdigest()
        spans = r["spans"].split(",") if r["spans"] else []
        assert set(as_text) <= set(spans) and len(spans) == r["n_spans"] == len(base) + r["n_added"]
        rank = [(int(x.split(":")[1]), pii.ALL_KINDS.index(x.split(":")[0])) for x in spans]
        assert rank == sorted(rank)


def test_added_spans_of_held_out_documents(spark):
    """Precision of added spans on documents that training has not seen, and recall of repeats in part."""
    from pathlib import Path

    folder = Path("/root/testdata/sf0.1")
    if not folder.exists():
        pytest.skip("no larger table")
    docs = table(spark, str(folder), "documents").select("doc_id", "text")
    field = pii.train(docs.where(~held_out(F.col("doc_id"), 3)))
    own = [r["text"] for r in docs.where(held_out(F.col("doc_id"), 3) & F.col("text").rlike("[0-9@]")).collect()]
    base = [pii.base_spans(t) for t in own]
    added = [(t, a, k, b) for t, found in zip(own, pii.added_spans(own, base, field)) for a, k, b in found]
    real = [pii.ALL_KINDS[k] == "secret" and re.search(r"token\W+$", t[:a], re.I) and re.fullmatch("[0-9a-fA-F]{40}", t[a:b]) is not None for t, a, k, b in added]
    assert len(added) > 30 and np.mean(real) > 0.95
    phones = [(t, t[e - 8 : e]) for t, found in zip(own, base) for _, k, e in found if k == 3]
    again = [f"{t} and once more {tail} in part" for t, tail in phones]
    found = pii.added_spans(again, [pii.base_spans(t) for t in again], field)
    hit = [any(k == 3 and t[a:b] == tail for a, k, b in spans) for t, (_, tail), spans in zip(again, phones, found)]
    assert len(phones) > 10 and np.mean(hit) > 0.9
    short = [t.replace(m[0], m[0][:24]) for t in own for m in [re.search('[0-9a-f]{40}', t)] if m]
    found = pii.added_spans(short, [pii.base_spans(t) for t in short], field)
    assert np.mean([any(k == 4 for _, k, _ in spans) for spans in found]) > 0.9


def small_field(rng, scale=1.0):
    n = len(pii.LABELS)
    draw = lambda *shape: scale * rng.normal(size=shape)
    symmetric = draw(n, n)
    return pii.Field(draw(pii.SHAPES, n), draw(pii.CONTEXTS, n), draw(n, n), symmetric + symmetric.T)


def small_graph(n, chain, skip, label=None):
    zero = np.zeros(n, int)
    label = zero if label is None else np.array(label)
    return pii.Graph(zero, np.arange(n), np.arange(n) + 1, np.arange(n) + 1, np.arange(n), np.array(chain, int), np.array(skip, int).reshape(-1, 2).T, label, label)


def enumerated(field, g):
    """Marginals by adding up all labellings."""
    import itertools

    n, total = len(pii.LABELS), np.zeros((len(g), len(pii.LABELS)))
    for y in itertools.product(range(n), repeat=len(g)):
        if any(g.label[k] and g.label[k] != y[k] for k in range(len(g))):
            continue
        e = sum(0 if g.label[k] else field.unary[g.shape[k], y[k]] + field.context[g.context[k], y[k]] for k in range(len(g)))
        e += sum(field.chain[y[k], y[k + 1]] for k in g.chain) + sum(field.skip[y[u], y[v]] for u, v in g.skip.T)
        for k, x in enumerate(y):
            total[k, x] += np.exp(e)
    return total / total.sum(axis=1, keepdims=True)


def test_message_passing_is_exact_on_trees():
    rng = np.random.default_rng(1)
    for g in (small_graph(3, [0, 1], []), small_graph(4, [0, 2], [(1, 3)]), small_graph(4, [0, 2], [(0, 3)], [0, 2, 0, 0])):
        field = small_field(rng)
        assert np.allclose(field.marginals(g), enumerated(field, g), atol=1e-3)


def test_message_passing_on_loops_is_near_enumeration():
    rng = np.random.default_rng(2)
    for g in (small_graph(3, [0, 1], [(0, 2)]), small_graph(4, [0, 1, 2], [(0, 2), (1, 3)]), small_graph(4, [0, 1, 2], [(0, 3)], [4, 0, 0, 0])):
        field = small_field(rng, 0.5)
        got, want = field.marginals(g), enumerated(field, g)
        assert np.abs(got - want).max() < 0.05


def test_a_skip_edge_carries_a_label(docs):
    field = pii.train(docs)
    text = "call +1 (017) 555-7713 now or later 5557713 please"
    base = pii.base_spans(text)
    g = pii.graph([text], [base])
    assert g.skip.shape[1] >= 1 and g.label[-1] == pii.NONE
    with_skip = field.marginals(g)[-1, pii.PHONE]
    field.skip = np.zeros_like(field.skip)
    assert with_skip > field.marginals(g)[-1, pii.PHONE] + 0.05
