"""Operators on whole corpora: near-duplicates, line dedup, Katz scores, the pipeline."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import katz, linededup, neardup
from tidemark.llm.components import components
from tidemark.llm.frames import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
SCHEMA = "doc_id bigint, text string"


def words(text):
    return WORD.findall((text or "").translate(LOWER))


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


# components


def union_find(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_components(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(40, 70)] + [(100, i) for i in range(101, 140)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)] + [(7, 7)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == union_find({x for e in links for x in e}, links)


# near-duplicates


def shingle_set(text, n):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute_groups(texts, n):
    sets = {i: shingle_set(t, n) for i, t in texts.items()}
    at = collections.defaultdict(list)
    for i, s in sets.items():
        for v in s:
            at[v].append(i)
    links = []
    for i, s in sets.items():
        shared = collections.Counter(j for v in s for j in at[v] if j < i)
        links += [(i, j) for j, k in shared.items() if 100 * k >= 80 * (len(s) + len(sets[j]) - k)]
    return sets, union_find(sets, links)


def check_groups(df, texts, settings):
    sets, groups = brute_groups(texts, settings.shingle)
    for r in neardup.near_duplicates(df, settings=settings).collect():
        i = r["doc_id"]
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[i]), groups[i], groups[i] == i)


def test_groups_are_brute_force(docs):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for n in (4, 5):
        check_groups(docs, texts, neardup.Settings(shingle=n))


def family(rng, size, n_words, edits):
    """A base text, copies with a few random words, and copies of copies near the limit."""
    base = [f"w{rng.randrange(9999)}" for _ in range(n_words)]
    out = [base]
    for _ in range(size - 1):
        t = list(rng.choice(out) if rng.random() < 0.3 else base)
        for _ in range(rng.randrange(edits)):
            t[rng.randrange(len(t))] = f"x{rng.randrange(10**6)}"
        out.append(t)
    return [" ".join(t) for t in out]


def test_large_families_lose_no_link(spark):
    rng = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [passage + " " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(30)) for _ in range(40)]
    rows += family(rng, 120, 150, 12) + family(rng, 60, 400, 30) + family(rng, 40, 20, 3) + [rows[0]] * 25
    rng.shuffle(rows)
    texts = dict(enumerate(rows))
    df = spark.createDataFrame(list(texts.items()), SCHEMA)
    check_groups(df, texts, neardup.Settings(shingle=4, short=4, block=16))


def test_a_row_without_an_id_links_others(spark):
    base = [f"w{k}" for k in range(100)]
    tail, head = [f"x{k}" for k in range(6)], [f"y{k}" for k in range(6)]
    a, b, c = (" ".join(x) for x in (base, [*base[:-6], *tail], [*head, *base[6:-6], *tail]))
    sets = [shingle_set(t, 4) for t in (a, b, c)]
    jaccard = lambda x, y: len(x & y) / len(x | y)
    assert jaccard(sets[0], sets[1]) >= 0.8 and jaccard(sets[1], sets[2]) >= 0.8 > jaccard(sets[0], sets[2])
    rows = [(1, a), (None, b), (3, c), (None, "nothing like it at all")]
    got = neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA), settings=neardup.Settings(shingle=4)).collect()
    assert sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in got), key=str) == sorted([(1, 1, True), (None, 1, True), (3, 1, False), (None, None, True)], key=str)


def test_estimates_of_blocks_are_those_of_pairs():
    rng = random.Random(4)
    sets = []
    for n in (5, 40, 128, 129, 200, 300, 1000):
        sets.append(np.array(sorted(rng.sample(range(1, 2000), n)), dtype=np.uint64))
        sets.append(np.unique(np.concatenate((sets[-1][: n * 3 // 4], np.array(rng.sample(range(2000, 4000), n // 8 + 1), dtype=np.uint64)))))
    n = np.array([len(x) for x in sets])
    got = neardup.block_estimates([x[:128] for x in sets], [x[:128] for x in sets], n, n, 128)
    want = [[neardup.union_similarity(x, y, 128) for y in sets] for x in sets]
    assert np.allclose(got, want, atol=1e-6)
    whole = [[len(set(x) & set(y)) / len(set(x) | set(y)) for y in sets[:4]] for x in sets[:4]]
    assert np.allclose([w[:4] for w in want[:4]], whole)


def test_near_duplicate_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n "), (4, "a"), (5, "A"), (6, "a b c"), (7, "a b c"), (7, "a b c"), (None, "q r s t u v"), (9, "word " * 30_000), (10, "word " * 30_001)]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", component_id string")
    got = collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(df).collect())
    assert got == {(1, 0, 1, True): 1, (2, 0, 2, True): 1, (3, 0, 3, True): 1, (4, 1, 4, True): 1, (5, 1, 4, False): 1, (6, 1, 6, True): 1, (7, 1, 6, False): 2, (None, 2, None, True): 1, (9, 1, 9, True): 1, (10, 1, 9, False): 1}
    assert neardup.near_duplicates(df.limit(0)).isEmpty()


# line dedup


def test_patience_is_a_common_subsequence():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.randrange(8) for _ in range(rng.randrange(12))] for _ in range(2))
        got = linededup.patience(a, b)
        assert all(a[i] == b[j] for i, j in got)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:]))
        assert len(linededup.patience(a, a)) == len(a)


def brute_removed(rows):
    """Positions to delete per id: lines of blocks that any earlier text holds, by comparing all pairs of texts."""
    by_text, order = {}, sorted((i, t) for i, t in rows if t is not None)
    for i, t in order:
        by_text.setdefault(t, i)
    lines = {t: [tuple(WORD.findall(x)) for x in t.split("\n")] for t in by_text}
    holders = collections.defaultdict(set)
    for t, ls in lines.items():
        for x in ls:
            holders[x].add(t)
    out = {}
    for i, t in order:
        own = lines[t]
        if i != by_text[t]:
            out[i] = list(range(len(own))) if len(WORD.findall(t)) >= linededup.BLOCK_WORDS else []
            continue
        gone = set()
        for o in set().union(*(holders[x] for x in own if x)) - {t}:
            if by_text[o] > i:
                continue
            before = {}
            for p, x in enumerate(lines[o]):
                now = {q: before.get(q - 1, 0) + 1 for q, y in enumerate(own) if x == y}
                for q, n in now.items():
                    if sum(map(len, own[q - n + 1 : q + 1])) >= linededup.BLOCK_WORDS:
                        gone.update(k for k in range(q - n + 1, q + 1) if own[k])
                before = now
        blank = [k for k, x in enumerate(own) if not x]
        for k in blank:
            left = next((p for p in range(k, -1, -1) if own[p]), None)
            right = next((p for p in range(k, len(own)) if own[p]), None)
            if left in gone and right in gone:
                gone.add(k)
        out[i] = sorted(gone)
    return out


def removed(spark, rows):
    return {r["doc_id"]: r["removed_lines"] for r in linededup.dedup_lines(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_removed_lines_are_brute_force(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = brute_removed(rows)
    texts = dict(rows)
    for r in linededup.dedup_lines(docs).collect():
        assert r["removed_lines"] == want[r["doc_id"]]
        kept = [x for k, x in enumerate(texts[r["doc_id"]].split("\n")) if k not in set(r["removed_lines"])]
        assert r["text"] == "\n".join(kept)


def test_shuffled_blocks_are_brute_force(spark):
    rng = random.Random(6)
    pool = [" ".join(f"p{k}w{j}" for j in range(rng.choice([1, 3, 4, 9]))) for k in range(30)] + ["", " "]
    rows = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.8 else f"own {i} {k}" for k in range(rng.randrange(30)))) for i in range(60)]
    rows += [(60 + i, "\n".join(pool[k % 30] for k in range(5 * i, 5 * i + 12))) for i in range(8)]
    assert removed(spark, rows) == brute_removed(rows)


def test_lines_that_repeat_within_a_document(spark):
    r1, r2 = (f"{x} line of nine words that comes more often" for x in ("first", "second"))
    rows = [(1, "\n".join(["a", r1, r2, r1, r2, "b"])), (2, "\n".join([r1, r2, r1, r2, "c"])), (3, "\n".join([r2, "d", r1]))]
    assert removed(spark, rows) == {1: [], 2: [0, 1, 2, 3], 3: [0, 2]} == brute_removed(rows)


def test_later_holders_of_a_block_that_two_others_hold_in_parts(spark):
    rows = [(1, "a b c d e"), (2, "f g h i j"), (3, "a b c d e\nf g h i j"), (4, "a b c d e\nf g h i j")]
    rows[3] = (4, "x\n" + rows[3][1])
    assert removed(spark, rows) == {1: [], 2: [], 3: [], 4: [1, 2]}


def test_a_block_of_short_lines_goes_however_many_hold_it(spark):
    passage = [f"word{k} of a licence in six" for k in range(9)]
    rows = [(i, "\n".join([f"own first {i}", *passage, f"own last {i}"])) for i in range(130)]
    assert removed(spark, rows) == {i: list(range(1, 10)) if i else [] for i in range(130)}


def test_the_first_holder_of_a_block_is_a_partner(spark):
    block = ["one two three four five", "six seven eight nine ten", "a b c d"]
    short = ["p q r", "s t u", "v w x"]  # no line that is looked for by itself
    rows = [(1, f"{block[0]}\nalpha"), (2, f"beta\n{block[1]}"), (3, "\n".join(["gamma", *block, "", *short])), (4, "\n".join([*block, "delta"])), (5, "\n".join(["epsilon", *short, "zeta"]))]
    got = {r["doc_id"]: r["removed_lines"] for r in linededup.dedup_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: [], 2: [], 3: [], 4: [0, 1, 2], 5: [1, 2, 3]}
    long = "one line that has eight words in it"
    rows = [(1, long), (2, f"{long}\nx"), (3, f"{long}\nx\ny")]
    got = {r["doc_id"]: r["removed_lines"] for r in linededup.dedup_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: [], 2: [0], 3: [0, 1]}


def test_line_dedup_edges(spark):
    passage = "\n".join(f"line {k} of a passage that repeats here" for k in range(8))
    rows = [(1, None), (2, ""), (3, "short\nlines"), (4, "short\nlines"), (5, f"a b c\n{passage}\nend"), (6, f"other start\n{passage}"), (7, passage), (8, passage), (8, passage), (None, "only this line has quite a few words in it")]
    df = spark.createDataFrame([(i, t, "keep") for i, t in rows], SCHEMA + ", removed_lines string")
    got = linededup.dedup_lines(df).collect()
    by = {r["doc_id"]: r["text"] for r in got}
    assert len(got) == len(rows) and by[1] is None and by[2] == "" and by[4] == "short\nlines"
    assert by[5].startswith("a b c\nline 0") and by[6] == "other start" and by[7] == "" and by[8] == ""
    assert linededup.dedup_lines(df.limit(0)).isEmpty()


# Katz


def brute_katz(rows):
    """(counts and scores per row, P(word | history), vocabulary, histories) by dictionaries over plain words."""
    c, pairs, hist = collections.Counter(), collections.Counter(), collections.Counter()
    split = lambda t: [*words(t), "\n"]
    docs = 0
    for t, held in rows:
        if not held:
            s = split(t)
            c.update(s)
            pairs.update(zip(["\t", *s[:-1]], s))
            hist.update(["\t", *s[:-1]])
            docs += 1
    total = sum(c.values())
    disc = lambda v, d: v * (d[v] if v <= katz.DISCOUNTED else 1)
    d1, d2 = (katz.good_turing(collections.Counter(x.values())) for x in (c, pairs))
    kept1 = sum(disc(v, d1) for v in c.values())
    scale1 = total if total - kept1 >= 0.5 else kept1 + 0.5
    p1 = lambda w: disc(c[w], d1) / scale1 if c[w] else 1 - kept1 / scale1 if total else 1.0
    kept, covered = collections.Counter(), collections.Counter()
    for (a, b), v in pairs.items():
        kept[a] += disc(v, d2)
        covered[a] += p1(b)

    def p2(a, b):
        if not hist[a]:
            return p1(b)
        scale = hist[a] if hist[a] - kept[a] >= 0.5 else kept[a] + 0.5
        v = pairs.get((a, b), 0)
        return disc(v, d2) / scale if v else (1 - kept[a] / scale) / (1 - covered[a]) * p1(b)

    out = []
    for t, _ in rows:
        s = split(t)
        score = sum(math.log10(p2(a, b)) for a, b in zip(["\t", *s[:-1]], s))
        base = sum(math.log10((c[x] + 0.5) / (total + 0.5 * (len(c) + 1))) for x in s)
        out.append((len(s), sum(c[x] > 0 for x in s), total, base, score))
    return out, p2, list(c), list(hist)


def test_katz_is_brute_force_and_normalised(spark, docs, sf_dir, monkeypatch):
    monkeypatch.setattr(katz, "PART_TOKENS", 40_000)
    monkeypatch.setattr(katz, "BLOCK_TOKENS", 20_000)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows}
    want, p2, vocabulary, hist = brute_katz([(t, held[i]) for i, t in rows])
    got = {r["doc_id"]: r for r in katz.op3_katz(spark, sf_dir).collect()}
    for (i, _), w in zip(rows, want, strict=True):
        r = got[i]
        assert r["held_out"] == held[i] and (r["n_tokens"], r["n_known"], r["train_tokens"]) == w[:3]
        assert r["base_score"] == pytest.approx(w[3], abs=1e-6) and r["score"] == pytest.approx(w[4], abs=1e-6)
    for a in [*hist[:20], *hist[-20:], "never seen"]:
        assert sum(p2(a, b) for b in [*vocabulary, "unseen type"]) == pytest.approx(1.0)
    out = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_katz_edges(spark):
    rows = [(1, None), (2, ""), (3, "a b a b a b"), (3, "a b a b a b"), (4, "B a"), (None, "a c"), (5, "never seen"), (6, "a " * 70_000)]
    df = spark.createDataFrame([(i, t, 1.0) for i, t in rows], SCHEMA + ", score double")
    held = F.col("doc_id").isin(4, 5, 2)
    want, *_ = brute_katz([(t, i in (4, 5, 2) or i is None) for i, t in rows])
    got = sorted((r["doc_id"] or 0, r["n_tokens"], r["n_known"], round(r["base_score"], 4), round(r["score"], 4)) for r in katz.katz_scores(df, held).collect())
    assert got == sorted((i or 0, w[0], w[1], round(w[3], 4), round(w[4], 4)) for (i, _), w in zip(rows, want))
    nothing = katz.katz_scores(df, F.lit(True)).collect()
    assert len(nothing) == len(rows) and all(r["n_known"] == 0 and r["score"] == 0 for r in nothing)
    assert katz.katz_scores(df.limit(0), held).isEmpty()


def test_katz_vocabulary_does_not_shrink_as_the_corpus_grows(spark):
    rows = [(1, "u v u v"), (2, "a " * 1_200_000), (3, "u v a"), (4, "v u new")]
    got = {r["doc_id"]: r["score"] for r in katz.katz_scores(spark.createDataFrame(rows, SCHEMA), F.col("doc_id") > 2).collect()}
    want, *_ = brute_katz([(t, i > 2) for i, t in rows])
    assert got == {i: pytest.approx(w[4], abs=1e-6) for (i, _), w in zip(rows, want)}


def test_katz_discounts_leave_the_good_turing_mass():
    n = {1: 100.0, 2: 40.0, 3: 20.0, 4: 12.0, 5: 8.0, 6: 5.0}
    d = katz.good_turing(n)
    assert all(0 < d[r] < 1 for r in range(1, 6))
    assert sum(r * n[r] * (1 - d[r]) for r in range(1, 6)) == pytest.approx(n[1])


# pipeline


def test_pipeline_is_its_stages(spark, sf_dir, docs):
    import public_tokenizers
    from test_text_operators import brute_hits
    from tokenizers import Tokenizer

    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    texts = {i: t for i, t in rows if any(c.isalpha() for c in t or "")}
    gone = brute_removed(sorted(texts.items()))
    cut = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in set(gone[i])) for i, t in texts.items()}
    cut = {i: t for i, t in cut.items() if WORD.search(t)}
    _, groups = brute_groups(cut, 5)
    kept = {i: t for i, t in cut.items() if groups[i] == i}
    items = [(r["item_id"], r["text"]) for r in table(spark, sf_dir, "benchmark").collect()]
    clean = {i: t for i, t in kept.items() if brute_hits(t, items)[1] == 0}
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    lib.no_truncation()
    found = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert set(found) == set(clean)
    for i, t in clean.items():
        ids = lib.encode(t, add_special_tokens=False).ids
        assert found[i]["ids"] == ids and found[i]["decoded_sha256"] == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_near_dedup_tells_rows_of_one_id_apart(spark, sf_dir):
    near = " ".join(f"w{k}" for k in range(60))
    rows = [(3, near), (5, near), (5, "a text that nothing else is like at all"), (None, None), (7, near + " more"), (7, None)]
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, SCHEMA), sf_dir).collect()
    assert sorted(map(tuple, got), key=str) == sorted([rows[0], rows[2], rows[3], rows[5]], key=str)


def test_near_dedup_keeps_one_of_equal_rows(spark, sf_dir):
    near, lone = " ".join(f"w{k}" for k in range(60)), "a text that nothing else is like at all"
    rows = [(5, near), (5, near), (9, near + " more"), (9, lone), (9, lone), (None, "also twice in the table here"), (None, "also twice in the table here"), (4, ""), (4, "")]
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, SCHEMA), sf_dir).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(5, near), (9, lone), (None, "also twice in the table here"), (4, ""), (4, "")], key=str)


def test_stages_keep_the_columns_and_take_odd_rows(spark, sf_dir):
    rows = [(1, None, "en", "s", 0), (2, "", None, None, None), (3, "123 456", "en", "s", 7), (4, "Der die das und der die Straße ist hier", None, "s", 1), (4, "Der die das und der die Straße ist hier", None, "s", 1), (None, "the of and to in is that for was a word", "en", "s", 2)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for name, stage in corpus_pipeline.STAGES:
        for d in (df, df.limit(0)):
            out = stage(spark, d, sf_dir)
            out.collect()
            assert name == "bpe" or out.columns == df.columns
