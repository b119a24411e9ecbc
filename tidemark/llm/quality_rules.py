"""Quality rules by distribution divergence, in DataFrame functions only.

Two histograms of a document, of character classes and of common words, are compared with
the references of its language by the Jensen-Shannon distance (base 2, so in [0, 1]).  The
references are the pooled histograms of all documents of the language, and the common
words are those that the language uses most, counted by hashed cells.  A document without
a language is compared with all documents together.  A distance is only judged on texts
of a minimum length.

The texts are read twice: for the cells of the words, then for counts and histograms, which
are written.  References are tables joined by language, so neither their number nor the
plan's size grows on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import materialise, table

#: Words of a repeated window, a power of two.
WINDOW = 8
#: Base limits.
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
#: Hash cells of words, and the cells of a language's most frequent words that
#: its histogram has besides one for all others.
CELLS, COMMON = 1 << 14, 32
#: Names of the character classes, in histogram order.
CLASSES = ["other", "upper", "digit", "blank", "symbol", "punctuation"]
#: Largest class distance to the reference, and from how many characters on it is judged.
MAX_CLASS_DISTANCE, CLASS_GUARD = 0.25, 300
#: The same for words.  A sample of n words strays from its own language by about
#: 1 / sqrt(n), so the limit is MAX_WORD_DISTANCE + WORD_SLACK / sqrt(n).
MAX_WORD_DISTANCE, WORD_SLACK, WORD_GUARD = 0.18, 1.6, 20
#: The group of all documents, which those without a language are compared with.
ALL = ""


def word_array(text: Column) -> Column:
    """Words of `[^\\x20\\x09-\\x0D]+`."""
    return F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")


def bound(value: Column, use) -> Column:
    """use(value), with the value computed once however often `use` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def repeated_words(words: Column) -> Column:
    """Words inside WINDOW-word windows that occur twice or more, the first included; `words` may be hashes."""
    size = WINDOW

    def doubled(hashes: Column, gap: int) -> Column:
        """From hashes of `gap` words those of twice as many; the last ones, of too few, are left over."""
        return bound(hashes, lambda h: F.zip_with(h, F.slice(h, F.lit(gap + 1), F.size(h)), lambda x, y: F.xxhash64(x, y)))

    windows = words
    for k in range(size.bit_length() - 1):
        windows = doubled(windows, 1 << k)
    windows = F.slice(windows, F.lit(1), F.size(words) - (size - 1))

    def covered(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        same = lambda held, x, j: (F.get(held, j - 1)["h"] == x["h"]) | (F.get(held, j + 1)["h"] == x["h"])
        marked = bound(pairs, lambda held: F.transform(held, lambda x, j: F.when(same(held, x, j), x["i"])))
        doubled = F.filter(marked, lambda i: i.isNotNull())
        start = F.struct(F.lit(-size).alias("last"), F.lit(0).cast("bigint").alias("n"))
        step = lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(size), i - a["last"])).alias("n"))
        return F.aggregate(F.array_sort(doubled), start, step, lambda a: a["n"])

    none = F.lit(0).cast("bigint")
    once = bound(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(covered(h)))
    return F.when(F.size(words) < size, none).otherwise(once)


def _cell(hashed: Column) -> Column:
    return F.pmod(hashed, F.lit(CELLS)).cast("int")


def _keyed(docs: DataFrame, id_col: str, text_col: str, lang_col: str | None) -> DataFrame:
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit(ALL)) if lang_col else F.lit(ALL)
    return docs.select(F.col(id_col).alias("doc_id"), lang.alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def _with_all(counts: DataFrame, *keys: str) -> DataFrame:
    """Sums n by language and keys, those of all languages under ALL."""
    sums = counts.where(F.col("lang") != ALL)
    return sums.union(counts.groupBy(F.lit(ALL).alias("lang"), *keys).agg(F.sum("n").alias("n")).select(*counts.columns))


def common_words(own: DataFrame) -> DataFrame:
    """lang, cells (the most frequent ones, at most COMMON), word_reference (their shares and that of the others)."""
    counts = own.select("lang", F.explode(word_array(F.col("text"))).alias("word")).groupBy("lang", _cell(F.xxhash64("word")).alias("cell")).agg(F.count("*").alias("n"))
    counts = _with_all(materialise(counts, "cells"), "cell")
    by_lang = Window.partitionBy("lang")  # of CELLS rows at most
    place = F.row_number().over(by_lang.orderBy(F.desc("n"), "cell"))
    ranked = counts.select("lang", "cell", "n", place.alias("place"), F.sum("n").over(by_lang).alias("total")).where(F.col("place") <= COMMON)
    held = ranked.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("place", "cell", "n"))).alias("top"), F.first("total").alias("total"))
    part = F.transform("top", lambda x: x["n"] / F.col("total"))
    rest = F.lit(1.0) - F.aggregate(part, F.lit(0.0), lambda a, x: a + x)
    return materialise(held.select("lang", F.col("top.cell").alias("cells"), F.concat(part, F.array(F.greatest(rest, F.lit(0.0)))).alias("word_reference")), "common")


def _marks(common: DataFrame) -> Column:
    """An array that has for each cell of a common word a character of its own, and for others none.

    What the driver gets is bounded by CELLS.
    """
    cells = [r[0] for r in common.select(F.explode("cells")).distinct().collect()]
    marks = [""] * CELLS
    for k, c in enumerate(sorted(cells)):
        marks[c] = chr(0x4E00 + k)
    return F.split(F.lit(",".join(marks)), ",")


def features(docs: DataFrame, common: DataFrame | None = None, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """Counts and histograms of each row; a null text is empty.  common: see common_words."""
    own = _keyed(docs, id_col, text_col, lang_col)
    common = common_words(own) if common is None else common
    marks = _marks(common)
    text, words = F.col("text"), F.col("words")
    count = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("bigint")
    with_word = F.filter(F.split(text, "\n"), lambda line: line.rlike("[^\\x20\\x09-\\x0D]"))
    own = own.select(
        "doc_id",
        "lang",
        word_array(text).alias("words"),
        F.length(text).cast("bigint").alias("n_chars"),
        count("[#*$%&|<>]").alias("n_symbols"),
        bound(with_word, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
        count("\\p{Lu}").alias("upper"),
        count("[0-9]").alias("digit"),
        count("[!-/:-@\\[-`{-~]").alias("signs"),
    )
    own = own.select(
        "*",
        F.size(words).cast("bigint").alias("n_words"),
        F.length(F.array_join(words, "")).cast("bigint").alias("word_chars"),
        F.transform(words, lambda w: F.xxhash64(w)).alias("hashes"),
    ).drop("words")
    own = own.select(
        "*",
        repeated_words(F.col("hashes")).alias("n_repeat_words"),
        F.array_join(F.transform("hashes", lambda h: F.get(marks, _cell(h))), "").alias("marked"),
    ).drop("hashes")
    own = own.join(common.select("lang", F.transform("cells", lambda c: F.get(marks, c)).alias("own_marks")), "lang", "left")
    times = F.transform("own_marks", lambda m: (F.length("marked") - F.length(F.replace(F.col("marked"), m, F.lit("")))).cast("bigint"))
    blank = F.col("n_chars") - F.col("word_chars")
    other = F.col("word_chars") - F.col("upper") - F.col("digit") - F.col("signs")
    counted = bound(times, lambda x: F.concat(x, F.array(F.col("n_words") - F.aggregate(x, F.lit(0).cast("bigint"), lambda a, n: a + n))))
    return own.select(
        "doc_id", "lang", "n_chars", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        F.array(other, F.col("upper"), F.col("digit"), blank, F.col("n_symbols"), F.col("signs") - F.col("n_symbols")).alias("classes"),
        counted.alias("common"),
    )


def references(found: DataFrame, common: DataFrame) -> DataFrame:
    """lang, class_reference, word_reference: one row per language and one for all."""
    sums = found.groupBy("lang").agg(*[F.sum(F.get("classes", F.lit(k))).alias(f"a{k}") for k in range(len(CLASSES))])
    sums = sums.select("lang", F.array(*[f"a{k}" for k in range(len(CLASSES))]).alias("n"))
    every = sums.agg(*[F.sum(F.get("n", F.lit(k))).alias(f"a{k}") for k in range(len(CLASSES))])
    every = every.select(F.lit(ALL).alias("lang"), F.array(*[f"a{k}" for k in range(len(CLASSES))]).alias("n"))
    classes = sums.where(F.col("lang") != ALL).union(every).select("lang", shares(F.col("n")).alias("class_reference"))
    return materialise(classes.join(common.select("lang", "word_reference"), "lang", "left"), "references")


def shares(counts: Column) -> Column:
    """The histogram as shares of its total; null for an empty one."""
    total = F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return bound(F.nullif(total, F.lit(0)), lambda n: F.transform(counts, lambda x: x / n))


def js_distance(shares: Column, reference: Column) -> Column:
    """Jensen-Shannon distance of shares to a reference; null if either is null."""
    log2 = lambda p, m: F.when(p > 0, p * F.log2(p / m)).otherwise(F.lit(0.0))
    part = lambda p, q: (log2(p, (p + q) / 2) + log2(q, (p + q) / 2)) / 2
    terms = F.aggregate(F.zip_with(shares, reference, part), F.lit(0.0), lambda a, x: a + x)
    return F.sqrt(F.greatest(terms, F.lit(0.0)))


def verdict(found: DataFrame, refs: DataFrame) -> DataFrame:
    """Adds class_distance and word_distance to the language's reference, base_failed and kept."""
    found = found.join(refs, "lang", "left")  # Spark broadcasts refs if they are small
    a = F.when(F.col("class_reference").isNotNull(), js_distance(shares(F.col("classes")), F.col("class_reference")))
    b = F.when(F.col("word_reference").isNotNull(), js_distance(shares(F.col("common")), F.col("word_reference")))
    found = found.withColumns({"class_distance": a, "word_distance": b})
    words_far = F.col("word_distance") > MAX_WORD_DISTANCE + WORD_SLACK / F.sqrt(F.greatest(F.col("n_words"), F.lit(1)))
    far = ((F.col("n_chars") >= CLASS_GUARD) & (F.col("class_distance") > MAX_CLASS_DISTANCE)) | ((F.col("n_words") >= WORD_GUARD) & words_far)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & ~F.coalesce(far, F.lit(False))).alias("kept"), "class_distance", "word_distance",
    )


def quality(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """Counts, distances and verdict of each row of docs.

    Null and empty texts have no words, fail the base and have no distances.  Rows without
    a language, or all if lang_col is None, are compared with all documents.  Of equally
    frequent words the one with the lesser cell is the more common.  A text of any length
    is counted whole.  Null and repeated ids are as good as any: each row gets a row; an
    empty table gives none.
    """
    columns = {"id_col": id_col, "text_col": text_col, "lang_col": lang_col}
    common = common_words(_keyed(docs, **columns))
    found = materialise(features(docs, common, **columns), "quality")
    return verdict(found, references(found, common))


def op9_quality(spark, sf_dir: str) -> DataFrame:
    """Quality rules on all documents: one row per row of `documents`, null texts empty.  See quality."""
    return quality(table(spark, sf_dir, "documents"))
