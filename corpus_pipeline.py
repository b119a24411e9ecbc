"""The corpus pipeline: stages applied to `documents`, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontaminate, langid, linededup, neardup
from tidemark.llm.frames import bound_batches, held_out, materialise, release, table

#: A document of which no language has this share of the letters is rejected.
MIN_LANGUAGE_SHARE = 0.4


def _with_length(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else docs


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has letters, mostly in one language; the others go.

    Null and empty texts have no letter and go.  Rows are judged one by one, so null or
    repeated ids do no harm; an empty table gives no rows.
    """
    bound_batches(spark)
    model = langid.train(docs.where(~held_out(F.col("doc_id"), 3)))
    rest = [c for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*rest).alias("doc_id"), "text")
    found = langid.identify(rows, model, keep_text=True)
    kept = found.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_LANGUAGE_SHARE))
    return kept.select(*[F.col("text" if c == "text" else f"doc_id.{c}").alias(c) for c in docs.columns])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks that an earlier document holds are cut out; a document that is left without a word goes.

    Null and empty texts stay as they are, as do rows equal in id and text.
    """
    bound_batches(spark)
    found = linededup.dedup_lines(docs)
    return _with_length(found.where(F.col("text").isNull() | F.col("text").rlike("[^\\x20\\x09-\\x0D]") | (F.size("removed_lines") == 0)).drop("removed_lines"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, 0.8): the one with the least id.

    Rows of one id are told apart by their texts; of such rows in one group the one with
    the least digest stays, and of rows equal in id and text any one.  Rows without an id
    come before all others.  Null and wordless texts are in no group and stay.
    """
    bound_batches(spark)
    rows = docs.select("doc_id", F.md5(F.col("text").cast("binary")).alias("t"), F.struct(*docs.columns).alias("row"))
    keys = rows.select(F.struct("doc_id", "t").alias("doc_id"), F.col("row.text").alias("text"))
    found = materialise(neardup.near_duplicates(keys), "groups").select(F.col("doc_id.doc_id").alias("at"), F.col("doc_id.t").alias("of"), "kept", "n_shingles")
    same = F.col("doc_id").eqNullSafe(F.col("at")) & (F.col("t") == F.col("of"))
    left = rows.join(found.where(~F.col("kept")).select("at", "of").distinct(), same, "left_anti")
    again = found.where(F.col("kept") & (F.col("n_shingles") > 0)).groupBy("at", "of").agg(F.count("*").alias("n")).where("n > 1").select("at", "of")
    again = materialise(again, "again")
    if again.isEmpty():
        return left.select("row.*")
    once = left.join(again, same, "left_semi").groupBy("doc_id", "t").agg(F.first("row").alias("row"))
    return left.join(again, same, "left_anti").select("row").union(once.select("row")).select("row.*")


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window.

    Null and empty texts have none.  Rows are judged one by one; without items all stay.
    """
    bound_batches(spark)
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids and the digest of the decoded text.

    A row for each row; null and empty texts have no ids.
    """
    bound_batches(spark)
    rows = docs.select(F.struct("doc_id", "lang", "source").alias("doc_id"), "text")
    found = bpe.encode(rows)
    return found.select("doc_id.*", "n_tokens", "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", benchmark_decontamination),
    ("bpe", bpe_encoding),
]

#: The stages run numpy models and searches, so no SQL; the tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to the documents, each stage's result written and reread."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, name)
            if k:
                release(before)
    return docs
