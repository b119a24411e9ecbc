"""The registered queries of the corpus operators: their columns, and their SQL where there is any."""

import zlib

import pytest
from compare import connection, rows

from tidemark.llm.frames import table
from tidemark.llm.queries import ORACLE_SQL, QUERIES

COLUMNS = {
    "op1_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op2_decontaminate": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    "op3_katz": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op4_token_counts": ["doc_id", "n_words", "n_tokens"],
    "op5_knn_quality": ["doc_id", "held_out", "score", "predicted"],
    "op6_neardup": ["doc_id", "n_shingles", "component_id", "kept"],
    "op7_linededup": ["doc_id", "n_removed", "removed_lines", "text_sha256"],
    "op8_pii": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    "op9_quality": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op10_langid": ["doc_id", "held_out", "lang_pred", "score"],
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_every_document_has_its_row(spark, sf_dir, name):
    found = QUERIES[name](spark, sf_dir).toPandas()
    assert list(found.columns[: len(COLUMNS[name])]) == COLUMNS[name]
    ids = [r["doc_id"] for r in table(spark, sf_dir, "documents").select("doc_id").collect()]
    assert sorted(found["doc_id"]) == sorted(ids)
    mod = {"op3_katz": 5, "op5_knn_quality": 3, "op10_langid": 3}.get(name)
    if mod:
        assert found["held_out"].tolist() == [zlib.crc32(str(i).encode()) % mod == 1 for i in found["doc_id"]]
    if name in ORACLE_SQL:
        wanted = connection(sf_dir).sql(ORACLE_SQL[name]).df()
        assert sorted(found.columns) == sorted(wanted.columns)
        assert rows(found) == rows(wanted)
