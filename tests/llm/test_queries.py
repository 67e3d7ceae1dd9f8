"""The registered queries over the smallest tables, against their SQL where there is one."""

import glob
import os

import duckdb
import pytest

import __spark_entry__
from entloom.llm import queries

COLUMNS = {
    "op1_context_mixing": {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"},
    "op2_source_mix": {"doc_id", "size", "source_size", "target", "taken"},
    "op3_trie_join": {"doc_id", "n_shingles", "component_id"},
    "op5_quality_mcd": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"},
    "op6_bpe_tree": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
    "op8_subword_quality": {"doc_id", "held_out", "score", "predicted"},
    "op9_weighted_fingerprints": {"doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"},
    "op10_arc_warc": {"page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"},
    "op11_merkle_manifest": {"doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"},
    "op12_token_alignment": {"doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"},
    "op13_cuckoo_dedup": {"doc_id", "keep_id", "group_size", "kept", "text_sha256"},
}


def test_all_are_registered():
    names = set(__spark_entry__.queries())
    assert {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{i}" for i in range(1, 14)}
    assert "pipeline" in names and set(__spark_entry__.oracle_sql()) <= names


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(spark, sf_dir, name):
    df = queries.QUERIES[name](spark, sf_dir)
    assert COLUMNS[name] <= set(df.columns)
    rows = df.collect()
    table = "pages" if name.startswith("op10_") else "documents"
    assert len(rows) == spark.read.parquet(f"{sf_dir}/{table}.parquet").count()
    if sql := queries.ORACLE_SQL.get(name):
        con = duckdb.connect()
        for f in glob.glob(sf_dir + "/*.parquet"):
            con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
        cur = con.execute(sql)
        at = [[d[0] for d in cur.description].index(c) for c in df.columns]
        assert sorted(map(tuple, rows), key=str) == sorted((tuple(r[i] for i in at) for r in cur.fetchall()), key=str)
