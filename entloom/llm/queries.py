"""The queries `opN_<name>`: each applies its operator to a whole table and returns the full result."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from entloom.llm import compact_windows, context_mixing, cuckoo_dedup, merkle_manifest, quality_mcd, slot_sharding, source_mix, subword_quality, token_alignment, trie_join, weighted_fingerprints
from entloom.llm.arc_warc import archive_digest
from entloom.llm.bpe_tree import bpe_encode
from entloom.llm.common import id_crc, table


def op6_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bpe_encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=False)


def op1_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_mixing.score(table(spark, sf_dir, "documents"))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix_plan(table(spark, sf_dir, "documents"), weights=(1, 2, 3))


def op3_trie_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_join.jaccard_components(table(spark, sf_dir, "documents"))


def op4_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compact_windows.find_passages(table(spark, sf_dir, "documents")).drop("key")


def op5_quality_mcd(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    return quality_mcd.judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance2")


def op7_slot_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    placed = slot_sharding.assign_shards(docs, [f"shard-{i:04d}" for i in range(256)])
    return placed.select("doc_id", F.col("__slot").alias("slot"), F.col("__shard").alias("shard"))


def op8_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = subword_quality.train(docs, table(spark, sf_dir, "labels"))
    return subword_quality.score(docs, model)


def op9_weighted_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted_fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op10_arc_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_digest(table(spark, sf_dir, "pages"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.col("doc_id").isNotNull() & (id_crc(F.col("doc_id")) % 7 == 0)
    rows = merkle_manifest.manifest(docs, changed=(tampered, {"n_chars": F.col("n_chars") + 1}))
    return merkle_manifest.verified(rows).withColumnRenamed("key", "doc_id")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_alignment.alignment(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_cuckoo_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cuckoo_dedup.dedup(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_context_mixing": op1_context_mixing,
    "op2_source_mix": op2_source_mix,
    "op3_trie_join": op3_trie_join,
    "op4_compact_windows": op4_compact_windows,
    "op5_quality_mcd": op5_quality_mcd,
    "op6_bpe_tree": op6_bpe_tree,
    "op7_slot_sharding": op7_slot_sharding,
    "op8_subword_quality": op8_subword_quality,
    "op9_weighted_fingerprints": op9_weighted_fingerprints,
    "op10_arc_warc": op10_arc_warc,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_token_alignment": op12_token_alignment,
    "op13_cuckoo_dedup": op13_cuckoo_dedup,
}

#: DuckDB SQL for the queries that SQL can express over whole tables.
ORACLE_SQL: dict[str, str] = {
    "op3_trie_join": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), s AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w
        ), g AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
        l AS (
            SELECT x.doc_id AS a, y.doc_id AS b FROM g x JOIN g y ON x.g = y.g AND x.doc_id <> y.doc_id AND 10 * x.n >= 9 * y.n AND 10 * y.n >= 9 * x.n
            GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 90 * (x.n + y.n - count(*))
        ), r(id, far) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.id, l.b FROM r JOIN l ON r.far = l.a)
        SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, c.component_id FROM s JOIN (SELECT id, min(far) AS component_id FROM r GROUP BY id) c ON c.id = s.doc_id
    """,
    "op10_arc_warc": """
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS x FROM pages),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY x, payload_bytes) AS first_id FROM p)
        SELECT page_id, payload_bytes,
            array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(x, CAST((i // 8) * 10 + 1 AS BIGINT), 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS BIGINT)) & 31) + 1 AS BIGINT), 1)), '') AS payload_digest,
            CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_id THEN first_id END AS refers_to
        FROM f
    """,
    "op11_merkle_manifest": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, coalesce('v' || lang, 'n') AS g, n_chars IS NOT NULL AND coalesce(xor(list_reduce(
                    list_concat([4294967295::BIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
                    lambda a, c: list_reduce(list_concat([xor(a, c)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda r, z: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END)
                ), 4294967295) % 7 = 0, FALSE) AS tampered,
                [CAST(doc_id AS VARCHAR), source, lang, CAST(n_chars AS VARCHAR), text] AS v, [CAST(doc_id AS VARCHAR), source, lang, CAST(n_chars + 1 AS VARCHAR), text] AS w
            FROM documents
        ), e AS (
            SELECT doc_id, g, sha256(array_to_string(list_transform(v, lambda x: CASE WHEN x IS NULL THEN '-' ELSE strlen(x) || ':' || x END), '')) AS leaf,
                CASE WHEN tampered THEN sha256(array_to_string(list_transform(w, lambda x: CASE WHEN x IS NULL THEN '-' ELSE strlen(x) || ':' || x END), '')) END AS changed
            FROM d
        ), leaves AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM e),
        low(lv, g, pos, n, h) AS (
            SELECT 0, g, pos, n, leaf FROM leaves
            UNION ALL SELECT lv + 1, g, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM low WHERE n > 1 GROUP BY lv, g, pos // 2, n
        ), subroots AS (SELECT g, h AS subroot, lv AS height, row_number() OVER (ORDER BY g) - 1 AS place, count(*) OVER () AS n FROM low WHERE n = 1),
        high(lv, pos, n, h) AS (
            SELECT 0, place, n, subroot FROM subroots
            UNION ALL SELECT lv + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM high WHERE n > 1 GROUP BY lv, pos // 2, n
        ), steps AS (
            SELECT l.g, l.pos, x.lv, l.pos >> x.lv AS spot, s.h AS sibling FROM leaves l JOIN (SELECT DISTINCT g, lv FROM low WHERE n > 1) x ON x.g = l.g
                LEFT JOIN low s ON s.g = l.g AND s.lv = x.lv AND s.pos = xor(l.pos >> x.lv, 1)
            UNION ALL
            SELECT l.g, l.pos, r.height + x.lv, r.place >> x.lv, s.h FROM leaves l JOIN subroots r ON r.g = l.g JOIN (SELECT DISTINCT lv FROM high WHERE n > 1) x ON TRUE
                LEFT JOIN high s ON s.lv = x.lv AND s.pos = xor(r.place >> x.lv, 1)
        ), proofs AS (
            SELECT g, pos, list(struct_pack(l := (spot % 2 = 1), s := coalesce(sibling, '')) ORDER BY lv) AS steps, string_agg(coalesce(sibling, ''), '' ORDER BY lv) AS proof FROM steps GROUP BY g, pos
        ), folds(g, pos, i, h) AS (
            SELECT g, pos, 0, coalesce(changed, leaf) FROM leaves
            UNION ALL SELECT f.g, f.pos, f.i + 1, sha256(CASE WHEN p.steps[f.i + 1].l THEN p.steps[f.i + 1].s || f.h ELSE f.h || p.steps[f.i + 1].s END)
            FROM folds f JOIN proofs p ON p.g = f.g AND p.pos = f.pos WHERE f.i < len(p.steps)
        ), ends AS (SELECT g, pos, arg_max(h, i) AS h FROM folds GROUP BY g, pos), top AS (SELECT h FROM high WHERE n = 1)
        SELECT l.doc_id, l.leaf, r.subroot, top.h AS root, sha256(coalesce(p.proof, '')) AS proof_sha256, ends.h AS folded_root, ends.h = top.h AS verified
        FROM leaves l JOIN subroots r ON r.g = l.g JOIN top ON TRUE JOIN ends ON ends.g = l.g AND ends.pos = l.pos LEFT JOIN proofs p ON p.g = l.g AND p.pos = l.pos
    """,
    "op13_cuckoo_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, coalesce(doc_id = max(doc_id) OVER w, FALSE) AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
    """,
}
