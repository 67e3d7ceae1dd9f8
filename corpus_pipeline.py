"""A corpus pipeline: quality rules, near-duplicate removal, passage removal, mixing, encoding.

Each stage is a function of (spark, docs, sf_dir) that applies one operator to all its
predecessor kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

import public_tokenizers
from entloom.llm import bpe_tree, compact_windows, quality_mcd, source_mix, trie_join
from entloom.llm.common import stored, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality_mcd.keep_clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity of 0.8 or more."""
    return trie_join.one_of_each(docs, n=5, num=4, den=5)


def recurring_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that an earlier document has are cut."""
    return compact_windows.cut_passages(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources to their target weights; a row for each run of words that the mix takes."""
    return source_mix.mix_documents(docs, weights=(1, 2, 3))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, with their digests and those of the decoded text."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe_tree.bpe_encode(docs, ranks, public_tokenizers.PATTERN, carry=("lang", "source")).drop("decoded")


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", recurring_passages),
    ("mixing sources", source_mixing),
    ("byte-level BPE", encoding),
]

#: SQL has no estimate of scatter, no components and no merges by rank: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`, each written as Parquet to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
