"""A corpus from raw documents to token ids: quality, exact and near duplicates, mixing, encoding.

Each stage takes what its predecessor kept, whole, and is written before the next one reads it.

Defined cases: a null text counts as empty in every stage; the classifier judges empty texts by their shape; the
first of equal texts by largest id stays (null ids last); documents without words are no near copies of each other;
rows with null or repeated ids are told apart by their text; very long texts are read whole; ties are broken by id
and text, so reruns agree; an empty table gives no rows in every stage; further columns, whatever their names, pass
through all stages but the last.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from marklens.llm import bpe, common, exact_dedup, jaccard_join, mixing, quality

#: The classifier and the encoding have no SQL.
ORACLE_SQL = None


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.selected(docs, quality.trained(docs, common.table(spark, sf_dir, "labels")))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicated(docs, keep="max")


def no_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_per_component(docs, words=5, percent=80)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ranks = bpe.read_ranks(public_tokenizers.path(bpe.RANKS))
    return bpe.round_trip(docs, ranks, public_tokenizers.PATTERN, with_ids=True).select("doc_id", "n_tokens", "ids", "decoded_sha256")


STAGES = [
    ("quality classifier", good_documents),
    ("exact dedup", distinct_documents),
    ("n-gram Jaccard join", no_near_duplicates),
    ("mixing sources to target weights", mixed_sources),
    ("byte-level BPE encoding and decoding", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, read = common.table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir))
        if read is not None:  # nothing reads the stage before any more
            common.forget(read)
        read = docs
    return docs
