"""A training corpus from raw documents: language, exact copies, near copies, packing.

Each stage takes (spark, docs, sf_dir) and returns a table; run() writes each stage's table to the shared folder as
Parquet and reads it back as the next one's docs. All but the last return the columns of documents.

Null or repeated ids, null texts and extra columns are handled as the operators' modules define; an empty table gives no
sequences. Texts that are null or without letters go with the first stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from strandset.llm.common import discard, materialize, table
from strandset.llm.dedup import deduplicate
from strandset.llm.langid import known_language, learn_profiles
from strandset.llm.ngram_join import one_of_each
from strandset.llm.packing import pack_sequences


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be learned from the labelled ones; what has no letters, or is like none of them, goes."""
    return known_language(docs, learn_profiles(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of the documents with equal texts but for white space: the longest, then the one of smallest id."""
    return deduplicate(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of the documents that links of similarity 0.8 or more, over sets of five words, connect: the one of smallest id."""
    return one_of_each(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of up to 2048 tokens."""
    return pack_sequences(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language ID", language), ("exact dedup", exact), ("n-gram Jaccard join", near), ("packing", pack)]

#: Language identification and tokenising have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
        if name != STAGES[0][0]:
            discard(before)
    return docs
