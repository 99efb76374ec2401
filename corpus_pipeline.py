"""From raw documents to packed training sequences in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns a DataFrame;
all but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanloom.llm import mixing, neardup, packing, quality, repeats
from spanloom.llm.common import store
from spanloom.llm.queries import table, vocabulary

#: Words of the shortest passage that goes if it repeats: over 50.
PASSAGE = 51


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base limits and the decision list learned from `labels`.

    A null or empty text has no words and goes; equal rows share one verdict; without labels of both kinds
    only the base limits decide; an empty table gives no rows; other columns stay as they are.
    """
    rules = quality.fit_quality_rules(docs, table(spark, sf_dir, "labels"))
    return quality.accepted(docs, rules)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity of 0.8 or more), that of least
    id. See without_near_duplicates for rows without words, without or with a shared doc_id, and empty tables."""
    return neardup.without_near_duplicates(docs, percent=80)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the runs of PASSAGE words or more that occur again, here or in another text. See strip_repeats for
    nulls, short, long and equal texts, and empty tables."""
    return repeats.strip_repeats(docs, words=PASSAGE)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, repeated or left out so that sources come near their target weights. See mix for null
    texts and sources, equal rows and empty tables; a document without words is never taken for its words, but
    stays as often as its source's whole copies say."""
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, lexical neighbours together, with their ids. See pack for null texts, repeated
    rows, long texts and empty tables."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"), ids=True)


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("suffix_dedup", suffix_dedup), ("source_mixing", source_mixing), ("packing", packing_stage)]

#: SQL can express neither the learned rules nor sketches, anchors and tokens; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
