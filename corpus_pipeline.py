"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. All but
the last return whole rows with the columns of docs, whatever those are called besides
doc_id, text, source and n_chars. A null text is an empty one; rows of equal or null doc_id
are each judged by their own text; equal texts (of one source) are judged alike; texts are
read whole, however long; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rasterloom.llm import packing, quality_rules, simhash, suffix_dedup, tokens, toxicity
from rasterloom.llm.common import table, written


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted to be toxic. A text without any term of an example (so a null or
    empty one) scores as examples do on the whole, and stays."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules, of hosts that pass theirs. Null, empty and short texts go; a
    null source is one host."""
    return quality_rules.only_kept(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near-duplicates, by the links of the SimHash operator; rows
    that repeat it, in doc_id and text, stay with it."""
    return simhash.first_of_each(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages that a document of smaller doc_id has. Rows without a doc_id stay whole."""
    return suffix_dedup.without_repeats(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document in a sequence; an empty text has its end id."""
    return packing.pack(docs, tokens.vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("quality rules", quality_stage),
    ("near-dedup", near_dedup_stage),
    ("substring dedup", substring_stage),
    ("packing", packing_stage),
]

#: A nearest-neighbour vote can't be written in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
