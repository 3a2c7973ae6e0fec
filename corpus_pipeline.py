"""A corpus pipeline of five stages; each reads what the stage before it wrote.

In every stage a null text counts as empty, other columns pass unchanged (but for the last stage's
own), an empty table gives no rows, and rows equal in all share one fate: the second stage leaves
one of them. Rows with a null doc_id go with their texts' copies in the second stage and stay in
the third.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomwright.llm import exact, packing, simhash, substring, toxicity
from loomwright.session import Workspace, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxicity: documents that it rejects go."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup: of equal texts the largest doc_id stays."""
    return exact.drop_exact_duplicates(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup: one document of each group stays."""
    return simhash.drop_near_duplicates(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Substring dedup: passages that occur twice are cut out of the texts."""
    return substring.cut_repeated_passages(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: pieces of sequences, a row each."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_duplicates),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeated_passages),
    ("packing", pack_sequences),
]

#: Scores, fingerprints, factors and packing are not SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on ``documents``: each one's rows are written and read again by the next."""
    work = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = work.put(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
