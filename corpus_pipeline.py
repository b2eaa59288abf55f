"""A training-corpus pipeline: each stage calls one corpus operator on what the one before kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns the next documents, the last one packed pieces.  ``run`` applies them to
the documents table, each stage written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siteloom.llm import lines, mixing, packing, ranking, simhash
from siteloom.llm.common import Workspace
from siteloom.llm.queries import table, tokenizer_paths


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the Bradley-Terry classifier does not reject."""
    model = ranking.train(docs, table(spark, sf_dir, "labels"))
    return docs.where(ranking.quality_score(model) >= ranking.CUT_SCORE)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that equal or resemble an earlier one."""
    return lines.dedup_lines(Workspace(spark), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.keep_one(Workspace(spark), docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words of the documents that a mix of their total size takes, sources weighing 5, 2, 1."""
    return mixing.mix_documents(Workspace(spark), docs, weights=(5, 2, 1), share=1.0, most=2.0)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents placed in sequences of 1024 tokens."""
    return packing.pack_documents(Workspace(spark), docs, *tokenizer_paths())


STAGES = [
    ("quality classifier", quality),
    ("line dedup", line_dedup),
    ("simhash near-dedup", near_dedup),
    ("mixing sources", mix),
    ("packing", pack),
]

#: SQL can't express the learned and sketch-based stages; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    ws = Workspace(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = ws.save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
