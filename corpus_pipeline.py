"""A corpus pipeline: language ID, toxicity, near-duplicates, benchmark decontamination, BPE encoding.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; all but the
last return the columns of `documents`. Every stage decides rows, whatever their ids, nulls included.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe, decontaminate, jaccard, langid, toxicity
from lodestone.llm.queries import vocabulary_path
from lodestone.scratch import free, materialize
from lodestone.sources import table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is decided: those without a letter or margin go.

    The dictionaries are learnt from the stage's own documents that are not held out."""
    found = langid.decide(docs, langid.learn(docs))
    return found.filter(~F.col("rejected")).select("row.*")


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic."""
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.decide(docs, model).filter("predicted = 0").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies: that with the least doc_id."""
    return jaccard.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text."""
    return bpe.encode_digests(docs, vocabulary_path())


STAGES = [
    ("language_id", language_id),
    ("toxicity", toxic),
    ("ngram_jaccard", near_duplicates),
    ("decontamination", decontaminated),
    ("bpe", encoded),
]

#: None: no stage of these can be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table `documents`, each written to the shared folder and reread."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{name}")
            if i:
                free(before)
    return docs
