"""The corpus pipeline: documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and
returns a DataFrame; ``run`` writes each result as Parquet in the shared folder and
reads it again for the next stage. All stages but the last return the columns of their
input. No stage can be written in SQL as a whole, so ``ORACLE_SQL`` is None and the
tests hold every stage against a plain version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carepulse.llm import decontaminate, quality, sentencepieces, simhash, toxicity
from carepulse.llm.common import ship_package
from carepulse.session import discard, run_dir

ORACLE_SQL = None


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the string-kernel classifier, fitted on the labelled ones, doesn't reject."""
    model = toxicity.fit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), F.lit(True))
    return toxicity.accept(docs, model)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field, fitted on the labelled ones, doesn't reject."""
    model = quality.fit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), F.lit(True))
    return quality.accept(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: that with the smallest id."""
    ship_package(spark)
    return simhash.keep_one(docs, words=3, max_bits=2)


def drop_leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return decontaminate.drop_leaked(docs, _table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids with the N best segmentations of every document that is left."""
    ship_package(spark)
    return sentencepieces.encode(docs, ["doc_id", "lang", "source"])


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_low_quality),
    ("simhash", drop_near_duplicates),
    ("decontamination", drop_leaked),
    ("sentencepiece", encode),
]


def run(spark: SparkSession, sf_dir: str, keep_stages: bool = False) -> DataFrame:
    """All stages over ``documents``; every stage's result is written and read again.

    A stage's result is deleted once its successor's is written, unless ``keep_stages``.
    """
    docs = _table(spark, sf_dir, "documents")
    root = run_dir(spark, "pipeline")
    before = None
    for i, (name, stage) in enumerate(STAGES):
        path = f"{root}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before and not keep_stages:
            discard(spark, before)
        before = path
    return docs
