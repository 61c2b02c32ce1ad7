"""From raw documents to a training mix: each stage works on what the one before it kept."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnwatch.llm.decontaminate import without_leaks
from txnwatch.llm.language import fold
from txnwatch.llm.line_dedup import without_lines
from txnwatch.llm.mixing import mixture
from txnwatch.llm.near_dedup import one_of_each
from txnwatch.llm.passages import learn, score
from txnwatch.operators.skew import delete_at_end
from txnwatch.session import checkpoint_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality classifier rejects. It learns from the labels outside fold 2 of 4."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = learn(docs, labels.filter(fold(F.col("doc_id"), 4) != 2))
    return score(docs, model, keep=docs.columns).filter("predicted = 1").select(*[F.col(f"`{c}`") for c in docs.columns])


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove lines that equal or resemble an earlier one, and documents left without a line that had some."""
    return without_lines(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group linked by five-word shingles with similarity 0.8 or more."""
    return one_of_each(docs, width=5)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold an item of the benchmark."""
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix with the words taken from each."""
    return mixture(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("near-dedup", near),
    ("benchmark decontamination", leaks),
    ("mixing", mix),
]

# A trained classifier and the similarity joins over changed texts have no SQL form.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    delete_at_end(spark, folder)
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
