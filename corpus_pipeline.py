"""A corpus pipeline of five stages over ``documents``: toxic documents go, one document of each near-duplicate
group stays, secrets are masked, sources are mixed to target weights, and the rest is encoded and decoded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import bpe, minhash, mixing, secrets, toxicity
from ledgerloom.llm.common import release, table

#: No SQL: the toxicity model and the tokens come from numpy; a test holds the rows against a brute-force version.
ORACLE_SQL = None


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the toxicity model, learned from ``labels``, scores below 0.5."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.passed(docs, toxicity.learned(docs, labels))


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, the one with the least id."""
    return minhash.deduplicated(docs)


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts masked and ``n_chars`` counted anew."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents up to each leaf's budget; a document comes once for each epoch that takes it."""
    return mixing.select_documents(docs)


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of every text that is left, encoded and decoded again."""
    return bpe.digests(docs)


STAGES = [("toxicity", not_toxic), ("minhash", deduplicated), ("secrets", masked), ("mixing", mixed), ("bpe", tokenised)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = table(docs, f"stage-{name}")
            release(before)  # the table of the stage before; the input isn't one
    return docs
