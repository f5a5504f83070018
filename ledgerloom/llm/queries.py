"""The queries opN_<name>: each operator with production parameters over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, flac, minhash, mixing, quality, ranking, resampling, secrets, sharding, toxicity, urlfilter, warc


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.classes(read(spark, sf_dir, "documents"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read(spark, sf_dir, "documents"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(read(spark, sf_dir, "documents"))


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.production(read(spark, sf_dir, "embeddings"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(read(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(read(spark, sf_dir, "documents"))


def op7_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac.digests(read(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.verdicts(read(spark, sf_dir, "pages"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judged(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(read(spark, sf_dir, "pages"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.draws(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.answers(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_minhash": op1_minhash,
    "op2_bpe": op2_bpe,
    "op3_secrets": op3_secrets,
    "op4_neighbours": op4_neighbours,
    "op5_mixing": op5_mixing,
    "op6_sharding": op6_sharding,
    "op7_flac": op7_flac,
    "op8_quality": op8_quality,
    "op9_urls": op9_urls,
    "op10_toxicity": op10_toxicity,
    "op11_warc": op11_warc,
    "op12_resampling": op12_resampling,
    "op13_ranking": op13_ranking,
}

ORACLE_SQL: dict[str, str] = {
    "op3_secrets": secrets.ORACLE_SQL,
    "op5_mixing": mixing.ORACLE_SQL,
    "op6_sharding": sharding.ORACLE_SQL,
    "op9_urls": urlfilter.ORACLE_SQL,
    "op11_warc": warc.ORACLE_SQL,
    "op12_resampling": resampling.ORACLE_SQL,
    "op13_ranking": ranking.ORACLE_SQL,
}
