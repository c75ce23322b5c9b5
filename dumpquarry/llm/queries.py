"""Queries p1, p7, p8 and p9 over the domain tables. None of them has a SQL form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dumpquarry.llm import bpe, mojibake, packing, sampling

SAMPLE_SIZE = 100


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exactly 100 ids of posts and of users."""
    posts, users = (sampling.fixed_size_sample(_table(spark, sf_dir, t), "id", SAMPLE_SIZE).select(F.lit(t).alias("table_name"), "id") for t in ("posts", "users"))
    return posts.unionByName(users)


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_corpus(_table(spark, sf_dir, "documents"))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(bpe.count_tokens(_table(spark, sf_dir, "documents")))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers are: their number, the tokens, the unused share."""
    used = p8_containers(spark, sf_dir).groupBy("container_id").agg(F.sum("tokens").alias("tokens"))
    return used.agg(F.count("*").alias("n_containers"), F.sum("tokens").alias("n_tokens"), F.round(1 - F.sum("tokens") / (F.count("*") * packing.CAPACITY), 6).alias("unused_share"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.garbled(_table(spark, sf_dir, "documents")).select("doc_id")


def p9_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.garbled(_table(spark, sf_dir, "documents"), restore=True)


QUERIES = {f.__name__: f for f in (p1_sample, p7_ids, p8_containers, p8_fill, p9_found, p9_restored)}
SQL: dict[str, str] = {}
