"""A training corpus from raw documents: language ID, near dedup, decontamination, mixing, sharding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltloom.llm.common import lookup, saved
from siltloom.llm.decontamination import find_overlaps
from siltloom.llm.language import keep_identified
from siltloom.llm.minhash import Near, near_duplicates
from siltloom.llm.mixing import repeat_to_weights
from siltloom.llm.sharding import shard_by_bytes


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of no known language go: no letters (nulls and empty texts too), or a text that fits every language worse than chance.

    Repeated rows stay or go together, as do all rows where none has a label; an empty table gives an empty result; further columns stay as they are.
    """
    return keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates stays, the one with the smallest id; of rows that share id and text one stays.

    5-word shingles, similarity of 0.8 or more. A row is judged by its own text: different texts of one id are told apart by a hash of id and text.
    Rows without id stay.
    """
    rows = docs.withColumn("__v", F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", "text")))
    found = near_duplicates(rows.select(F.col("__v").alias("doc_id"), "text"), Near(shingle=5, percent=80)).where("doc_id is not null")
    texts = saved(found.groupBy(F.col("doc_id").alias("__v")).agg(F.min("component_id").alias("__c"), F.count("*").alias("times")))
    several = saved(texts.groupBy("__c").count().where("count > 1").select("__c"))
    members = saved(lookup(texts, several, ["__c"], "inner").select("__v", "__c"))
    placed = saved(lookup(rows.select("__v", "doc_id"), members, ["__v"], "inner").distinct())
    firsts = saved(placed.groupBy("__c").agg(F.min(F.struct("doc_id", "__v")).alias("first")))
    gone = saved(lookup(placed, firsts, ["__c"], "inner").where("__v <> first.__v").select("__v", F.lit(True).alias("__gone")).distinct())
    twice = saved(texts.where("times > 1").select("__v", F.lit(True).alias("__twice")))
    kept = lookup(rows, gone, ["__v"]).where("__gone is null").drop("__gone")
    if twice.isEmpty():
        return kept.select(*docs.columns)
    marked = lookup(kept, twice, ["__v"])
    once = marked.where("__twice").groupBy("__v").agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*")
    return marked.where("__twice is null").select(*docs.columns).unionByName(once)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with benchmark windows of 13 words on at least 5 % of their words go.

    Each row is judged by itself, so that repeated rows go together; null and empty texts stay, and all columns as they are.
    """
    found = find_overlaps(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), offsets=False, prefix="__found_")
    return found.where(~((F.col("__found_n_hit") > 0) & (20 * F.col("__found_n_hit") >= F.col("__found_n_words")))).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources get the shares 5, 2, 1 (repeating) of all words; documents are left out or repeated up to three times.

    A null source is a source of its own, the last; texts without words stay once; repeated rows are taken one by one. An empty table gives an empty result.
    """
    return repeat_to_weights(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """16 shards of nearly equal bytes: adds shard and slot, which replace columns of these names.

    Null texts count one byte, as empty ones do; rows that are alike can lie in different shards; an empty table gives an empty result.
    """
    return shard_by_bytes(docs)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix), ("shard", shard)]

#: SQL can't express the first two stages; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
