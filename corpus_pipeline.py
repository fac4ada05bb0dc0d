"""From documents to shards: quality filter, near-duplicates, benchmark decontamination, mix, shards.

Each stage takes what the one before kept, written as Parquet and read again, and applies one
operator of dealgraph.llm to all of it. All but the last return the columns of documents; the
last gives every row its shard and its slot there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from dealgraph.llm.common import cut, table
from dealgraph.llm.decontaminate import drop_contaminated
from dealgraph.llm.mixing import mixed_rows
from dealgraph.llm.near_dedup import drop_near_duplicates
from dealgraph.llm.quality import keep_good
from dealgraph.llm.sharding import kd_shards


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject; it learns from the labels outside the held-out fifth."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources, in whole documents; rows repeat where a source is taken more than once."""
    return mixed_rows(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row of the mix."""
    return kd_shards(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix), ("shard", shard)]

#: The classifier can't be expressed in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over the documents of sf_dir. What is passed on is written as
    Parquet to the session's checkpoint folder (or, where none is set, cut with a checkpoint)."""
    docs = table(spark, sf_dir, "documents")
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            if shared:
                docs.write.parquet(path := f"{shared}/pipeline-{uuid.uuid4().hex}/{k}-{name}")
                docs = spark.read.parquet(path)
            else:
                docs = cut(docs)
    return docs
