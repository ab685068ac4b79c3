"""From raw documents to token shards: filter, dedup, decontaminate, mix, pack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import decontaminate, mixing, quality_pu, simhash, sstable
from quire.llm.common import crc32_of_id, cut, table
from quire.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores 0.7 or more. Rows that share a doc_id are judged
    by the best of them; rows without doc_id stay."""
    labels = table(spark, sf_dir, "labels").where(crc32_of_id() % 4 != 2)
    low = quality_pu.quality_scores(docs, labels).groupBy(F.col("doc_id").alias("bad_id")).agg(F.max("score").alias("score")).where("score < 0.7")
    bad = cut(low.select("bad_id"))
    return docs.join(bad, docs["doc_id"].cast("long") == bad["bad_id"], "left_anti")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_first(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    read = sstable.token_table(docs, tokenizer_path())
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


STAGES = [("quality classifier", quality), ("simhash near-dedup", near_dedup), ("benchmark decontamination", decontaminated), ("mixing to target weights", mixed), ("token-id output", packed)]
#: SQL has no PU model, XXH64 or tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
