"""Page logs: records, their kinds, and what holds of a file or a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import base_name, is_error_placeholder

TAGS = ("batch_session", "image_metadata", "batch_tracking", "file_provenance", "resume_format")
PAGE = "image_name string, text_chunk string, order_index int, method string, timestamp string, file_name string, folder_name string, pre_processed_image string"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """``(source, line_no, raw)`` of JSON line files, any depth; error files and repair logs are left
    out, blank lines too (A1, A3). Large files are split; line_no is a line's place in its file, which
    orders its lines."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").text(path)
    name, at = base_name(F.col("_metadata.file_path")), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("nth"))
    rows = lines.select(F.col("_metadata.file_path").alias("source"), at.alias("line_no"), F.col("value").alias("raw"), name.alias("name"))
    return rows.where(~F.startswith("name", F.lit("errors_")) & ~F.endswith("name", F.lit("_temporary_repair.jsonl")) & (F.trim("raw") != "")).drop("name")


def kinds(log: DataFrame) -> DataFrame:
    """The kind of every record, by the first tag it has; malformed lines are ``reject``."""
    keys = F.json_object_keys("raw")
    out = F.when(keys.isNull(), "reject")
    for t in TAGS:
        out = out.when(F.array_contains(keys, t), t)
    p = F.from_json("raw", PAGE)
    page = (F.coalesce(p["image_name"], F.lit("")) != "") & p["text_chunk"].isNotNull()
    return log.withColumn("kind", out.when(page, "page").otherwise("other"))


def pages(log: DataFrame) -> DataFrame:
    """Transcription records with their fields."""
    return kinds(log).where("kind = 'page'").select("source", "line_no", F.from_json("raw", PAGE).alias("p")).select("source", "line_no", "p.*")


def last_per_image(rows: DataFrame, keys: tuple[str, ...] = ("source", "image_name"), order: str = "line_no") -> DataFrame:
    """The last record of each image, with the place of its first (G1)."""
    w = Window.partitionBy(*keys)
    first = F.min(order).over(w).alias("first_pos")
    return rows.select("*", first, F.row_number().over(w.orderBy(F.desc(order))).alias("_n")).where("_n = 1").drop("_n")


def processed_names(rows: DataFrame, exclude_errors: bool = False) -> DataFrame:
    """Images done; with ``exclude_errors`` only where the latest record isn't an error."""
    if not exclude_errors:
        return rows.select("source", "image_name").distinct()
    return last_per_image(rows).where(~is_error_placeholder(F.col("text_chunk"))).select("source", "image_name")


def pending(needed: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What is still to do."""
    return needed.join(done, keys, "left_anti")


def after_last(rows: DataFrame, marker: Column, by: str = "source", order: str = "line_no") -> DataFrame:
    """Records behind the last marked one of their file; all if none is."""
    last = rows.where(marker).groupBy(by).agg(F.max(order).alias("_last"))
    return rows.join(last, by, "left").where(F.col("_last").isNull() | (F.col(order) > F.col("_last"))).drop("_last")


def resume_version(log: DataFrame) -> DataFrame:
    """First version that a file states."""
    v = F.get_json_object("raw", "$.resume_format.version").try_cast("int")
    return log.select("source", "line_no", v.alias("version")).where("version is not null").groupBy("source").agg(F.min_by("version", "line_no").alias("version"))


def file_summary(log: DataFrame) -> DataFrame:
    """Per file: batch ids, provider, session status, counts."""
    r = kinds(log)
    get = lambda p: F.get_json_object("raw", p)
    tracked = F.col("kind") == "batch_tracking"
    provider = F.coalesce(get("$.batch_tracking.provider"), get("$.batch_session.provider"))
    has_session, has_id = F.bool_or(F.col("kind") == "batch_session"), F.bool_or((F.col("kind") == "image_metadata") & get("$.image_metadata.custom_id").isNotNull())
    return r.groupBy("source").agg(
        F.array_sort(F.collect_set(F.nullif(get("$.batch_tracking.batch_id"), F.lit("")))).alias("batch_ids"),
        F.coalesce(F.max_by(provider, F.when(provider.isNotNull(), F.col("line_no"))), F.lit("openai")).alias("provider"),
        F.max_by(get("$.batch_session.status"), F.when(F.col("kind") == "batch_session", F.col("line_no"))).alias("status"),
        F.count_if(F.col("kind") == "page").alias("n_pages"), F.count_if(F.col("kind") == "reject").alias("n_rejects"),
        (has_session & (F.bool_or(tracked) | has_id)).alias("is_batch_log"),
    )


def image_metadata(log: DataFrame) -> DataFrame:
    """Image metadata records with their defaults."""
    get = lambda p: F.get_json_object("raw", f"$.image_metadata.{p}")
    return kinds(log).where("kind = 'image_metadata'").select("source", "line_no", F.coalesce(get("custom_id"), F.lit("")).alias("custom_id"), F.coalesce(get("image_name"), F.lit("")).alias("image_name"), F.coalesce(get("order_index").try_cast("int"), F.lit(-1)).alias("order_index"))


def reject_incompatible(log: DataFrame, version: int = 1) -> DataFrame:
    """Files with pages and another resume version."""
    has = pages(log).select("source").distinct()
    return has.join(resume_version(log), "source", "left").where(~F.coalesce(F.col("version") == version, F.lit(False)))
