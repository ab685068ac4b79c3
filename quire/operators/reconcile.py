"""Batch results against their requests, and repair of failed lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.response import request_index
from ..functions.text import cause


def with_metadata(results: DataFrame, metadata: DataFrame, order: str = "line_no") -> DataFrame:
    """Results with the latest metadata of their custom_id (F2)."""
    n = F.row_number().over(Window.partitionBy("custom_id").orderBy(F.desc(order)))
    last = metadata.withColumn("_n", n).where("_n = 1").drop("_n", order)
    return results.join(last, "custom_id", "left")


def one_per_id(results: DataFrame, by: list[str], order: str = "seq") -> DataFrame:
    """One entry per custom_id: a success over an error, then the latest; blank ids all stay.
    results: custom_id, is_error and what ``by`` and ``order`` name."""
    blank = F.coalesce(F.trim("custom_id"), F.lit("")) == ""
    n = F.row_number().over(Window.partitionBy(*by, "custom_id", F.when(blank, F.col(order))).orderBy("is_error", F.desc(order)))
    return results.withColumn("_n", n).where("_n = 1").drop("_n")


def missing(expected: DataFrame, delivered: DataFrame, keys: list[str]) -> DataFrame:
    """Placeholders for requests without a result."""
    return expected.join(delivered.select(*keys).distinct(), keys, "left_anti").withColumn("transcription", F.lit("[transcription error; no result for this request]"))


def order_key(order_index: Column, page_number: Column, custom_id: Column, position: Column) -> Column:
    """Four-tier sort key: order index, page number, request number, position (K2)."""
    req = request_index(custom_id)
    tier = F.when(order_index.isNotNull(), 0).when(page_number.isNotNull(), 1).when(req.isNotNull(), 2).otherwise(3)
    return F.struct(tier.alias("tier"), F.coalesce(order_index, page_number, req, position).cast("long").alias("value"))


def recovered(tracked: DataFrame, found: DataFrame, key: str = "batch_id") -> DataFrame:
    """Tracked ids and those found elsewhere that aren't tracked."""
    return tracked.select(key, F.lit(True).alias("tracked")).unionByName(found.join(tracked, key, "left_anti").select(key, F.lit(False).alias("tracked")))


def pack(requests: DataFrame, by: list[str], most: int, most_bytes: int) -> DataFrame:
    """Parts of requests(seq, bytes) in order, each within both limits, a larger one alone.
    A fold over each document's requests, which a log holds in order anyway."""
    rows = requests.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("seq", "bytes"))).alias("r"))
    zero = F.struct(F.lit(1).alias("part"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("size"), F.array().cast("array<struct<seq:bigint,bytes:bigint,part:int>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        full = (a["n"] > 0) & ((a["n"] >= most) | (a["size"] + x["bytes"] > most_bytes))
        part = a["part"] + full.cast("int")
        n, size = F.when(full, 1).otherwise(a["n"] + 1), F.when(full, x["bytes"]).otherwise(a["size"] + x["bytes"])
        return F.struct(part.alias("part"), n.alias("n"), size.cast("long").alias("size"), F.concat(a["out"], F.array(F.struct(x["seq"].alias("seq"), x["bytes"].alias("bytes"), part.alias("part")))).alias("out"))

    return rows.select(*by, F.explode(F.aggregate("r", zero, step)["out"]).alias("x")).select(*by, "x.*")


def failure_lines(docs: DataFrame, by: list[str], no_text: bool = False) -> DataFrame:
    """Lines of final texts that stand for a failed page, with the image they name."""
    lines = docs.select(*by, F.posexplode(F.split("text", "\n")).alias("line_index", "line"))
    wanted = ["api_error", "not_possible"] + ["no_text"] * no_text
    image = F.coalesce(F.nullif(F.regexp_extract("line", r"^\s*([^\[\]:]+\.\w+)\s*:\s*\[", 1), F.lit("")), F.nullif(F.regexp_extract("line", r"\[[^\]]*?([\w.-]+\.(?:png|jpe?g|tiff?|webp))", 1), F.lit("")))
    return lines.withColumn("cause", cause(F.col("line"))).where(F.col("cause").isin(wanted)).withColumn("image_name", image)


def patch(lines: DataFrame, repaired: DataFrame, keys: list[str]) -> DataFrame:
    """Lines with those that repairs have a text for replaced."""
    new = repaired.select(*keys, F.col("line").alias("_new"))
    return lines.join(new, keys, "left").withColumn("line", F.when(F.trim(F.coalesce("_new", F.lit(""))) != "", F.col("_new")).otherwise(F.col("line"))).drop("_new")
