"""Documents and logs to files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import Postprocess, base_name, page_line

#: Endings by format; any other format is txt. Fixed values.
FORMATS = ("txt", "md", "json")


def format_of(name: Column) -> Column:
    """The format that is written."""
    return F.when(F.lower(name).isin(*FORMATS), F.lower(name)).otherwise("txt")


def output_path(path: Column, name: Column) -> Column:
    """The path with the ending of its format."""
    return F.concat(F.regexp_replace(path, r"\.[^./]*$", ""), F.lit("."), format_of(name))


def rendered(pages: DataFrame, by: list[str], format_column: str = "format", settings: Postprocess | None = None) -> DataFrame:
    """``(by, format, content)``: documents of pages(text, image_name, page_number, order_key, format)
    as lines (txt), blocks (md) or records (json); records aren't post-processed (B5-B8)."""
    line = page_line(F.col("text"), F.col("image_name"), F.col("page_number"))
    record = F.struct("page_number", "image_name", F.col("text").alias("transcription"))
    held = pages.select(*by, format_of(F.col(format_column)).alias("format"), F.struct("order_key", line.alias("line"), record.alias("record")).alias("p"))
    held = held.groupBy(*by, "format").agg(F.array_sort(F.collect_list("p")).alias("p"))
    lines = F.transform("p", lambda p: p["line"])
    text = F.when(F.col("format") == "md", F.array_join(lines, "\n\n")).otherwise(F.array_join(lines, "\n"))
    text = settings.apply(text) if settings else text
    return held.select(*by, "format", F.when(F.col("format") == "json", F.to_json(F.transform("p", lambda p: p["record"]))).otherwise(text).alias("content"))


def append_records(records: DataFrame, folder: str) -> None:
    """Add records as JSON lines. Files are written whole and named when complete, so no line is ever
    cut, and none needs mending before the next is added (B1, B2, B9)."""
    records.select(F.to_json(F.struct("*")).alias("value")).write.mode("append").text(folder)


def postprocessed_files(spark: SparkSession, path: str, target: str, settings: Postprocess) -> DataFrame:
    """Post-process whole text files under a folder and write them, with their name, under a new
    version of ``target``; earlier versions stay (B16, D9)."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").load(path)
    text = F.make_valid_utf8(F.col("content").cast("string"))
    out = raw.select(F.col("path"), base_name(F.col("path")).alias("name"), settings.apply(text).alias("text"))
    out.write.mode("errorifexists").parquet(target)
    return spark.read.parquet(target)
