"""Documents from pages, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import page_line, strip
from .log import last_per_image


def documents(pages: DataFrame, by: list[str], joiner: str = "\n") -> DataFrame:
    """One text per document from pages(text, image_name, page_number, order_key), each page as a
    line, in order (B6 with a newline, B7 with a blank line)."""
    line = page_line(F.col("text"), F.col("image_name"), F.col("page_number"))
    held = pages.select(*by, F.struct("order_key", line.alias("line")).alias("p"))
    return held.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["line"]), joiner).alias("text"), F.count("*").alias("n_pages"))


def json_documents(pages: DataFrame, by: list[str]) -> DataFrame:
    """Each document's pages as a JSON array."""
    page = F.struct("page_number", "image_name", F.col("text").alias("transcription"))
    held = pages.select(*by, F.struct("order_key", page.alias("page")).alias("p"))
    return held.groupBy(*by).agg(F.to_json(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["page"])).alias("json"))


def rebuild(pages: DataFrame) -> DataFrame:
    """Documents from a log's page records: last per image, ordered by index, numbered from 1."""
    last = last_per_image(pages)
    index = F.coalesce("order_index", F.lit(0))
    numbered = last.select("source", F.col("text_chunk").alias("text"), "image_name", (index + 1).alias("page_number"), F.struct(index.alias("i"), "first_pos").alias("order_key"))
    return documents(numbered, ["source"])


def page_text(pages: DataFrame, by: list[str], separator: str = "\n\n") -> DataFrame:
    """Texts of the pages that have one, in order (I21); pages: text, page_index."""
    held = pages.where("text is not null").select(*by, F.struct("page_index", "text").alias("p"))
    return held.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["text"]), separator).alias("text"))


def editable(pages: DataFrame, by: list[str]) -> DataFrame:
    """Documents as marked text for hand correction (B11); pages: text, image_name, page_index and flags."""
    shown = F.when(F.col("no_transcribable_text"), "[NO TRANSCRIBABLE TEXT]").when(F.col("transcription_not_possible"), "[TRANSCRIPTION NOT POSSIBLE]").otherwise(F.coalesce("text", F.lit("")))
    block = F.concat(F.lit("=== "), F.col("image_name"), F.lit(" ===\n"), shown, F.lit("\n\n"))
    held = pages.select(*by, F.struct("page_index", block.alias("b")).alias("p"))
    return held.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["b"]), "").alias("text"))


def from_editable(docs: DataFrame, by: list[str]) -> DataFrame:
    """Pages from marked text, the inverse of :func:`editable`."""
    part = F.posexplode(F.regexp_extract_all("text", F.lit(r"(?ms)^=== [^\n]+? ===\s*?\n.*?(?=^=== [^\n]+? ===\s*?$|\z)"), F.lit(0))).alias("page_index", "block")
    p = docs.select(*by, part)
    body = strip(F.regexp_replace("block", r"(?s)\A=== [^\n]+? ===\s*?\n", ""))
    none, failed = body == "[NO TRANSCRIBABLE TEXT]", body == "[TRANSCRIPTION NOT POSSIBLE]"
    return p.select(*by, "page_index", F.regexp_extract("block", r"\A=== ([^\n]+?) ===", 1).alias("image_name"), F.when(~none & ~failed, body).alias("text"), none.alias("no_transcribable_text"), failed.alias("transcription_not_possible"))


def split_pages(docs: DataFrame, by: list[str], size: int = 2000) -> DataFrame:
    """Pages of at most so many characters, so that page operators work on long documents too."""
    pages = F.regexp_extract_all("text", F.lit(r"(?s).{1,%d}" % size), F.lit(0))
    return docs.select(*by, F.posexplode(F.when(F.size(pages) > 0, pages).otherwise(F.array("text"))).alias("page_index", "text"))


def running_index(pages: DataFrame, by: list[str], order: str) -> DataFrame:
    """Index from 0 in order of arrival."""
    return pages.withColumn("page_index", F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1)


def ground_truth(pages: DataFrame) -> DataFrame:
    """Pages as JSON lines; a custom_id only where there is one."""
    fields = ("page_index", "image_name", "transcription", "no_transcribable_text", "transcription_not_possible")
    r = pages.withColumn("transcription", F.col("text"))
    head, known = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), F.to_json(F.struct("custom_id"))
    both = F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(","), F.substring(known, F.lit(2), F.length(known)))
    return r.select(*pages.columns, F.when(F.coalesce("custom_id", F.lit("")) != "", both).otherwise(head).alias("value"))
