"""Scoring of transcriptions against a reference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distance import char_distance, word_distance
from ..functions.text import collapse, formatting, strip_formatting

#: What every formatting mark holds one of.
MARKS = r"[*#<$]|\[[\^I]"
SUMS = ("char_distance", "ref_chars", "word_distance", "ref_words", "content_char_distance", "content_ref_chars", "content_word_distance", "content_ref_words", "hyp_pages", "ref_pages", "hyp_headings", "ref_headings", "hyp_emphasis", "ref_emphasis")


def rate(distance: Column, size: Column, other: Column) -> Column:
    """Error rate; against an empty reference, what the hypothesis has too much."""
    return F.when(size > 0, distance / size).otherwise(other.cast("double"))


def page_rates(metrics: DataFrame, keep: list[str]) -> DataFrame:
    """Character and word error rates of pages."""
    return metrics.select(*keep, rate(F.col("char_distance"), F.col("ref_chars"), F.col("hyp_chars")).alias("cer"), rate(F.col("word_distance"), F.col("ref_words"), F.col("hyp_words")).alias("wer"))


def with_total(details: DataFrame, label: str, sums: list[str]) -> DataFrame:
    """Detail rows and a row TOTAL of their sums."""
    total = details.agg(*(F.sum(c).alias(c) for c in sums)).withColumn(label, F.lit("TOTAL"))
    return details.select(F.col(label).cast("string").alias(label), *sums).unionByName(total)


def align(hyp: DataFrame, ref: DataFrame, keys: list[str], order: str = "line_no") -> DataFrame:
    """Pages of both sides by key, the first of each where a key repeats (F1)."""
    def first(df: DataFrame, name: str) -> DataFrame:
        n = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
        return df.withColumn("_n", n).where("_n = 1").select(*keys, F.col("text").alias(name), F.lit(True).alias(f"{name}_found"))

    both = first(hyp, "hyp").join(first(ref, "ref"), keys, "full_outer")
    status = F.when(F.col("ref_found").isNull(), "No ground truth for page").when(F.col("hyp_found").isNull(), "No model output for page").otherwise("OK")
    return both.withColumn("status", status)


def page_metrics(pairs: DataFrame, keep: list[str]) -> DataFrame:
    """Distances and counts of pairs(ref, hyp), over all text and over content only (I4, I5); texts
    without marks are content as they are."""
    n_words = lambda c: F.when(c == "", 0).otherwise(F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit(""))) + 1).cast("long")
    kinds = [(f"{s}_{k}", F.size(v)) for s in ("ref", "hyp") for k, v in formatting(F.col(s)).items() if k in ("page", "heading", "bold", "italic")]
    marked = lambda c: F.rlike(F.coalesce(c, F.lit("")), F.lit(MARKS))
    p = pairs.select(*keep, "ref", "hyp", collapse(F.col("ref")).alias("r"), collapse(F.col("hyp")).alias("h"), marked(F.col("ref")).alias("rm"), marked(F.col("hyp")).alias("hm"))
    content = [F.when(F.col(m), collapse(strip_formatting(F.col(c)))).otherwise(F.col(x)).alias("c" + x) for c, x, m in (("ref", "r", "rm"), ("hyp", "h", "hm"))]
    p = p.select(*keep, "r", "h", *content, *(F.when(F.col("rm" if c[0] == "r" else "hm"), v).otherwise(0).alias(c) for c, v in kinds))
    other = (F.col("cr") != F.col("r")) | (F.col("ch") != F.col("h"))  # else the content is all there is
    p = p.select("*", char_distance("r", "h").alias("dc"), word_distance("r", "h").alias("dw"), *(d(F.when(other, F.col("cr")), F.when(other, F.col("ch"))).alias(n) for n, d in (("cdc", char_distance), ("cdw", word_distance))))
    return p.select(
        *keep,
        F.col("dc").alias("char_distance"), F.length("r").cast("long").alias("ref_chars"), F.length("h").cast("long").alias("hyp_chars"),
        F.col("dw").alias("word_distance"), n_words(F.col("r")).alias("ref_words"), n_words(F.col("h")).alias("hyp_words"),
        F.coalesce("cdc", "dc").alias("content_char_distance"), F.length("cr").cast("long").alias("content_ref_chars"),
        F.coalesce("cdw", "dw").alias("content_word_distance"), n_words(F.col("cr")).alias("content_ref_words"),
        *(F.col(f"{s}_{k}").cast("long").alias(f"{s}_{k}s") for s in ("hyp", "ref") for k in ("page", "heading")),
        *((F.col(f"{s}_bold") + F.col(f"{s}_italic")).cast("long").alias(f"{s}_emphasis") for s in ("hyp", "ref")),
    )


def micro_average(metrics: DataFrame, *levels: tuple[str, ...]) -> DataFrame:
    """Ratios of sums at every level of grouping in one pass."""
    dims = list(dict.fromkeys(d for x in levels for d in x))
    sums = [F.sum(s).alias(s) for s in SUMS]
    grouped = metrics.groupingSets([[F.col(d) for d in x] for x in levels], *dims).agg(F.count("*").alias("n_pages"), *sums)
    over = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return grouped.select(*dims, "n_pages", over("char_distance", "ref_chars").alias("cer"), over("word_distance", "ref_words").alias("wer"), over("content_char_distance", "content_ref_chars").alias("content_cer"), over("content_word_distance", "content_ref_words").alias("content_wer"), F.try_divide("hyp_pages", "ref_pages").alias("page_recall"), F.try_divide("hyp_headings", "ref_headings").alias("heading_recall"), F.try_divide("hyp_emphasis", "ref_emphasis").alias("emphasis_ratio"))


def rank(scores: DataFrame, by: str = "content_cer", name: str = "model") -> DataFrame:
    """Place of each model, ties by name."""
    return scores.withColumn("rank", F.row_number().over(Window.orderBy(by, name)))
