"""Reports: progress, failures, caches, metrics and their tables (A2, B14, B18, C14-C17, I7, I8, I27,
I29, I30, K5, Q10, Q14, Q26, Q27, Q30, Q37)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import base_name, cause
from .usage import budget_day

ROW = "transcription string, text_chunk string, custom_id string, image_name string, pre_processed_image string, file_name string, order_index int, no_transcribable_text boolean, transcription_not_possible boolean"


def evaluation_pages(log: DataFrame) -> DataFrame:
    """Pages of transcription logs(source, line_no, raw) for scoring: ``(source, line_no, page_index,
    image_name, text, no_transcribable_text, transcription_not_possible, custom_id)``. The text is the
    first that isn't empty of its two fields, or a batch answer's; records without text, flag or name
    are left out; image and order come from the metadata of the custom_id, else from the record, and
    the order is that of the records that stay where none is given (A2, C15-C17, J2)."""
    keys, r = F.json_object_keys("raw"), F.from_json("raw", ROW)
    has = lambda *names: F.arrays_overlap(keys, F.array(*map(F.lit, names)))
    rows = log.where(keys.isNotNull()).select("source", "line_no", "raw", keys.alias("k"), r.alias("r"), has("batch_session", "batch_tracking").alias("session"), (has("image_metadata") & ~has("transcription", "text_chunk")).alias("meta"))
    m = F.from_json(F.get_json_object("raw", "$.image_metadata"), "custom_id string, image_name string, order_index int")
    meta = rows.where(F.array_contains("k", "image_metadata")).select("source", "line_no", m.alias("m")).where("m.custom_id <> ''")
    meta = meta.groupBy("source", F.col("m.custom_id").alias("custom_id")).agg(F.max_by("m", "line_no").alias("m"))
    text = F.coalesce(F.nullif("r.transcription", F.lit("")), F.col("r.text_chunk"), F.get_json_object("raw", "$.response.body.transcription"))
    flags = F.arrays_overlap("k", F.array(*map(F.lit, ("no_transcribable_text", "transcription_not_possible", "file_name", "pre_processed_image"))))
    own = F.coalesce(F.nullif("r.image_name", F.lit("")), F.nullif(base_name(F.col("r.pre_processed_image")), F.lit("")), "r.file_name", F.lit(""))
    kept = rows.where("not session and not meta").withColumn("text", text).where(F.col("text").isNotNull() | flags)
    kept = kept.select("source", "line_no", "text", F.nullif("r.custom_id", F.lit("")).alias("custom_id"), own.alias("own"), F.col("r.order_index").alias("given"), F.coalesce("r.no_transcribable_text", F.lit(False)).alias("no_transcribable_text"), F.coalesce("r.transcription_not_possible", F.lit(False)).alias("transcription_not_possible"))
    kept = kept.withColumn("nth", F.row_number().over(Window.partitionBy("source").orderBy("line_no")) - 1)
    both = kept.join(meta, ["source", "custom_id"], "left")
    index = F.coalesce(F.when(F.col("m").isNotNull(), F.col("m.order_index")).otherwise(F.col("given")), F.col("nth"))
    name = F.when(F.col("m").isNotNull(), F.coalesce("m.image_name", F.lit(""))).otherwise(F.col("own"))
    return both.select("source", "line_no", index.alias("page_index"), name.alias("image_name"), "text", "no_transcribable_text", "transcription_not_possible", "custom_id")


def has_text(text: Column, no_text: Column, not_possible: Column) -> Column:
    """A page that was read (C14)."""
    return text.isNotNull() & ~F.coalesce(no_text, F.lit(False)) & ~F.coalesce(not_possible, F.lit(False))


def progress(items: DataFrame, by: list[str]) -> DataFrame:
    """How far runs are, from items(state, seconds): done, failed, left, percent (100 of nothing), and
    the seconds that the rest takes at the rate so far; null without a rate or a rest (I27)."""
    r = items.groupBy(*by).agg(F.count("state").alias("total"), F.count_if(F.col("state") == "done").alias("done"), F.count_if(F.col("state") == "failed").alias("failed"), F.max("seconds").alias("elapsed"))
    over = F.col("done") + F.col("failed")
    r = r.withColumn("remaining", F.col("total") - over).withColumn("percent", F.when(F.col("total") == 0, 100.0).otherwise(over / F.col("total") * 100))
    return r.withColumn("seconds_left", F.when((over > 0) & (F.col("remaining") > 0) & (F.col("elapsed") > 0), F.col("remaining") / (over / F.col("elapsed"))))


def failure_summary(pages: DataFrame, by: list[str]) -> DataFrame:
    """Failed pages of documents(text, page_number), how many can't be read, and what that makes of the
    document (Q10, Q30, Q37)."""
    p = pages.withColumn("_cause", F.when(F.col("text").isNull(), "api_error").otherwise(cause(F.col("text"))))
    failed = F.array_sort(F.collect_list(F.when(F.col("_cause") == "api_error", F.col("page_number"))))
    r = p.groupBy(*by).agg(F.count("*").alias("n_pages"), failed.alias("failed_pages"), F.count_if(F.col("_cause") == "not_possible").alias("n_not_possible"), F.count_if(F.col("_cause") == "no_text").alias("n_no_text"))
    n = F.size("failed_pages")
    return r.withColumn("outcome", F.when(n == 0, "complete").when(n == F.col("n_pages"), "failed").otherwise("partial"))


def cache_totals(calls: DataFrame, by: list[str]) -> DataFrame:
    """Cached, created and input tokens of sessions and the share that caches answered."""
    r = calls.groupBy(*by).agg(F.sum("cached_tokens").alias("cached"), F.sum("created_tokens").alias("created"), F.sum("input_tokens").alias("input"))
    return r.withColumn("hit_rate", F.coalesce(F.try_divide("cached", "input"), F.lit(0.0)))


def with_discarded(usage: DataFrame, attempts: DataFrame) -> DataFrame:
    """Usage of calls and of the failed attempts before them that used tokens (I29); both ts, tokens
    and the same keys."""
    return usage.unionByName(attempts.where("tokens > 0").select(usage.columns))


def bucket_text(provider: Column, key_env: Column, pool: Column) -> Column:
    """A bucket as provider|key|pool; calls without provider or key have none (Q14)."""
    known = (F.coalesce(provider, F.lit("")) != "") & (F.coalesce(key_env, F.lit("")) != "")
    return F.when(known, F.concat_ws("|", provider, key_env, F.coalesce(pool, F.lit(""))))


def bucket_of(text: Column) -> Column:
    """The parts of a bucket's text; null if it isn't one (Q14)."""
    p = F.split(text, r"\|")
    ok = (F.size(p) == 3) & (F.get(p, 0) != "") & (F.get(p, 1) != "")
    return F.when(ok, F.struct(F.get(p, 0).alias("provider"), F.get(p, 1).alias("key_env"), F.nullif(F.get(p, 2), F.lit("")).alias("pool")))


def ledger_today(states: DataFrame, now: Column, by: list[str]) -> DataFrame:
    """Tokens of stored states(day, tokens as text): 0 if from another budget day, null if unreadable (Q26)."""
    tokens = F.col("tokens").try_cast("long")
    return states.select(*by, F.when(F.col("day").try_cast("date").isNull() | tokens.isNull() | (tokens < 0), None).when(F.col("day").try_cast("date") != budget_day(now), 0).otherwise(tokens).alias("tokens"))


def exhausted(buckets: DataFrame) -> DataFrame:
    """Keys of buckets(provider, key_env, pool, used, cap) that are used up, with the other keys of their
    pool that have tokens left (Q27)."""
    b = buckets.withColumn("remaining", F.when(F.col("cap").isNotNull(), F.greatest(F.col("cap") - F.col("used"), F.lit(0))))
    open_ = b.where("remaining > 0").groupBy("provider", "pool").agg(F.array_sort(F.collect_set("key_env")).alias("siblings"))
    return b.where("remaining = 0").join(open_, ["provider", "pool"], "left").select("provider", "key_env", "pool", F.coalesce("siblings", F.array().cast("array<string>")).alias("siblings"))


def may_call(used: Column, reserved: Column, estimate: Column, cap: Column) -> dict[str, Column]:
    """Whether the next page has to wait, and whether it could never fit its cap."""
    known = cap.isNotNull()
    return {"blocked": known & (used + reserved + estimate > cap), "never_fits": known & (estimate > cap)}


def gates(scope: Column, stamped: Column, pool: Column, pool_cap: Column) -> dict[str, Column]:
    """Which caps a call answers to: its pool's where it has both; the combined one if the scope is all,
    the call has no stamp, or it has a pool (C33)."""
    return {"pool_gate": pool.isNotNull() & pool_cap.isNotNull(), "combined_gate": (scope == "all") | ~stamped | pool.isNotNull()}


def derived(metrics: DataFrame, keep: list[str]) -> DataFrame:
    """Rates to 4 places and percents to 2 from sums, ratios null where nothing was to be found."""
    over = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return metrics.select(*keep, F.round(over("char_distance", "ref_chars"), 4).alias("cer"), F.round(over("char_distance", "ref_chars") * 100, 2).alias("cer_percent"), F.round(over("word_distance", "ref_words"), 4).alias("wer"), F.round(over("word_distance", "ref_words") * 100, 2).alias("wer_percent"), F.round(F.try_divide(F.col("hyp_pages") * 100.0, "ref_pages"), 1).alias("page_recall"), F.round(F.try_divide(F.col("hyp_headings") * 100.0, "ref_headings"), 1).alias("heading_recall"))


def markdown_table(scores: DataFrame, row: str, columns: list[str]) -> str:
    """A table of scores, a small aggregate, as Markdown: rows sorted, numbers with thousands separators
    and 2 decimals, N/A for nulls (I8, B14)."""
    def cell(x: object) -> str:
        return "N/A" if x is None else f"{x:,.2f}" if isinstance(x, float) else f"{x:,}" if isinstance(x, int) else str(x)

    rows = sorted(scores.select(row, *columns).collect(), key=lambda r: str(r[0]))
    lines = ["| " + " | ".join([row, *columns]) + " |", "|" + " --- |" * (len(columns) + 1)]
    return "\n".join([*lines, *("| " + " | ".join(map(cell, r)) + " |" for r in rows)]) + "\n"


def top_lines(docs: DataFrame, by: list[str], longer_than: int = 10, most: int = 3) -> DataFrame:
    """The most frequent lines of each text, ties in order of their first place (K5)."""
    lines = docs.select(*by, F.posexplode(F.split("text", "\n")).alias("at", "line")).withColumn("line", F.trim("line")).where(F.length("line") > longer_than)
    n = lines.groupBy(*by, "line").agg(F.count("*").alias("n"), F.min("at").alias("at"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "at"))).where(F.col("rank") <= most).drop("at")


def run_summary(items: DataFrame) -> DataFrame:
    """One line of JSON on a run of items(failed): totals and the exit code."""
    r = items.agg(F.count("*").alias("items_total"), F.count_if(~F.col("failed")).alias("items_ok"), F.count_if("failed").alias("items_failed"))
    return r.select(F.to_json(F.struct("*", F.when(F.col("items_failed") > 0, 1).otherwise(0).alias("exit_code"))).alias("value"))


def blocks(docs: DataFrame, by: list[str]) -> DataFrame:
    """Runs of lines that aren't blank: their number, first line, size and mean length."""
    lines = docs.select(*by, F.posexplode(F.split("text", "\n")).alias("at", "line"))
    blank = F.trim("line") == ""
    n = F.count_if(blank).over(Window.partitionBy(*by).orderBy("at"))
    return lines.withColumn("block", n).where(~blank).groupBy(*by, "block").agg(F.min("at").alias("first"), F.count("*").alias("n_lines"), F.avg(F.length("line")).alias("mean_length"))
