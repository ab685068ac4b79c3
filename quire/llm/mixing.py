"""Mixing sources to target weights by a low-discrepancy schedule; DataFrame functions only.

A source's target is its share by weight of all words, at most ``REPEATS`` times what it has; the
excess is shared again by weight (closed form: with sources in the order in which they fill up, the
level of the rest is the largest of the running levels). The mix is a schedule of slots of
``block_words`` words. Slot k looks up the golden-ratio point frac(k * phi) in the cumulative
targets, which gives it a source; slots are then ranked within their source, and the r-th slot takes
the r-th block of the source's documents, shuffled by hash and laid end to end, again and again as
often as the target asks for.

Ranks and running sizes are windows over (source, segment), with segments by slot or by hash that
grow with the square root of the table, and a window over segment totals: no source meets in one
task, however much of the table it holds.

Defined results: null and empty texts have size 0 and nothing taken; a very long text is one row; a
null source is one source, the last; equal sizes and hashes (repeated rows) may stand in either order,
with the same sums; repeated rows are rows of their own; rows without doc_id are shuffled by text. Extra columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut

WEIGHTS, REPEATS, BINS = (5, 2, 1), 3, 4096
PHI = 0.6180339887498949
LEAP = 1 << 20


def targets(sizes: DataFrame) -> DataFrame:
    """``(source, nth, source_size, target)``; sizes: source, source_size."""
    order = F.row_number().over(Window.orderBy(F.asc_nulls_last("source")))
    s = sizes.withColumn("nth", order).withColumn("w", F.get(F.array(*map(F.lit, WEIGHTS)), F.pmod(F.col("nth") - 1, F.lit(len(WEIGHTS)))).cast("double"))
    s = s.withColumn("cap", (F.col("source_size") * REPEATS).cast("double"))
    filling = Window.orderBy(F.col("cap") / F.col("w"), "nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(whole) - (F.sum("cap").over(filling) - F.col("cap"))
    weight = F.sum("w").over(whole) - (F.sum("w").over(filling) - F.col("w"))
    s = s.withColumn("level", left / weight)
    return s.withColumn("target", F.least("cap", F.col("w") * F.max("level").over(whole))).select("source", "nth", "source_size", "target")


def _point(k: Column) -> Column:
    """frac(k * phi), split so that it stays precise for large k."""
    leap = math.fmod(LEAP * PHI, 1)
    return F.pmod(F.pmod(F.floor(k / LEAP) * F.lit(leap), F.lit(1.0)) + F.pmod(F.pmod(k, F.lit(LEAP)) * F.lit(PHI), F.lit(1.0)), F.lit(1.0))


def _running(rows: DataFrame, of: str, order: list, value: Column) -> DataFrame:
    """``before``: sum of value over the earlier rows of a row's ``of``, by (seg, order)."""
    seg = rows.groupBy(of, "seg").agg(F.sum(value).alias("held"))
    start = seg.select(of, "seg", (F.sum("held").over(Window.partitionBy(of).orderBy("seg")) - F.col("held")).alias("start"))
    own = F.sum(value).over(Window.partitionBy(of, "seg").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - value
    return rows.withColumn("own", own).join(cut(start).hint("merge"), [of, "seg"]).withColumn("before", F.col("start") + F.col("own"))


def schedule(shares: DataFrame, slots: int) -> DataFrame:
    """``(nth, r)``: each slot's source and its rank there; shares: nth, target."""
    spark = shares.sparkSession
    to = F.sum("target").over(Window.orderBy("nth"))
    whole = F.sum("target").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    last = F.max("nth").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    spans = shares.where("target > 0").select("nth", ((to - F.col("target")) / whole).alias("lo"), F.when(F.col("nth") == last, F.lit(2.0)).otherwise(to / whole).alias("hi"))
    bins = spans.select("*", F.explode(F.sequence(F.floor(F.col("lo") * BINS), F.least(F.floor(F.col("hi") * BINS), F.lit(BINS)))).alias("bin"))
    # cumulative sums of doubles may leave a hair between neighbours: a span starts where the one before ends
    k = spark.range(slots).select(F.col("id").alias("k"), _point(F.col("id")).alias("u")).withColumn("bin", F.floor(F.col("u") * BINS))
    hit = k.join(cut(bins), "bin").where("u >= lo and u < hi").select("k", "nth")
    size = max(1024, math.isqrt(slots))
    ranked = _running(hit.withColumn("seg", F.floor(F.col("k") / size)), "nth", ["k"], F.lit(1).cast("long"))
    return ranked.select("nth", F.col("before").alias("r"))


def mix(docs: DataFrame, block_words: int = 32) -> DataFrame:
    """``(doc_id, size, source, source_size, target, taken)`` per row of docs(doc_id, text, source)."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.col("text").cast("string"), F.lit("")).cast("binary")).alias("shuffled"))
    rows = cut(rows)
    shares = cut(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"))))
    total, count = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    slots = -(-total // block_words)
    digits = max(1, math.ceil(math.log(max(count, 2), 16) / 2))
    named = rows.join(shares, rows.source.eqNullSafe(shares.source)).drop(shares.source)
    laid = _running(named.withColumn("seg", F.substring("shuffled", 1, digits)), "nth", ["shuffled", "doc_id", "size"], F.col("size"))
    turns = laid.where("size > 0").select("row", "nth", "size", "source_size", "target", "before", F.explode(F.sequence(F.lit(0), F.lit(REPEATS - 1))).alias("turn"))
    begun = turns.select("row", "nth", "size", "target", (F.col("before") + F.col("turn") * F.col("source_size")).alias("lo")).where(F.col("lo") < F.col("target") + 64 * block_words)
    blocks = begun.select("row", "nth", "size", "lo", F.explode(F.sequence(F.floor(F.col("lo") / block_words), F.floor((F.col("lo") + F.col("size") - 1) / block_words))).alias("r"))
    parts = blocks.select("row", "nth", "r", (F.least(F.col("lo") + F.col("size"), (F.col("r") + 1) * block_words) - F.greatest(F.col("lo"), F.col("r") * block_words)).alias("words"))
    taken = parts.join(schedule(shares, slots), ["nth", "r"]).groupBy("row").agg(F.sum("words").alias("taken"))
    out = named.join(taken, "row", "left")
    return out.select("doc_id", "size", "source", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, block_words: int = 32) -> DataFrame:
    """Documents in the number of copies nearest to the words taken of them; those without a word
    are left out, as they have nothing to mix."""
    plan = mix(docs, block_words).where("taken > 0").groupBy("doc_id").agg(F.sum("taken").alias("taken"), F.sum("size").alias("whole"))
    times = cut(plan.select(F.col("doc_id").alias("mixed_id"), F.floor(F.col("taken") / F.col("whole") + 0.5).cast("int").alias("times")).where("times > 0"))
    # a row for each document kept, so it is never one to broadcast
    joined = docs.join(times.hint("merge"), docs["doc_id"].cast("long").eqNullSafe(times["mixed_id"]))
    # packed as one column, so that no column of docs can clash with the copies' numbers
    return joined.select(F.struct(*(docs[c] for c in docs.columns)).alias("doc"), F.explode(F.array_repeat(F.lit(0), times["times"])).alias("copy")).select("doc.*")
