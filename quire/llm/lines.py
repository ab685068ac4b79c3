"""Line dedup by a suffix array over line numbers.

Each line becomes a rank: the place of its text in the order of all repeated lines. Prefix doubling
then ranks runs of 2, 4, 8, ... lines by the pair of ranks of their halves, and goes on until no run
repeats: a suffix whose rank no other has, or that ends with its document, is settled and leaves.
Suffixes of equal rank are an interval of the suffix array with a common prefix that long.

The intervals are then taken apart from the longest runs down. From a group of suffixes that share l
lines, those that share 2**k more with an earlier one (by doc_id, then line) move to a group of
l + 2**k lines, for k downwards; the earliest of every part stays in the group as well, to stand for
the part. In the end each suffix is in the group of the longest run that it shares with any earlier
suffix, and that length is its own longest common prefix with them.

Such a run is deleted if it holds ``min_words`` words or more: later copies go, the first stays.
Overlapping and adjoining deletions merge into maximal runs. Runs of fewer words, such as headings,
stay.

Ranks are dealt by range over distinct keys, counted map-side, so a line in very many documents is
one row there. Ranks and first suffixes are tables of their own, one row a group, so that joining them
back can broadcast them while small and split hot groups while large.

Defined results: lines are split at \\n; blank lines are lines without words. A null text has no line
and stays null; an empty text is one empty line; a very long text is as many rows as it has lines.
Rows that repeat a doc_id are put in order of their text, and null ids come last. Extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut

WORDS = re.compile(WORD)
KINDS = {"doc_id": pa.int64(), "n_lines": pa.int64(), "n_deleted": pa.int64(), "n_runs": pa.int64(), "text": pa.string()}


def _rank(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows whose key ``by`` others have too, with its rank: a number in order of the keys (the range that
    a key is dealt to, then its place there)."""
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = rows.groupBy(*by).agg(F.count("*").alias("times")).where("times > 1").select(*by)
    ranks = cut(keys.repartitionByRange(n, *by).sortWithinPartitions(*by).select(*by, F.monotonically_increasing_id().alias("rank")))
    return cut(rows.join(ranks, by).select("doc", "pos", "rank"))


MIN_WORDS = 8


def _doubled(lines: DataFrame) -> list[DataFrame]:
    """Tables ``(doc, pos, rank)`` of the repeated runs of 1, 2, 4, ... lines, until none repeats."""
    rows, out = _rank(cut(lines), ["a", "b"]), []
    while not rows.isEmpty():
        out.append(rows)
        after = rows.select("doc", (F.col("pos") - (1 << len(out) - 1)).alias("pos"), F.col("rank").alias("b"))
        rows = _rank(cut(rows.withColumnRenamed("rank", "a").join(after, ["doc", "pos"])), ["a", "b"])
    return out


def repeated_runs(docs: DataFrame) -> DataFrame:
    """``(doc, pos, size)``: how many lines from each line on an earlier line is followed by as well, for
    the lines that have any; docs: doc, text."""
    lines = docs.select("doc", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    levels = _doubled(lines.select("doc", "pos", F.xxhash64("line").alias("a"), F.xxhash64(F.lit("line"), "line").alias("b")))
    groups = None  # (number, size): a group; apart: no longer among all suffixes, as an earlier one shares more
    for k in range(len(levels) - 1, -1, -1):
        fresh = levels[k] if groups is None else levels[k].join(groups.where("apart").select("doc", "pos").distinct(), ["doc", "pos"], "left_anti")
        parts = fresh.select(F.lit(-1).cast("long").alias("number"), F.lit(0).alias("size"), F.lit(False).alias("apart"), "doc", "pos", "rank")
        if groups is not None:
            there = levels[k].select(F.col("doc").alias("d"), F.col("pos").alias("p"), "rank")
            parts = parts.unionByName(groups.join(there, F.expr("doc = d and pos + size = p"), "left").select(*parts.columns))
        parts = cut(parts)
        known = parts.where("rank is not null")
        first = cut(known.groupBy("number", "size", "rank").agg(F.min(F.struct("doc", "pos")).alias("first"), F.count("*").alias("n")))
        at = known.join(first, ["number", "size", "rank"]).withColumn("later", F.struct("doc", "pos") > F.col("first"))
        # those that share more get a group of their own, numbered by the group before and the rank; the
        # earliest of them, and those that share no more, are in the old group as well
        longer = F.when(F.col("n") > 1, F.struct(F.xxhash64("number", "size", "rank").alias("number"), (F.col("size") + (1 << k)).alias("size"), (F.col("apart") | F.col("later")).alias("apart")))
        stays = F.when(~F.col("later") & (F.col("size") > 0), F.struct("number", "size", "apart"))
        both = at.select("doc", "pos", F.explode(F.array_compact(F.array(longer, stays))).alias("g")).select("g.*", "doc", "pos")
        groups = cut(both.unionByName(parts.where("rank is null").select(*both.columns)))
    if groups is None:
        return lines.select("doc", "pos", F.lit(0).alias("size")).where("false")
    low = cut(groups.groupBy("number", "size").agg(F.min(F.struct("doc", "pos")).alias("first")))
    return groups.join(low, ["number", "size"]).where(F.struct("doc", "pos") > F.col("first")).groupBy("doc", "pos").agg(F.max("size").alias("size"))


def remove_repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``(doc_id, n_lines, n_deleted, n_runs, text)`` per row of docs."""
    id_ = F.col("doc_id").cast("long")
    unique = docs.groupBy(id_.alias("doc_id")).agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").select("doc_id")
    own = docs.select(id_.alias("doc_id"), F.col("text").cast("string").alias("text"))
    if unique.isEmpty():
        named = own.withColumn("doc", F.col("doc_id"))
    else:
        copy = F.row_number().over(Window.partitionBy("doc_id").orderBy("text")) - 1
        named = cut(own.withColumn("doc", F.struct(F.col("doc_id").isNull().cast("int").alias("missing"), F.coalesce("doc_id", F.lit(0)).alias("id"), copy.alias("copy"))))
    runs = repeated_runs(named.select("doc", "text")).groupBy("doc").agg(F.collect_list(F.struct("pos", "size")).alias("runs"))
    # a row for each document with repeated lines, so it is never one to broadcast
    held = named.join(cut(runs).hint("merge"), "doc", "left").select("doc_id", "text", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc_id, text, runs in zip(*(b.column(i).to_pylist() for i in range(3))):
                lines = text.split("\n") if text is not None else []
                drop = deleted(lines, [(r["pos"], r["size"]) for r in runs or ()], min_words)
                n = sum(p - 1 not in drop for p in drop)
                out.append((doc_id, len(lines), len(drop), n, "\n".join(x for i, x in enumerate(lines) if i not in drop) if drop else text))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(KINDS.values())], list(KINDS))

    return held.mapInArrow(run, "doc_id long, n_lines long, n_deleted long, n_runs long, text string")


def deleted(lines: list[str], runs: list[tuple[int, int]], min_words: int) -> set[int]:
    """Lines of the runs that hold so many words."""
    before, gone, end = [0], set(), 0
    for line in lines:
        before.append(before[-1] + len(WORDS.findall(line)))
    for at, size in sorted(runs):
        if before[at + size] - before[at] >= min_words:
            gone.update(range(max(at, end), at + size))
            end = max(end, at + size)
    return gone
