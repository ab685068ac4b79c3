"""SimHash near-duplicates over a segment-popcount grid.

A 64-bit fingerprint is mapped to the bit counts of its 16 four-bit segments. Differing bits bound
the Manhattan distance of two such vectors from above, so fingerprints within 2 bits lie within
distance 2 on the grid and share a grid point at distance 1 or less of both. Each distinct
fingerprint is dealt to the (at most 33) grid points that near; points holding several are searched
and every pair is verified exactly. Points holding more than ``cell_cap`` fingerprints are refined
to segments of one bit, where the vector is the fingerprint and two of them share a point exactly if
they differ in 2 bits or fewer: there a star to the smallest member links all without pairs.

Defined results: null, empty and all-blank texts have no word and the fingerprint zero, which links
like any other. Repeated rows and ties keep their own row in the result. A null doc_id keeps its row
and is never a component's id. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, cut, values

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
PIECE = 1 << 20


def _words(text: bytes) -> Iterator[list[bytes]]:
    """Words of a text in lists of bounded size; each list but the first starts with the last two
    words before it, so that no shingle is lost between lists."""
    low, at, last = text.translate(LOWER), 0, []
    while at < len(low):
        end = at + PIECE
        while end < len(low) and low[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        found = last + low[at:end].split()
        yield found
        last, at = found[-2:], end


def fingerprint(text: bytes | None) -> int:
    """Signed 64-bit SimHash of the 3-word shingles of a text."""
    if not text:
        return 0
    total, count, few = 0, np.zeros(64, np.int64), []
    for w in _words(text):
        if len(w) < 3:
            few = w
            continue
        raw = b"".join(map(xxhash.xxh64_digest, map(b" ".join, zip(w, w[1:], w[2:])), repeat(42)))
        bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1)
        count += bits.sum(axis=0, dtype=np.int64)
        total += len(bits)
    if not total:
        return int.from_bytes(xxhash.xxh64_digest(b" ".join(few), 42), "big", signed=True) if few else 0
    return int.from_bytes(np.packbits(count * 2 > total).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, fp)`` for every row of docs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(x) for _, x in values(b)], pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _points(bits: int):
    """Deals fingerprints to the points at distance 1 or less on the grid of segments of ``bits``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 64 // bits
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            seg = (fp[:, None] >> np.arange(0, 64, bits, dtype=np.uint64)) & np.uint64((1 << bits) - 1)
            count = np.bitwise_count(seg).astype(np.int64)
            place = np.array([(bits + 1) ** i if bits > 1 else 1 << i for i in range(n)], np.uint64)
            at = (count.astype(np.uint64) * place).sum(axis=1, dtype=np.uint64)
            up, down = at[:, None] + place, at[:, None] - place
            point = np.column_stack([at, up, down])
            ok = np.column_stack([np.ones(len(fp), bool), count < bits, count > 0])
            row = np.nonzero(ok)[0]
            yield pa.RecordBatch.from_arrays([pa.array(fp[row].view(np.int64)), pa.array(point[ok].view(np.int64))], ["fp", "point"])

    return run


def links(fps: DataFrame, cell_cap: int = 32) -> DataFrame:
    """Edges ``(a, b)`` that connect all distinct fingerprints within 2 bits of each other."""
    cells = fps.select("fp").mapInArrow(_points(4), "fp long, point long")
    held = cut(cells.withColumn("n", F.count("*").over(Window.partitionBy("point"))).where("n > 1"))
    small = held.where(F.col("n") <= cell_cap).groupBy("point").agg(F.collect_list("fp").alias("all")).select("all", F.explode("all").alias("a"))
    pairs = small.select("a", F.explode(F.filter("all", lambda b: (b > F.col("a")) & (F.bit_count(b.bitwiseXOR(F.col("a"))) <= 2))).alias("b"))
    crowd = held.where(F.col("n") > cell_cap).select("fp").distinct()
    points = crowd.mapInArrow(_points(1), "fp long, point long")
    stars = points.select(F.col("fp").alias("a"), F.min("fp").over(Window.partitionBy("point")).alias("b")).where("a <> b")
    return pairs.unionAll(stars).distinct()


def near_duplicates(docs: DataFrame, cell_cap: int = 32) -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row of docs."""
    fps = cut(fingerprints(docs))
    nodes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = components(links(nodes.select("fp"), cell_cap))
    of_node = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    of_node = cut(of_node)
    of_root = cut(of_node.groupBy("root").agg(F.min("first_id").alias("component_id")))
    of_fp = cut(of_node.join(of_root, "root").select("fp", "component_id"))
    return fps.join(of_fp, "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest doc_id, once.

    Rows without doc_id can't be told apart by id and stay."""
    kept = near_duplicates(docs).where("doc_id = component_id").select("doc_id").distinct()
    named = docs.where("doc_id is not null").join(cut(kept), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return named.select(docs.columns).unionByName(docs.where("doc_id is null"))
