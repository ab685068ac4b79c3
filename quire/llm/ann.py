"""Nearest neighbours by largest inner product: adaptive dimension scan over inverted lists.

Vectors get one more coordinate that makes all their lengths equal, so that the largest inner
product is the smallest distance, and are turned by a random rotation. They are filed under the
nearest of some centroids (k-means on a bounded sample), large lists in several blocks. A query
probes its nearest lists. Within a block its distances are built up over column blocks of the
rotated vectors; a candidate is abandoned as soon as a hypothesis test on its partial distance says
that it is unlikely to beat the query's 20th best. Every query first scans the list nearest to it,
which gives that bound for the rest. Survivors are scored exactly on the original vectors.

How many lists are probed is calibrated on the sample: the fewest that hold ``recall`` of the true
neighbours there. A query whose lists hold fewer than k other vectors goes on until they do; empty
lists are no probes. Each block is searched whole; there is no cap on candidates.

Queries of a list that many probe are dealt to several tasks as well, each with a copy of the block.

Defined results: null, empty and zero vectors and those with a null or non-finite component take no
part. Rows that repeat a vec_id are queries and candidates of their own; the other rows of a query's
vec_id are its candidates too. Vectors of one length are searched among each other, as no inner
product with another length is defined. Ties go to the smaller vec_id; extra columns are ignored; an
empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

COLUMNS, EPSILON, SEED = 16, 2.1, 7
SAMPLE, LISTS = 20_000, 8_192
#: Queries of a block that one task answers.
ASKED = 4_096


class Index:
    """Centroids, rotation and probes, all of bounded size."""

    def __init__(self, sample: np.ndarray, longest: float, total: int, k: int, recall: float) -> None:
        rng = np.random.default_rng(SEED)
        self.longest, self.dim = longest * (1 + 1e-9), sample.shape[1]
        self.turn = np.linalg.qr(rng.standard_normal((self.dim + 1, self.dim + 1)))[0]
        lists = int(np.clip(np.sqrt(total), 1, LISTS))
        x = self.raise_(sample)
        self.centroids = x[rng.choice(len(x), min(lists, len(x)), replace=False)]
        for _ in range(8):
            near = self._near(x).argmin(axis=1)
            self.centroids = np.stack([x[near == i].mean(axis=0) if (near == i).any() else c for i, c in enumerate(self.centroids)])
        asked = rng.choice(len(x), min(256, len(x)), replace=False)
        product = sample[asked] @ sample.T
        product[np.arange(len(asked)), asked] = -np.inf
        k = min(k, len(x) - 1)
        best = np.argpartition(-product, k - 1, axis=1)[:, :k] if k > 0 else np.zeros((len(asked), 0), int)
        rank = np.argsort(np.argsort(self._near(self.lower(sample[asked])), axis=1), axis=1)
        at = np.take_along_axis(rank, self._near(x).argmin(axis=1)[best], axis=1)
        held = [(at < p).mean() if at.size else 1.0 for p in range(1, len(self.centroids) + 1)]
        self.probes = next((p for p, h in enumerate(held, 1) if h >= recall), len(self.centroids))

    def raise_(self, x: np.ndarray) -> np.ndarray:
        """Vectors with the coordinate that makes them equally long."""
        return np.column_stack([x, np.sqrt(np.maximum(self.longest**2 - (x * x).sum(axis=1), 0))])

    def lower(self, q: np.ndarray) -> np.ndarray:
        return np.column_stack([q, np.zeros(len(q))])

    def _near(self, x: np.ndarray) -> np.ndarray:
        return (self.centroids**2).sum(axis=1) - 2 * (x @ self.centroids.T)

    def lists_of(self, x: np.ndarray) -> np.ndarray:
        return self._near(self.raise_(x)).argmin(axis=1)

    def probed(self, q: np.ndarray, counts: np.ndarray, k: int) -> list[list[int]]:
        """Lists in order of nearness; counts: vectors of each list, of which one may be the query."""
        near = np.where(counts > 0, self._near(self.lower(q)), np.inf)
        order = np.argsort(near, axis=1, kind="stable")[:, : np.count_nonzero(counts)]
        short = (np.cumsum(counts[order], axis=1) < k + 1).sum(axis=1) + 1
        return [o[: max(self.probes, n)].tolist() for o, n in zip(order, short)]


def scan(index: Index, q: np.ndarray, bound: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, candidate) that no test abandons; bound: the least inner product of use."""
    a, b, d = index.lower(q) @ index.turn, index.raise_(x) @ index.turn, index.dim + 1
    reach = (q * q).sum(axis=1) + index.longest**2 - 2 * bound  # squared distance

    def likely(part: np.ndarray, reach: np.ndarray, seen: int) -> np.ndarray:
        """The test on distances over the first ``seen`` columns; exact over all."""
        loose = (1 + EPSILON / np.sqrt(seen)) ** 2 * seen / d if seen < d else 1.0
        return part <= loose * reach + 1e-9 * (1 + np.abs(reach))

    first, seen = slice(0, COLUMNS), min(COLUMNS, d)
    part = (a[:, first] ** 2).sum(axis=1)[:, None] + (b[:, first] ** 2).sum(axis=1) - 2 * (a[:, first] @ b[:, first].T)
    i, j = np.nonzero(likely(part, reach[:, None], seen))
    part = part[i, j]
    for at in range(COLUMNS, d, COLUMNS):
        block = slice(at, min(at + COLUMNS, d))
        diff = a[i, block] - b[j, block]
        part = part + np.einsum("ij,ij->i", diff, diff)
        seen = min(at + COLUMNS, d)
        ok = likely(part, reach[i], seen)
        i, j, part = i[ok], j[ok], part[ok]
    return i, j


def _vectors(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)


FOUND = "row long, query_id long, vec_id long, score double"


def _search(index: Index, k: int):
    def run(held: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if held.num_rows and asked.num_rows:
            x, ids, rows = _vectors(held.column("v"), index.dim), held.column("vec_id").to_numpy(), held.column("row").to_numpy()
            order = np.lexsort((rows, ids))
            x, ids, rows = x[order], ids[order], rows[order]
            all_q, all_ids, all_bounds, all_rows = _vectors(asked.column("q"), index.dim), asked.column("query_id").to_numpy(), asked.column("bound").to_numpy(), asked.column("row").to_numpy()
            for at in range(0, len(all_q), 512):
                q, own, bound, row = (y[at : at + 512] for y in (all_q, all_ids, all_bounds.copy(), all_rows))
                seed = np.where(row[:, None] == rows[:256], -np.inf, q @ x[:256].T)
                if seed.shape[1] >= k:
                    bound = np.maximum(bound, -np.partition(-seed, k - 1, axis=1)[:, k - 1] - 1e-12)
                bound = np.where(np.isfinite(bound), bound, -(index.longest**2) - (q * q).sum(axis=1))
                i, j = scan(index, q, bound, x)
                ok = row[i] != rows[j]
                i, j = i[ok], j[ok]
                s = np.einsum("ij,ij->i", q[i], x[j])
                o = np.lexsort((ids[j], -s, i))
                i, j, s = i[o], j[o], s[o]
                nth = np.arange(len(i)) - np.searchsorted(i, i, "left")
                i, j, s = i[nth < k], j[nth < k], s[nth < k]
                out.append((row[i], own[i], ids[j], s))
        cols = [np.concatenate([x[c] for x in out]) if out else [] for c in range(4)]
        return pa.table({c: pa.array(x, pa.float64() if c == "score" else pa.int64()) for c, x in zip(("row", "query_id", "vec_id", "score"), cols)})

    return run


def usable(vectors: DataFrame) -> DataFrame:
    """``(row, vec_id, v, dim)``: vectors that take part, as arrays of double, each row with a number."""
    rows = vectors.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    fine = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    return cut(fine.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v", F.size("v").alias("dim")))


def nearest(vectors: DataFrame, is_query: str = "vec_id % 20 = 0", k: int = 20, recall: float = 0.96) -> DataFrame:
    """``(query_id, rank, vec_id, score)`` for the rows of vectors(vec_id, embedding) that
    ``is_query`` selects, against all rows."""
    rows = usable(vectors)
    dims = [r.dim for r in rows.select("dim").distinct().collect()]  # a row for each length of vectors
    parts = [_of_length(rows.where(F.col("dim") == n).drop("dim"), is_query, k, recall) for n in sorted(dims)]
    if not parts:
        return rows.selectExpr("vec_id as query_id", "1 as rank", "vec_id", "0.0D as score").where("false")
    return reduce(DataFrame.unionByName, parts)


def _of_length(rows: DataFrame, is_query: str, k: int, recall: float) -> DataFrame:
    top = rows.agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("m")).first()
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(SAMPLE).select("v").toPandas()["v"]
    index = Index(np.stack(sample.to_numpy()), float(np.sqrt(top.m)), top.n, k, recall)
    dim = index.dim

    def matrix(b: pa.RecordBatch) -> np.ndarray:
        return b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = matrix(b)
                yield pa.RecordBatch.from_pydict({"list": pa.array(index.lists_of(x), pa.int64()), "row": b.column(0), "vec_id": b.column(1), "v": pa.array([r.tobytes() for r in x], pa.binary())})

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                q = matrix(b)
                yield pa.RecordBatch.from_pydict({"row": b.column(0), "query_id": b.column(1), "q": pa.array([r.tobytes() for r in q], pa.binary()), "lists": pa.array(index.probed(q, counts, k), pa.list_(pa.int64()))})

    held = cut(rows.mapInArrow(file, "list long, row long, vec_id long, v binary"))
    size = max(256, top.n // len(index.centroids))
    counts = np.zeros(len(index.centroids), np.int64)
    for r in held.groupBy("list").count().collect():  # a row for each centroid, LISTS at most
        counts[r["list"]] = r["count"]
    blocks = held.groupBy("list").agg(F.ceil(F.count("*") / size).cast("long").alias("blocks"))
    blocks = F.broadcast(cut(blocks))  # a row for each centroid, LISTS at most
    filed = held.join(blocks, "list").withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks"))).drop("blocks")
    queries = cut(rows.where(is_query).mapInArrow(ask, "row long, query_id long, q binary, lists array<bigint>"))

    def found(lists, bound: DataFrame | None) -> DataFrame:
        asked = queries if bound is None else queries.join(bound, "row", "left")
        b = F.lit(float("-inf")) if bound is None else F.coalesce("bound", F.lit(float("-inf")))
        asked = asked.select("row", "query_id", "q", b.alias("bound"), F.explode(lists).alias("list"))
        shares = queries.select(F.explode(lists).alias("list")).groupBy("list").agg(F.ceil(F.count("*") / ASKED).cast("long").alias("shares"))
        shares = F.broadcast(cut(shares))  # a row for each centroid, LISTS at most
        asked = asked.join(blocks, "list").join(shares, "list")
        asked = asked.select("row", "query_id", "q", "bound", "list", F.pmod(F.xxhash64("row", F.lit(1)), F.col("shares")).alias("share"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
        held_ = filed.join(shares, "list").withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1))).drop("shares")
        at = ("list", "block", "share")
        return held_.groupBy(*at).cogroup(asked.groupBy(*at)).applyInArrow(_search(index, k), FOUND)

    nth = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    start = cut(found(F.slice("lists", 1, 1), None))
    bound = start.withColumn("nth", nth).where(F.col("nth") == k).select("row", (F.col("score") - 1e-12).alias("bound"))
    rest = found(F.slice("lists", 2, len(index.centroids)), cut(bound))
    ranked = start.unionByName(rest).withColumn("rank", nth).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
