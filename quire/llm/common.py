"""What the training-data operators share: tables, shared scratch tables, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contracts: runs of anything but space and \t..\r.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    A local session without that setting gets a folder of its own; a cluster without it is an
    error, as a machine-local folder would lose rows there.
    """
    context = spark.sparkContext
    at = context.getConf().get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if context.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"file://{tempfile.gettempdir()}/quire-{context.applicationId}"


def scratch_path(spark: SparkSession) -> str:
    return f"{scratch_dir(spark)}/quire-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and a lost executor
    costs no recomputation of what came before."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession)
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)  # when the session's JVM ends
    out = spark.read.schema(df.schema).parquet(path)
    out._quire_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete the files behind a table made by :func:`cut` that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._quire_path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def values(batch: pa.RecordBatch, size: int = 256) -> Iterator[tuple]:
    """Rows of a batch as Python values, made for ``size`` rows at a time, so that a worker never holds
    all texts of a batch a second time."""
    for at in range(0, batch.num_rows, size):
        yield from zip(*(c.to_pylist() for c in batch.slice(at, size).columns))


def crc32_of_id(doc_id: str | Column = "doc_id") -> Column:
    """crc32 of an id written as text, for folds."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string"))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)`` as ``(node, root)``, root being the smallest node.

    Alternates large-star and small-star contractions. Every round's edges go to a shared table;
    minima are aggregated map-side and joined back as a table of their own, so that Spark can
    broadcast them while small and split a hub's rows while large. Only a count and a checksum
    reach the driver. Nodes without an edge to another node are not returned.
    """
    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first())

    def star(df: DataFrame, large: bool) -> DataFrame:
        sym = df.unionAll(df.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else df
        low = cut(sym.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        near = sym.join(low, "a").where("b > a" if large else "b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        if not large:  # the node itself joins its smallest neighbour
            near = near.unionAll(low.select("a", F.col("m").alias("b")))
        near = near.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        out = cut(near.distinct())
        drop(low)
        return out

    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = mark(now)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        wide = star(now, large=True)
        then = star(wide, large=False)
        drop(wide)
        drop(now)
        now, was, seen = then, seen, mark(then)
        if seen == was:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
