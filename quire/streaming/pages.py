"""Page logs and usage as streams."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.log import last_per_image


def page_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """New JSON line files of a folder."""
    return spark.readStream.schema(schema).option("recursiveFileLookup", True).json(path)


def keep_latest(stream: DataFrame, target: str, checkpoint: str, keys: tuple[str, ...] = ("source", "image_name")) -> StreamingQuery:
    """Add each batch to a table of page records (L3, L4). A batch is one folder named after its
    checkpoint and number, so one that runs again after a failure replaces itself, and a new checkpoint
    never meets the folders of an old one; nothing that was written before is written again."""
    run = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]

    def add(batch: DataFrame, n: int) -> None:
        last_per_image(batch, keys).drop("first_pos").write.mode("overwrite").parquet(f"{target}/batch={run}-{n}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, target: str, keys: tuple[str, ...] = ("source", "image_name")) -> DataFrame:
    """The latest record per page of a table made by :func:`keep_latest`: a later record replaces an
    earlier one, however late its batch came (L5)."""
    return last_per_image(spark.read.parquet(target).drop("batch"), keys).drop("first_pos")


def daily_usage(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Tokens per budget day, which begins at 00:01 UTC (L6); stream: ts, tokens and a pool."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", "1 day", "1 day", "1 minute"), "pool").agg(F.sum("tokens").alias("tokens")).select(F.to_date("window.start").alias("day"), "pool", "tokens")


def run_to_end(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], mode: str = "update") -> None:
    """Work off what there is and stop."""
    stream.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
