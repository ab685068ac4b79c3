"""The edge to OCR and models: a row in, a row out, and an error placeholder for every exception (M1, M5, L1)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

RESULT = "key string, text string, failed boolean"


def transcribe(payloads: DataFrame, call: Callable[[str, bytes], str]) -> DataFrame:
    """``(key, text, failed)`` of payloads(key, content). ``call`` must be safe to repeat for a key,
    as a lost executor's rows run again."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for key, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    out.append((key, call(key, content), False))
                except Exception as e:  # the contract: a page never fails its document
                    out.append((key, f"[transcription error: {type(e).__name__}]", True))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.string()), pa.array([x[2] for x in out], pa.bool_())], ["key", "text", "failed"])

    return payloads.select("key", "content").mapInArrow(run, RESULT)
