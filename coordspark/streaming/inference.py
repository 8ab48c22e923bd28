"""Inference over a stream: transforms that work sample by sample run on micro-batches as they do on tables.

A stream of dense samples is read, each micro-batch becomes a frame, the fitted transform or pipeline is
applied, and the result is appended. Fitted statistics are static, so no state is kept between batches.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from coordspark.frame import LabeledFrame


def stream_frames(samples: DataFrame, sample: str, array: str, dims: Mapping[str, int] | str, coords: Sequence[str], apply: Callable[[LabeledFrame], DataFrame], path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Starts the query; each batch is written once, to a folder of its own number, so a retry replaces it."""

    def one(batch: DataFrame, number: int) -> None:
        frame = LabeledFrame.from_dense(batch, sample, array, dims, coords)
        apply(frame).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = samples.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share: under ``spark.checkpoint.dir``, a temporary one in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="coordspark-stream-")
    return f"{folder.rstrip('/')}/stream-{uuid.uuid4().hex}"


def run_once(samples: DataFrame, sample: str, array: str, dims: Mapping[str, int] | str, coords: Sequence[str], apply: Callable[[LabeledFrame], DataFrame]) -> DataFrame:
    """Everything that the stream has now, through ``stream_frames``, as a table."""
    out = scratch(samples.sparkSession)
    stream_frames(samples, sample, array, dims, coords, apply, f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    return samples.sparkSession.read.parquet(f"{out}/rows").drop("batch")
