"""What the operators of this subpackage share: written tables, checked broadcasts, whole-text inputs."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import cache, cached_property
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast below this many bytes, by its counted rows and a stated width; above it Spark joins by shuffle.
BROADCAST_BYTES = 16 << 20
#: Paths of the tables that ``written`` made, a list for each ``scratch`` that is open and one for all else.
_MADE: list[list[str]] = [[]]


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, else a temporary one in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = _own_folder()
    return folder.rstrip("/")


@cache
def _own_folder() -> str:
    """One temporary folder for this process; in local mode the driver is the only machine."""
    return "file://" + tempfile.mkdtemp(prefix="coordspark-")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/coordspark/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, partition_by: list[str] | None = None, keep: bool = False) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage ends there, and a lost executor loses nothing.

    With ``keep`` it outlives the ``scratch`` that is open, though not one around that.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    _MADE[-2 if keep and len(_MADE) > 1 else -1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, the tables that ``written`` made inside it: for steps whose result is stored by then."""
    _MADE.append([])
    try:
        yield
    finally:
        for path in _MADE.pop():
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder of any store that Spark knows."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clear_written(spark: SparkSession) -> None:
    """Deletes what ``written`` and the writers left in the shared folder; only when no result is still to be read."""
    delete(spark, f"{shared_folder(spark)}/coordspark")


def small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df``, marked for broadcast only if its counted rows times ``row_bytes`` stay within ``limit``.

    ``df`` should be a written table, so that counting it costs little.
    """
    return F.broadcast(df) if df.limit(limit // row_bytes + 1).count() * row_bytes <= limit else df


def fits(df: DataFrame, width: int | Column, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df``, marked for broadcast only if its rows of ``width`` bytes, measured where it is a column, stay within
    ``limit``. ``df`` should be a written table."""
    if isinstance(width, int):
        return small(df, width, limit)
    size = df.agg(F.sum(width).alias("bytes")).first()["bytes"] or 0
    return F.broadcast(df) if size <= limit else df


def matched(rows: DataFrame, one: DataFrame, on: list[str], width: int | Column, how: str = "inner", counted: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """``rows`` joined to ``one``, which holds a row for each key at most; both should be written tables. Where
    ``rows`` is dear to make, ``counted`` may be a written table with the same keys.

    A key of ``rows`` may hold any part of them. ``one`` is broadcast if it ``fits`` (``limit``). Else keys that hold more than
    an even task's share of ``rows`` are split by a salt into so many even shares, and their rows of ``one``
    repeated as often: fewer than two rows for each shuffle partition in all.
    """
    if (sent := fits(one, width) if limit is None else fits(one, width, limit)) is not one:
        return rows.join(sent, on, how)
    spark = rows.sparkSession
    counted = rows if counted is None else counted
    parts, total = int(spark.conf.get("spark.sql.shuffle.partitions")), counted.count()
    share = F.ceil(F.count(F.lit(1)) * parts / F.lit(max(total, 1))).cast("int").alias("_shares")
    crowded = counted.groupBy(*on).agg(share).where("_shares > 1")
    keys = crowded.collect()  # fewer than parts
    if not keys:
        return rows.join(one, on, how)
    hot = F.broadcast(spark.createDataFrame(keys, crowded.schema))
    salt = F.coalesce(F.pmod(F.monotonically_increasing_id(), F.col("_shares")), F.lit(0)).cast("int")
    salted = rows.join(hot, on, "left").withColumn("_salt", salt).drop("_shares")
    if how == "left_semi":
        one = one.select(*on)
        how = "inner"
    each = F.explode(F.sequence(F.lit(0), F.coalesce("_shares", F.lit(1)) - 1))
    repeated = one.join(hot, on, "left").withColumn("_salt", each).drop("_shares")
    return salted.join(repeated, [*on, "_salt"], how).drop("_salt")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str | Column = "text") -> Column:
    """The text with null as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def per_worker(key: Any, make: Callable[[], Any]) -> Any:
    """One value for each Python worker process, kept between its tasks."""
    kept = sys.__dict__.setdefault("_coordspark_kept", {})
    if key not in kept:
        kept[key] = make()
    return kept[key]


class Shared:
    """A value that tasks read: sent once to each executor, unpacked once in each task.

    The caller sees to a bound on its size.
    """

    def __init__(self, spark: SparkSession, value: Any):
        self._sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    @cached_property
    def value(self) -> Any:
        return cloudpickle.loads(self._sent.value)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs that run inside send Python at most this many rows at a time; the session's setting is put back."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def give_back(keep: bool = False) -> None:
    """Returns freed memory of this worker process to the system, where the libraries can, and without ``keep`` what
    the worker kept for other operators."""
    import pyarrow

    if not keep:
        sys.__dict__.get("_coordspark_kept", {}).clear()
    pyarrow.default_memory_pool().release_unused()
    try:
        trim = ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):
        return
    trim(0)


def pieces(texts: list[str], limit: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` with about ``limit`` characters each, to bound what is held at a time."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= limit:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
