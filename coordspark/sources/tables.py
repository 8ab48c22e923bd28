"""Sources: Parquet tables as labelled frames; synthetic generators for tests; a sink for runs."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coordspark.frame import LabeledFrame


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_frame(spark: SparkSession, path: str, dims: Sequence[str], value: str, coords: dict[str, str] | None = None) -> LabeledFrame:
    """Cells from a Parquet table; only the named columns are read."""
    return LabeledFrame.from_table(spark.read.parquet(path), dims, value, coords)


def write_frame(frame: LabeledFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    frame.cells.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_runs(runs: DataFrame, path: str) -> None:
    """Appends trials to a store of runs."""
    runs.write.mode("append").parquet(path)


# Views of the driver's tables as cubes.

def vectors(spark: SparkSession, sf_dir: str) -> LabeledFrame:
    """Embeddings: trial by feature, with label and session."""
    e = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("trial"), F.col("label"), (F.col("vec_id") % 4).alias("session"), "embedding")
    return LabeledFrame.from_dense(e, "trial", "embedding", "feature", ["label", "session"])


def cube(spark: SparkSession, sf_dir: str) -> LabeledFrame:
    """Embeddings: trial by channel (8) by time (8), with label and session."""
    e = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("trial"), F.col("label"), (F.col("vec_id") % 4).alias("session"), "embedding")
    return LabeledFrame.from_dense(e, "trial", "embedding", {"channel": 8, "time": 8}, ["label", "session"])


def grid(spark: SparkSession, sf_dir: str) -> LabeledFrame:
    """Embeddings: trial by channel (0..63 on an 8 x 8 grid)."""
    e = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("trial"), "embedding")
    return LabeledFrame.from_dense(e, "trial", "embedding", "channel")


def long_cube(spark: SparkSession, sf_dir: str) -> LabeledFrame:
    """Embeddings: eight vectors make a trial's channels, positions are time (64)."""
    e = read_table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 8").alias("trial"), (F.col("vec_id") % 8).alias("channel"), F.posexplode("embedding").alias("time", "value"))
    return LabeledFrame.from_table(e, ["trial", "channel", "time"])


def events(spark: SparkSession, sf_dir: str) -> LabeledFrame:
    """Mean event value by user, event type and day; sparse."""
    e = read_table(spark, sf_dir, "events")
    cells = e.groupBy(F.col("user_id").alias("trial"), F.col("event_type").alias("channel"), F.dayofmonth("ts").alias("time")).agg(F.avg("value").alias("value"))
    return LabeledFrame.from_table(cells, ["trial", "channel", "time"])


def document_measures(spark: SparkSession, sf_dir: str) -> LabeledFrame:
    """Labelled documents: simple measures of the text, with quality, lang and source."""
    d = read_table(spark, sf_dir, "documents").join(read_table(spark, sf_dir, "labels"), "doc_id")
    cells = d.select(F.col("doc_id").alias("trial"), "quality", "toxic", "lang", "source", F.explode(F.create_map(F.lit("chars"), F.col("n_chars").cast("double"), F.lit("bytes"), F.octet_length("text").cast("double"), F.lit("lines"), F.size(F.split("text", "\n")).cast("double"))).alias("feature", "value"))
    return LabeledFrame.from_table(cells, ["trial", "feature"], coords=dict.fromkeys(("quality", "toxic", "lang", "source"), "trial"))


# Generators, for tests and demonstrations.

def toy(spark: SparkSession, n_trials: int = 60, channels: int = 4, times: int = 25, classes: Sequence[str] = ("a", "b", "c"), sessions: int = 2, noise: float = 1.0, seed: int = 0) -> LabeledFrame:
    """Trials whose classes raise the signal of one channel each."""
    rng = np.random.default_rng(seed)
    rows = []
    for t in range(n_trials):
        k = t % len(classes)
        x = rng.normal(0, noise, (channels, times))
        x[k % channels] += 1.5
        rows.append((t, classes[k], f"s{t % sessions}", x.ravel().tolist()))
    df = spark.createDataFrame(rows, "trial long, stimulus string, session string, x array<double>")
    return LabeledFrame.from_dense(df, "trial", "x", {"channel": channels, "time": times}, ["stimulus", "session"])


def field_potentials(spark: SparkSession, n_trials: int = 1000, n_channels: int = 128, fs: float = 500.0, seconds: float = 2.2, classes: Sequence[str] = ("a", "b", "c", "d"), seed: int = 0) -> LabeledFrame:
    """1/f noise with a band boosted per class and log-normal gains of trials and channels, made on executors."""
    n, bands = int(fs * seconds), [(4, 8), (8, 12), (12, 30), (30, 55)]

    def make(frames):
        for f in frames:
            for t in f["id"]:
                rng = np.random.default_rng([seed, int(t)])
                k = int(t) % len(classes)
                freqs = np.fft.rfftfreq(n, 1 / fs)
                amplitude = 1 / np.maximum(freqs, 1.0)
                low, high = bands[k % len(bands)]
                amplitude = amplitude * np.where((freqs >= low) & (freqs <= high), 1.6, 1.0)
                phase = rng.uniform(0, 2 * np.pi, (n_channels, len(freqs)))
                x = np.fft.irfft(amplitude * np.exp(1j * phase), n) * rng.lognormal(0, 0.2) * rng.lognormal(0, 0.2, (n_channels, 1))
                yield pd.DataFrame({"trial": t, "stimulus": classes[k], "session": f"s{int(t) % 3}", "channel": np.arange(n_channels).astype(str), "x": list(x)})

    rows = spark.range(n_trials).mapInPandas(make, "trial long, stimulus string, session string, channel string, x array<double>")
    cells = rows.select("trial", "stimulus", "session", "channel", F.posexplode("x").alias("_i", "value")).withColumn("time", F.col("_i") * (1000.0 / fs))
    return LabeledFrame.from_table(cells, ["trial", "channel", "time"], coords={"stimulus": "trial", "session": "trial"}, fs=fs)
