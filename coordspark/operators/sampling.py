"""Seeded sampling and fold ranks: md5 of seed and label gives the order, the label breaks ties."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coordspark.frame import LabeledFrame
from coordspark.operators.base import Transform


def turn(label: str | Column, seed: int) -> Column:
    """A pseudo-random key that any engine gives alike."""
    c = F.col(label) if isinstance(label, str) else label
    return F.md5(F.concat(F.lit(f"{seed}:"), c.cast("string")))


class TrialSampler(Transform):
    """The first ``n`` samples, after a seeded shuffle or in label order."""

    def __init__(self, n: int, shuffle: bool = True, random_state: int = 0, sample_dim: str = "trial", **kw: Any):
        super().__init__(**kw)
        self.n, self.shuffle, self.random_state, self.sample_dim = n, shuffle, random_state, sample_dim

    def _transform(self, frame: LabeledFrame) -> LabeledFrame:
        d = self.sample_dim
        order = [turn(d, self.random_state), F.col(d)] if self.shuffle else [F.col(d)]
        chosen = frame.cells.select(d).distinct().orderBy(*order).limit(self.n)
        if (have := chosen.count()) < self.n:
            raise ValueError(f"asked for {self.n} samples of {have}")
        return frame.with_cells(frame.cells.join(chosen, d, "left_semi"))


def ranked(samples: DataFrame, sample: str, strata: Sequence[str], seed: int, prefix: int = 2) -> DataFrame:
    """``samples`` with ``rank`` from 1 within each stratum, and the stratum's ``total``.

    A stratum (a class) may hold any share of the samples, so it is not ranked in one task: the leading hex
    digits of the turn part it in order, parts are counted, and a row's rank is its place in its part after
    the parts before. The join on the parts and the window share one shuffle.
    """
    named = {f"_s{i}": c for i, c in enumerate(strata)}
    keyed = samples.withColumn("_turn", turn(sample, seed)).withColumn("_part", F.substring("_turn", 1, prefix))
    within = Window.partitionBy(*named) if named else Window.partitionBy(F.lit(0))  # a row per part
    counts = keyed.groupBy(*[F.col(c).alias(n) for n, c in named.items()], F.col("_part").alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    sizes = counts.withColumn("_before", F.sum("_n").over(within.orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).withColumn("total", F.sum("_n").over(within))
    on = F.col("_part") == F.col("_p")
    for n, c in named.items():
        on = on & F.col(c).eqNullSafe(F.col(n))
    met = keyed.join(sizes, on)
    place = F.row_number().over(Window.partitionBy(*strata, "_part").orderBy("_turn", sample))
    return met.withColumn("rank", (F.col("_before") + place).cast("long")).drop("_turn", "_part", "_p", "_n", "_before", *named)


def stratified_sample(frame: LabeledFrame, coord: str, max_per_class: int = 10, seed: int = 0, sample_dim: str = "trial") -> LabeledFrame:
    """Up to ``max_per_class`` samples of each class."""
    chosen = ranked(frame.cells.select(sample_dim, coord).distinct(), sample_dim, [coord], seed).where(F.col("rank") <= max_per_class)
    return frame.with_cells(frame.cells.join(chosen.select(sample_dim), sample_dim, "left_semi"))


def sample_fraction(frame: LabeledFrame, coord: str, fraction: float, seed: int = 0, sample_dim: str = "trial") -> LabeledFrame:
    """Of each class ``max(1, floor(n * fraction))`` samples."""
    rows = ranked(frame.cells.select(sample_dim, coord).distinct(), sample_dim, [coord], seed)
    chosen = rows.where(F.col("rank") <= F.greatest(F.lit(1), F.floor(F.col("total") * fraction)))
    return frame.with_cells(frame.cells.join(chosen.select(sample_dim), sample_dim, "left_semi"))


def train_test_split(frame: LabeledFrame, target: str, test_size: float = 0.2, seed: int = 0, sample_dim: str = "trial") -> tuple[LabeledFrame, LabeledFrame]:
    """Frames of the training and the test samples, split within each class."""
    rows = ranked(frame.cells.select(sample_dim, target).distinct(), sample_dim, [target], seed)
    test = rows.where(F.col("rank") <= F.round(F.col("total") * test_size)).select(sample_dim)
    return frame.with_cells(frame.cells.join(test, sample_dim, "left_anti")), frame.with_cells(frame.cells.join(test, sample_dim, "left_semi"))
