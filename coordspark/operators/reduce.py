"""Reductions over named dimensions."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coordspark.frame import VALUE, LabeledFrame
from coordspark.operators.base import Transform


class Average(Transform):
    """The mean over ``dims``; missing cells are left out, coordinates of reduced dimensions vanish."""

    def __init__(self, dims: str | Sequence[str], **kw: Any):
        super().__init__(**kw)
        self.dims = dims

    def _dims(self) -> list[str]:
        return [self.dims] if isinstance(self.dims, str) else list(self.dims)

    def output_dims(self, dims: tuple[str, ...]) -> tuple[str, ...]:
        return tuple(d for d in dims if d not in self._dims())

    def _transform(self, frame: LabeledFrame) -> LabeledFrame:
        kept = frame.others(*self._dims())
        cells = frame.cells.groupBy(*kept, *frame.coords_of(*kept)).agg(F.avg(VALUE).alias(VALUE))
        return frame.with_cells(cells, kept)


def statistics(frame: LabeledFrame, per_dim: str | Sequence[str]) -> DataFrame:
    """mean, std (population) and n over all dimensions but ``per_dim``."""
    keys = [per_dim] if isinstance(per_dim, str) else list(per_dim)
    frame.require(*keys)
    return frame.cells.groupBy(*keys).agg(F.avg(VALUE).alias("mean"), F.stddev_pop(VALUE).alias("std"), F.count(VALUE).alias("n"))


def class_means(frame: LabeledFrame, target: str, sample_dim: str) -> DataFrame:
    """``(target, feature dimensions, value)``: the mean over the samples of each class."""
    return frame.cells.groupBy(target, *frame.others(sample_dim)).agg(F.avg(VALUE).alias(VALUE))


def class_counts(frame: LabeledFrame, target: str, sample_dim: str, group: str | None = None) -> DataFrame:
    """``([group,] target, n)``: samples of each class."""
    keys = [*([group] if group else []), target]
    return frame.cells.select(sample_dim, *keys).distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def min_class_count(frame: LabeledFrame, target: str, sample_dim: str, group: str) -> int:
    """The smallest number of samples of any class in any group."""
    return class_counts(frame, target, sample_dim, group).agg(F.min("n")).first()[0] or 0


def covariance(frame: LabeledFrame, dim: str, over: Sequence[str] | None = None) -> DataFrame:
    """``(dim, other, cov, n)``: sample covariance of the labels of ``dim`` over aligned cells, upper triangle."""
    over = list(over or frame.others(dim))
    a = frame.cells.select(*over, dim, F.col(VALUE).alias("x"))
    b = frame.cells.select(*over, F.col(dim).alias("other"), F.col(VALUE).alias("y"))
    return a.join(b, over).where(F.col(dim) <= F.col("other")).groupBy(dim, "other").agg(F.covar_samp("x", "y").alias("cov"), F.count(F.lit(1)).alias("n"))
