"""Normalisation and cleaning.

Without ``use_fit`` statistics and their use are one window over ``per_dim``: one shuffle, no second scan.
Where ``per_dim`` is not the sample dimension it has few labels, so few that a window would put all cells into
as many tasks; the statistic is then a partial aggregate that is joined back.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coordspark.frame import VALUE, LabeledFrame
from coordspark.operators.base import Transform, TransformError
from coordspark.operators.reduce import statistics
from coordspark.operators.select import by_conditions, signal_channels


class _PerDim(Transform):
    keeps_shape = True

    def __init__(self, per_dim: str | Sequence[str], use_fit: bool = False, fit_sel: Mapping | None = None, sample_dim: str = "trial", **kw: Any):
        super().__init__(**kw)
        self.per_dim, self.use_fit, self.fit_sel, self.sample_dim = per_dim, use_fit, fit_sel, sample_dim
        self.stats: DataFrame | None = None

    @property
    def is_stateful(self) -> bool:
        """Conditions for the fit imply a fit."""
        return bool(self.use_fit or self.fit_sel)

    def _keys(self) -> list[str]:
        return [self.per_dim] if isinstance(self.per_dim, str) else list(self.per_dim)

    def _fit(self, frame: LabeledFrame) -> None:
        if self.is_stateful:
            self.stats = statistics(by_conditions(frame, self.fit_sel) if self.fit_sel else frame, self._keys())

    def _applied(self, value: Column, mean: Column, std: Column) -> Column:
        raise NotImplementedError

    def _transform(self, frame: LabeledFrame) -> LabeledFrame:
        keys = self._keys()
        frame.require(*keys)
        if not self.is_stateful and self.sample_dim in keys:
            w = Window.partitionBy(*keys)
            return frame.with_value(self._applied(F.col(VALUE), F.avg(VALUE).over(w), F.stddev_pop(VALUE).over(w)))
        stats = self.stats if self.is_stateful else statistics(frame, keys)
        if stats is None:
            raise TransformError(f"{type(self).__name__} is not fitted")
        joined = frame.cells.join(stats.select(*keys, "mean", "std"), keys)
        return frame.with_cells(joined.withColumn(VALUE, self._applied(F.col(VALUE), F.col("mean"), F.col("std"))))


class Demean(_PerDim):
    """The value less the mean over all dimensions but ``per_dim``."""

    def _applied(self, value: Column, mean: Column, std: Column) -> Column:
        return value - mean


class ZScore(_PerDim):
    """The value in population standard deviations from the mean; null where the deviation is zero."""

    def _applied(self, value: Column, mean: Column, std: Column) -> Column:
        return F.try_divide(value - mean, std)


class RemoveOutliers(_PerDim):
    """The value, clipped to ``std_threshold`` standard deviations from the mean."""

    def __init__(self, per_dim: str | Sequence[str], std_threshold: float = 5.0, use_fit: bool = False, fit_sel: Mapping | None = None, sample_dim: str = "trial", **kw: Any):
        super().__init__(per_dim, use_fit, fit_sel, sample_dim, **kw)
        self.std_threshold = std_threshold

    def _applied(self, value: Column, mean: Column, std: Column) -> Column:
        reach = std * F.lit(float(self.std_threshold))
        return F.when(value.isNotNull(), F.greatest(mean - reach, F.least(mean + reach, value)))


class CommonAverage(Transform):
    """Signal channels less their common mean; excluded channels stay. Method ``all``, or ``none`` for nothing."""

    keeps_shape = True

    def __init__(self, method: str | None = "all", excluded_channels: Sequence[str] = (), channel_dim: str = "channel", **kw: Any):
        super().__init__(**kw)
        if method not in ("all", "none", None):
            raise ValueError(f"unknown method {method!r}")
        self.method, self.excluded_channels, self.channel_dim = method, excluded_channels, channel_dim

    def _transform(self, frame: LabeledFrame) -> LabeledFrame:
        if self.method in ("none", None):
            return frame
        signal = signal_channels(self.channel_dim, self.excluded_channels)
        common = F.avg(F.when(signal, F.col(VALUE))).over(Window.partitionBy(*frame.others(self.channel_dim)))
        return frame.with_value(F.when(signal, F.col(VALUE) - common).otherwise(F.col(VALUE)))


class RegressOutReference(Transform):
    """Each signal channel less its least-squares fit (with intercept) on a reference channel.

    The reference and excluded channels stay. Slopes are one row per channel, from a partial aggregate.
    """

    keeps_shape = True

    def __init__(self, reference_channel: str, excluded_channels: Sequence[str] = (), channel_dim: str = "channel", **kw: Any):
        super().__init__(**kw)
        self.reference_channel, self.excluded_channels, self.channel_dim = reference_channel, excluded_channels, channel_dim

    def _transform(self, frame: LabeledFrame) -> LabeledFrame:
        dim, rest = self.channel_dim, frame.others(self.channel_dim)
        is_reference = F.col(dim) == F.lit(self.reference_channel)
        beside = F.max(F.when(is_reference, F.col(VALUE))).over(Window.partitionBy(*rest))
        paired = frame.cells.withColumn("_ref", beside)
        fits = paired.groupBy(dim).agg(F.regr_slope(VALUE, "_ref").alias("_slope"), F.regr_intercept(VALUE, "_ref").alias("_base"))
        touched = ~is_reference & signal_channels(dim, self.excluded_channels)
        residual = F.col(VALUE) - (F.col("_base") + F.col("_slope") * F.col("_ref"))
        return frame.with_cells(paired.join(fits, dim).withColumn(VALUE, F.when(touched, residual).otherwise(F.col(VALUE))))
