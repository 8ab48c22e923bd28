"""Sample weights as a coordinate of the sample dimension."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import replace
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coordspark.frame import LabeledFrame
from coordspark.operators.base import Transform

WEIGHT = "sample_weight"


class SampleWeight(Transform):
    """A weight from a coordinate: a map with a default, a function of the column, or the default alone."""

    keeps_shape = False

    def __init__(self, coord_name: str | None = None, weight_map: Mapping | None = None, weight_func: Callable[[Column], Column] | None = None, default_weight: float = 1.0, target_coord: str = WEIGHT, sample_dim: str = "trial", **kw: Any):
        super().__init__(**kw)
        if weight_map and weight_func:
            raise ValueError("give weight_map or weight_func, not both")
        self.coord_name, self.weight_map, self.weight_func = coord_name, weight_map, weight_func
        self.default_weight, self.target_coord, self.sample_dim, self.enabled = default_weight, target_coord, sample_dim, True

    def prepare_for_inference(self) -> SampleWeight:
        self.enabled = False
        return self

    def _transform(self, frame: LabeledFrame) -> LabeledFrame:
        if not self.enabled:
            return frame
        weight = F.lit(float(self.default_weight))
        if self.weight_func:
            weight = self.weight_func(F.col(self.coord_name))
        elif self.weight_map:
            entries = F.create_map(*[F.lit(x) for k, v in self.weight_map.items() for x in (k, float(v))])
            weight = F.coalesce(F.try_element_at(entries, F.col(self.coord_name)), weight)
        return replace(frame, cells=frame.cells.withColumn(self.target_coord, weight), coords={**frame.coords, self.target_coord: self.sample_dim})


class BalanceClassWeight(Transform):
    """Weights that even out classes, within domains if asked.

    Without domains a sample weighs 1 / n(class). With domains, a domain's weight (equal by default) is
    divided by its number of classes (``normalize_domain_totals``) or of samples, then by n(domain, class).
    ``weight_normalize`` divides by the ``mean`` or the ``sum``.
    """

    def __init__(self, class_coord: str, balance_domains: bool = False, domain_coord: str | None = None, domain_weights: Mapping | None = None, normalize_domain_totals: bool = False, weight_normalize: str | None = None, target_coord: str = WEIGHT, sample_dim: str = "trial", **kw: Any):
        super().__init__(**kw)
        if balance_domains and not domain_coord:
            raise ValueError("balance_domains needs domain_coord")
        if weight_normalize not in (None, "mean", "sum"):
            raise ValueError("weight_normalize is None, mean or sum")
        self.class_coord, self.balance_domains, self.domain_coord, self.domain_weights = class_coord, balance_domains, domain_coord, domain_weights
        self.normalize_domain_totals, self.weight_normalize, self.target_coord, self.sample_dim = normalize_domain_totals, weight_normalize, target_coord, sample_dim

    def weights(self, frame: LabeledFrame) -> DataFrame:
        """``(class[, domain], weight)``: a row for each combination, from counts alone."""
        keys = [self.class_coord, *([self.domain_coord] if self.balance_domains else [])]
        counts = frame.cells.select(self.sample_dim, *keys).distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
        if counts.where(" or ".join(f"`{k}` is null" for k in keys)).limit(1).count():
            raise ValueError("a sample lacks its class or domain")
        if not self.balance_domains:
            weighted = counts.withColumn("w", 1.0 / F.col("n"))
        else:
            per = Window.partitionBy(self.domain_coord)
            if self.domain_weights:
                entries = F.create_map(*[F.lit(x) for k, v in self.domain_weights.items() for x in (k, float(v))])
                domain = F.try_element_at(entries, F.col(self.domain_coord))
            else:
                domain = 1.0 / F.lit(counts.select(self.domain_coord).distinct().count())
            share = F.count(F.lit(1)).over(per) if self.normalize_domain_totals else F.sum("n").over(per)
            weighted = counts.withColumn("w", domain / share / F.col("n"))
        if self.weight_normalize:
            total, n = weighted.agg(F.sum(F.col("w") * F.col("n")), F.sum("n")).first()
            weighted = weighted.withColumn("w", F.col("w") / F.lit(total / n if self.weight_normalize == "mean" else total))
        return weighted.select(*keys, F.col("w").alias(self.target_coord))

    def _transform(self, frame: LabeledFrame) -> LabeledFrame:
        keys = [self.class_coord, *([self.domain_coord] if self.balance_domains else [])]
        cells = frame.cells.drop(self.target_coord).join(self.weights(frame), keys)
        return replace(frame, cells=cells, coords={**frame.coords, self.target_coord: self.sample_dim})


def sample_weights(frame: LabeledFrame, sample_dim: str, coord: str = WEIGHT) -> DataFrame | None:
    """``(sample, weight)``, None if there is no such coordinate; a missing weight is an error."""
    if coord not in frame.coords:
        return None
    if frame.coords[coord] != sample_dim:
        raise ValueError(f"{coord} is not on {sample_dim}")
    weights = frame.cells.select(sample_dim, coord).distinct()
    if weights.where(F.col(coord).isNull() | F.isnan(coord)).limit(1).count():
        raise ValueError(f"{coord} lacks values")
    return weights
