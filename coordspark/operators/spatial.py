"""Operators on a grid of electrodes.

A layout places numeric channels on (row, col); auxiliary channels are left alone. Neighbourhoods are small
tables of (channel, neighbour, weight), so convolution is a broadcast join and a sum; their size is the grid's.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coordspark.frame import VALUE, LabeledFrame
from coordspark.operators.base import Transform
from coordspark.operators.linear import kept_components, eigen

Layout = Mapping[Any, tuple[int, int]]


def square_layout(rows: int, cols: int) -> dict[int, tuple[int, int]]:
    """Channels 0, 1, ... row by row."""
    return {r * cols + c: (r, c) for r in range(rows) for c in range(cols)}


def reflected(i: int, n: int) -> int:
    """An index beyond the border, mirrored about the border's edge."""
    i %= 2 * n
    return i if i < n else 2 * n - 1 - i


def laplacian_kernel(radius: float = 1, weighted: bool = False, scaling: float = 1.0) -> dict[tuple[int, int], float]:
    """Neighbours within a Euclidean radius, equal or by 1 / distance, adding to ``scaling``; centre -1."""
    if radius < 1:
        raise ValueError("the radius is at least 1")
    reach = int(radius)
    near = {(a, b): (1 / math.hypot(a, b) if weighted else 1.0) for a in range(-reach, reach + 1) for b in range(-reach, reach + 1) if 0 < math.hypot(a, b) <= radius}
    total = sum(near.values())
    return {k: v / total * scaling for k, v in near.items()} | {(0, 0): -1.0}


def gaussian_kernel(sigma: float, truncate: float = 4.0) -> dict[int, float]:
    reach = int(truncate * sigma + 0.5)
    raw = {i: math.exp(-0.5 * (i / sigma) ** 2) for i in range(-reach, reach + 1)}
    return {i: w / sum(raw.values()) for i, w in raw.items()}


class _Grid(Transform):
    def __init__(self, grid_layout: Layout, handle_nans: bool = True, channel_dim: str = "channel", **kw: Any):
        super().__init__(**kw)
        self.grid_layout, self.handle_nans, self.channel_dim = dict(grid_layout), handle_nans, channel_dim
        self.n_rows = 1 + max(r for r, _ in self.grid_layout.values())
        self.n_cols = 1 + max(c for _, c in self.grid_layout.values())
        self.at = {p: ch for ch, p in self.grid_layout.items()}

    def on_grid(self) -> Column:
        return F.col(self.channel_dim).isin(list(self.grid_layout))

    def pairs(self, frame: LabeledFrame, kernel: Mapping[tuple[int, int], float]) -> DataFrame:
        """``(channel, other, weight)``: the kernel at each channel, borders mirrored."""
        summed: dict[tuple, float] = {}
        for ch, (r, c) in self.grid_layout.items():
            for (a, b), w in kernel.items():
                other = self.at.get((reflected(r + a, self.n_rows), reflected(c + b, self.n_cols)))
                if other is not None:
                    summed[ch, other] = summed.get((ch, other), 0.0) + w
        return self.table(frame, [(*k, w) for k, w in summed.items()], "weight double")

    def table(self, frame: LabeledFrame, rows: list[tuple], more: str = "") -> DataFrame:
        kind = frame.cells.schema[self.channel_dim].dataType.simpleString()
        return F.broadcast(frame.cells.sparkSession.createDataFrame(rows, f"`{self.channel_dim}` {kind}, other {kind}" + (f", {more}" if more else "")))

    def neighbours(self, frame: LabeledFrame) -> DataFrame:
        rows = [(ch, self.at[r + a, c + b]) for ch, (r, c) in self.grid_layout.items() for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (r + a, c + b) in self.at]
        return self.table(frame, rows)

    def filled(self, frame: LabeledFrame) -> LabeledFrame:
        """Missing grid cells get the mean of their valid 3 x 3 neighbours, others stay; all-missing stay null."""
        keys, dim = frame.others(self.channel_dim), self.channel_dim
        have = frame.where(self.on_grid() & F.col(VALUE).isNotNull())
        around = have.cells.select(*keys, F.col(dim).alias("other"), F.col(VALUE).alias("_v")).join(self.neighbours(frame), "other").groupBy(*keys, dim).agg(F.avg("_v").alias("_near"))
        joined = frame.cells.join(around, [*keys, dim], "left")
        return frame.with_cells(joined.withColumn(VALUE, F.coalesce(VALUE, F.when(self.on_grid(), F.col("_near")))))

    def convolved(self, frame: LabeledFrame, kernel: Mapping[tuple[int, int], float]) -> DataFrame:
        keys = frame.others(self.channel_dim)
        source = frame.cells.select(*keys, F.col(self.channel_dim).alias("other"), F.col(VALUE).alias("_v"))
        met = source.join(self.pairs(frame, kernel), "other")
        missing = F.max(F.col("_v").isNull().cast("int"))
        return met.groupBy(*keys, self.channel_dim).agg(F.when(missing == 0, F.sum(F.col("weight") * F.col("_v"))).alias("_out"))

    def flat(self, frame: LabeledFrame, cells: DataFrame) -> LabeledFrame:
        """Cells ``(other dims, feature, value)`` in place of the channel dimension."""
        dims = tuple("feature" if d == self.channel_dim else d for d in frame.dims)
        coords = {c: d for c, d in frame.coords.items() if d != self.channel_dim}
        return frame.with_cells(cells, dims, coords)


class FillNeighbours(_Grid):
    """Missing grid cells from their neighbours."""

    def _transform(self, frame: LabeledFrame) -> LabeledFrame:
        return self.filled(frame)


class LaplacianCSD(_Grid):
    """Minus the Laplacian of the grid; auxiliary channels are unchanged."""

    def __init__(self, grid_layout: Layout, radius: float = 1, weighted: bool = False, scaling: float = 1.0, handle_nans: bool = True, channel_dim: str = "channel", **kw: Any):
        super().__init__(grid_layout, handle_nans, channel_dim, **kw)
        self.radius, self.weighted, self.scaling = radius, weighted, scaling

    def _transform(self, frame: LabeledFrame) -> LabeledFrame:
        full = self.filled(frame) if self.handle_nans else frame
        out = self.convolved(full, laplacian_kernel(self.radius, self.weighted, self.scaling))
        joined = frame.cells.join(out, [*frame.others(self.channel_dim), self.channel_dim], "left")
        return frame.with_cells(joined.withColumn(VALUE, F.when(self.on_grid(), -F.col("_out")).otherwise(F.col(VALUE))))


class _Pyramid(_Grid):
    def __init__(self, grid_layout: Layout, levels: int = 1, keep_only_top: bool = True, handle_nans: bool = True, channel_dim: str = "channel", **kw: Any):
        super().__init__(grid_layout, handle_nans, channel_dim, **kw)
        if levels < 1:
            raise ValueError("a pyramid has at least one level")
        self.levels, self.keep_only_top = levels, keep_only_top

    def output_dims(self, dims: tuple[str, ...]) -> tuple[str, ...]:
        return tuple("feature" if d == self.channel_dim else d for d in dims)

    def _level(self, cells: DataFrame, keys: list[str], rows: int, cols: int) -> tuple[DataFrame, int, int]:
        raise NotImplementedError

    def _transform(self, frame: LabeledFrame) -> LabeledFrame:
        full = self.filled(frame) if self.handle_nans else frame
        keys = [*frame.others(self.channel_dim), *[c for c, d in frame.coords.items() if d != self.channel_dim]]
        spark, kind = frame.cells.sparkSession, frame.cells.schema[self.channel_dim].dataType.simpleString()
        layout = F.broadcast(spark.createDataFrame([(ch, r, c) for ch, (r, c) in self.grid_layout.items()], f"`{self.channel_dim}` {kind}, _r int, _c int"))
        cells = full.cells.join(layout, self.channel_dim).select(*keys, "_r", "_c", VALUE)
        rows, cols, start, parts = self.n_rows, self.n_cols, 0, []
        for _ in range(self.levels):
            cells, rows, cols = self._level(cells, keys, rows, cols)
            if rows < 1 or cols < 1:
                raise ValueError("the grid is too small for so many levels")
            offset = 0 if self.keep_only_top else start
            parts.append(cells.select(*keys, (F.lit(offset) + F.col("_r") * cols + F.col("_c")).cast("int").alias("feature"), VALUE))
            start += rows * cols
        out = parts[-1]
        if not self.keep_only_top:
            for p in parts[:-1]:
                out = out.unionByName(p)
        return self.flat(frame, out)


class WindowMeanPyramid(_Pyramid):
    """Means of 2 x 2 windows, level upon level; each level is one row and column smaller."""

    def _level(self, cells: DataFrame, keys: list[str], rows: int, cols: int) -> tuple[DataFrame, int, int]:
        corners = F.explode(F.array(*[F.struct((F.col("_r") - a).alias("r"), (F.col("_c") - b).alias("c")) for a in (0, 1) for b in (0, 1)])).alias("_w")
        spread = cells.select(*keys, corners, VALUE).select(*keys, F.col("_w.r").alias("_r"), F.col("_w.c").alias("_c"), VALUE)
        inside = F.col("_r").between(0, rows - 2) & F.col("_c").between(0, cols - 2)
        return spread.where(inside).groupBy(*keys, "_r", "_c").agg(F.avg(VALUE).alias(VALUE)), rows - 1, cols - 1


class GaussianPyramid(_Pyramid):
    """Gaussian smoothing over rows and columns (borders mirrored), then every second row and column."""

    def __init__(self, grid_layout: Layout, levels: int = 1, sigma: float = 1.0, keep_only_top: bool = True, handle_nans: bool = True, channel_dim: str = "channel", **kw: Any):
        super().__init__(grid_layout, levels, keep_only_top, handle_nans, channel_dim, **kw)
        self.sigma = sigma

    def _level(self, cells: DataFrame, keys: list[str], rows: int, cols: int) -> tuple[DataFrame, int, int]:
        kernel, spark = gaussian_kernel(self.sigma), cells.sparkSession
        for axis, n in (("_r", rows), ("_c", cols)):
            summed: dict[tuple[int, int], float] = {}
            for i in range(0, n, 2):  # only what is kept
                for k, w in kernel.items():
                    j = reflected(i + k, n)
                    summed[j, i // 2] = summed.get((j, i // 2), 0.0) + w
            pairs = F.broadcast(spark.createDataFrame([(j, i, w) for (j, i), w in summed.items()], f"{axis} int, _to int, _w double"))
            rest = [*keys, "_c" if axis == "_r" else "_r"]
            cells = cells.join(pairs, axis).groupBy(*rest, "_to").agg(F.sum(F.col("_w") * F.col(VALUE)).alias(VALUE)).withColumnRenamed("_to", axis)
        return cells, (rows + 1) // 2, (cols + 1) // 2


class LocalZCA(_Grid):
    """Each electrode whitened within its neighbourhood: the centre row of the neighbourhood's ZCA matrix.

    An electrode with a single neighbour (itself) is left as it is.
    """

    stateful = True

    def __init__(self, grid_layout: Layout, radius: float = 1, epsilon: float = 1e-6, whitening_strength: float = 1.0, n_components: float | None = None, pca_frac_to_keep: float | None = 1.0, center_data: bool = True, channel_dim: str = "channel", **kw: Any):
        super().__init__(grid_layout, True, channel_dim, **kw)
        self.radius, self.epsilon, self.whitening_strength = radius, epsilon, whitening_strength
        self.n_components, self.pca_frac_to_keep, self.center_data = n_components, pca_frac_to_keep, center_data

    def _near(self) -> dict[Any, list]:
        return {ch: [o for o, (r2, c2) in self.grid_layout.items() if math.hypot(r - r2, c - c2) <= self.radius] for ch, (r, c) in self.grid_layout.items()}

    def _fit(self, frame: LabeledFrame) -> None:
        keys, dim = frame.others(self.channel_dim), self.channel_dim
        a = frame.where(self.on_grid()).cells.select(*keys, F.col(dim).alias("a"), F.col(VALUE).alias("x"))
        b = a.select(*keys, F.col("a").alias("b"), F.col("x").alias("y"))
        moment = F.covar_samp("x", "y") if self.center_data else F.avg(F.col("x") * F.col("y"))
        cov = {(r["a"], r["b"]): r["m"] for r in a.join(b, keys).where(F.col("a") <= F.col("b")).groupBy("a", "b").agg(moment.alias("m")).collect()}  # a pair of electrodes each
        self.means = {r["a"]: r["m"] for r in a.groupBy("a").agg(F.avg("x").alias("m")).collect()} if self.center_data else dict.fromkeys(self.grid_layout, 0.0)
        self.filters: dict[tuple, float] = {}
        for ch, near in self._near().items():
            if len(near) < 2:
                self.filters[ch, ch] = 1.0
                self.means[ch] = 0.0
                continue
            matrix = np.array([[cov[min(p, q), max(p, q)] for q in near] for p in near])
            values, vectors = eigen(matrix)
            k = kept_components(values, self.n_components, None if self.n_components is not None else self.pca_frac_to_keep)
            scale = np.where(np.arange(len(values)) < k, (values + self.epsilon) ** (-self.whitening_strength / 2), 0.0)
            row = ((vectors * scale) @ vectors.T)[near.index(ch)]
            self.filters |= {(ch, o): float(w) for o, w in zip(near, row, strict=True)}

    def _transform(self, frame: LabeledFrame) -> LabeledFrame:
        keys, dim = frame.others(self.channel_dim), self.channel_dim
        weights = self.table(frame, [(ch, o, w, float(self.means[o])) for (ch, o), w in self.filters.items()], "weight double, mean double")
        source = frame.cells.select(*keys, F.col(dim).alias("other"), F.col(VALUE).alias("_v"))
        out = source.join(weights, "other").groupBy(*keys, dim).agg(F.sum(F.col("weight") * (F.col("_v") - F.col("mean"))).alias("_out"))
        joined = frame.cells.join(out, [*keys, dim], "left")
        return frame.with_cells(joined.withColumn(VALUE, F.when(self.on_grid(), F.col("_out")).otherwise(F.col(VALUE))))
