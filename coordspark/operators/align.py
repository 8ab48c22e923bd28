"""Domain alignment: groups of samples mapped onto a target group or into a common space.

Every map is affine, fitted from per-group moments or class means (one pass, small matrices on the driver),
except the kernel ones, which keep their class means or a sampled training matrix. Rows keep their place.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coordspark.frame import VALUE, LabeledFrame
from coordspark.operators.base import Transform, TransformError
from coordspark.operators.linear import Moments, eigen, moments
from coordspark.operators.select import by_conditions


def power(matrix: np.ndarray, exponent: float) -> np.ndarray:
    """Of a symmetric positive matrix."""
    values, vectors = np.linalg.eigh((matrix + matrix.T) / 2)
    return (vectors * np.maximum(values, 1e-300) ** exponent) @ vectors.T


class Affine:
    """``(x - origin) @ matrix + target``."""

    def __init__(self, origin: np.ndarray, matrix: np.ndarray, target: np.ndarray | float = 0.0):
        self.origin, self.matrix, self.target = origin, matrix, target

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (x - self.origin) @ self.matrix + self.target


class Groups:
    """What an aligner learns from: each group's moments and, if there is a target, its class means in order."""

    def __init__(self, stats: dict[Any, Moments], means: dict[Any, np.ndarray], classes: list):
        self.stats, self.means, self.classes = stats, means, classes

    @classmethod
    def of(cls, dense: DataFrame, group: str, target: str | None) -> Groups:
        if not target:
            return cls({k[0]: m for k, m in moments(dense, [group]).items()}, {}, [])
        each = moments(dense, [group, target])
        stats: dict[Any, Moments] = {}
        for (g, _), m in each.items():
            stats[g] = stats[g] + m if g in stats else m
        common = [c for c in sorted({c for _, c in each if c is not None}) if all((g, c) in each for g in stats)]
        if not common:
            raise TransformError("no class occurs in every group")
        return cls(stats, {g: np.array([each[g, c].mean for c in common]) for g in stats}, common)


class _Aligner(Transform):
    """``target_group`` set: each other group is mapped onto it and it stays; else all go to a common space."""

    stateful = True
    needs_target = False
    pairs_only = False

    def __init__(self, group_coord: str = "session", target_group: Any = None, target_coord: str | None = None, sample_dim: str = "trial", adapt_sel: Mapping | None = None, **kw: Any):
        super().__init__(**kw)
        self.group_coord, self.target_group, self.target_coord = group_coord, target_group, target_coord
        self.sample_dim, self.adapt_sel = sample_dim, adapt_sel
        if self.needs_target and not target_coord:
            raise ValueError(f"{type(self).__name__} needs target_coord")

    def _fit(self, frame: LabeledFrame) -> None:
        used = by_conditions(frame, self.adapt_sel) if self.adapt_sel else frame
        self.grid = frame.grid(*frame.others(self.sample_dim))
        found = Groups.of(used.dense(self.sample_dim, grid=self.grid), self.group_coord, self.target_coord if self.needs_target else None)
        names = sorted(found.stats)
        if self.target_group is not None and self.target_group not in names:
            raise TransformError(f"no group {self.target_group!r} among {names}")
        if self.target_group is None and len(names) < 2:
            raise TransformError("a common space needs two groups at least")
        if self.pairs_only and len(names) != 2:
            raise TransformError(f"{type(self).__name__} needs exactly two groups, not {len(names)}")
        self.maps = self._maps(found, names)

    def _maps(self, found: Groups, names: list) -> dict[Any, Any]:
        return {g: (None if g == self.target_group else self._onto(found, g, self.target_group)) for g in names}

    def _onto(self, found: Groups, source: Any, target: Any) -> Affine:
        raise NotImplementedError

    def _transform(self, frame: LabeledFrame) -> LabeledFrame:
        maps, group, sample = self.maps, self.group_coord, self.sample_dim
        rest = frame.others(sample)
        coords = dict.fromkeys(frame.coords_of(sample), sample)
        if len(rest) != 1:
            raise TransformError("alignment takes (sample, feature) frames")

        @F.pandas_udf("array<double>")
        def mapped(xs: pd.Series, gs: pd.Series) -> pd.Series:
            out: list = [None] * len(xs)
            for g in gs.unique():
                if g not in maps:
                    raise TransformError(f"group {g!r} was not fitted")
                at = np.flatnonzero((gs == g).to_numpy())
                x = np.array([xs.iloc[i] for i in at], float)
                for i, y in zip(at, x if maps[g] is None else maps[g](x), strict=True):
                    out[i] = y
            return pd.Series(out, dtype=object)

        dense = frame.dense(sample, grid=self.grid).withColumn("_out", mapped.asNondeterministic()("features", group))
        out = dense.select(sample, *coords, F.posexplode("_out").alias(rest[0], VALUE))
        out = out.withColumn(VALUE, F.nullif(VALUE, F.lit(float("nan"))))  # of samples that lack a cell
        return frame.with_cells(out, (sample, rest[0]), coords)


class NoAlignment(_Aligner):
    """Every group as it is."""

    def _maps(self, found: Groups, names: list) -> dict[Any, Any]:
        return dict.fromkeys(names)


class Procrustes(_Aligner):
    """Rotation (and scale) that takes a group's centred class means nearest to the target's."""

    needs_target = True

    def __init__(self, group_coord: str = "session", target_group: Any = None, target_coord: str | None = None, sample_dim: str = "trial", scaling: bool = True, adapt_sel: Mapping | None = None, **kw: Any):
        super().__init__(group_coord, target_group, target_coord, sample_dim, adapt_sel, **kw)
        self.scaling = scaling

    def _maps(self, found: Groups, names: list) -> dict[Any, Any]:
        target = names[0] if self.target_group is None else self.target_group
        return {g: (None if g == target else self._onto(found, g, target)) for g in names}

    def _onto(self, found: Groups, source: Any, target: Any) -> Affine:
        cs, ct = found.stats[source].mean, found.stats[target].mean
        s, t = found.means[source] - cs, found.means[target] - ct
        u, _, v = np.linalg.svd(s.T @ t)
        turned = s @ (u @ v)
        scale = (turned * t).sum() / max((turned**2).sum(), 1e-300) if self.scaling else 1.0
        return Affine(cs, u @ v * scale, ct)


class Coral(_Aligner):
    """The source's covariance whitened and recoloured as the target's."""

    def __init__(self, group_coord: str = "session", target_group: Any = None, sample_dim: str = "trial", reg: float = 1e-5, adapt_sel: Mapping | None = None, **kw: Any):
        super().__init__(group_coord, target_group, None, sample_dim, adapt_sel, **kw)
        self.reg = reg

    def _maps(self, found: Groups, names: list) -> dict[Any, Any]:
        if self.target_group is not None:
            return super()._maps(found, names)
        total = sum((m for g, m in found.stats.items() if g != names[0]), found.stats[names[0]])
        return {g: self._between(found.stats[g], total) for g in names}

    def _onto(self, found: Groups, source: Any, target: Any) -> Affine:
        return self._between(found.stats[source], found.stats[target])

    def _between(self, s: Moments, t: Moments) -> Affine:
        eye = np.eye(len(s.total)) * self.reg
        return Affine(s.mean, power(s.covariance() + eye, -0.5) @ power(t.covariance() + eye, 0.5), t.mean)


class SubspaceAlignment(_Aligner):
    """``Ps Pt'``: the source's principal subspace onto the target's (without the factor ``Ps' Pt``)."""

    def __init__(self, group_coord: str = "session", target_group: Any = None, sample_dim: str = "trial", n_components: int = 10, adapt_sel: Mapping | None = None, **kw: Any):
        super().__init__(group_coord, target_group, None, sample_dim, adapt_sel, **kw)
        self.n_components = n_components

    def _maps(self, found: Groups, names: list) -> dict[Any, Any]:
        target = names[0] if self.target_group is None else self.target_group
        return {g: (None if g == target else self._onto(found, g, target)) for g in names}

    def _onto(self, found: Groups, source: Any, target: Any) -> Affine:
        s, t = found.stats[source], found.stats[target]
        k = min(self.n_components, len(s.total))
        ps, pt = (eigen(m.covariance())[1][:, :k] for m in (s, t))
        return Affine(s.mean, ps @ pt.T, t.mean)


class _Joint(_Aligner):
    needs_target = True

    def __init__(self, group_coord: str = "session", target_coord: str | None = None, sample_dim: str = "trial", n_components: int = 10, reg: float = 1e-5, adapt_sel: Mapping | None = None, **kw: Any):
        super().__init__(group_coord, None, target_coord, sample_dim, adapt_sel, **kw)
        self.n_components, self.reg = n_components, reg


class CCA(_Joint):
    """Canonical directions of two groups' class means, after scaling by their mean and deviation."""

    pairs_only = True

    def _maps(self, found: Groups, names: list) -> dict[Any, Any]:
        scaled, scale = [], []
        for g in names:
            m, sd = found.means[g].mean(axis=0), found.means[g].std(axis=0, ddof=1)
            scale.append((m, np.where(sd > 0, sd, 1.0)))
            scaled.append((found.means[g] - m) / scale[-1][1])
        n = len(found.classes) - 1
        eye = self.reg * np.eye(scaled[0].shape[1])
        wx, wy = (power(x.T @ x / n + eye, -0.5) for x in scaled)
        u, _, v = np.linalg.svd(wx @ (scaled[0].T @ scaled[1] / n) @ wy)
        k = min(self.n_components, n, len(u))
        return {g: Affine(m, w[:, :k] / sd[:, None]) for g, (m, sd), w in zip(names, scale, (wx @ u, wy @ v.T), strict=True)}


class MCCA(_Joint):
    """Common directions of several groups: the generalised eigenproblem of all against own covariances."""

    def _maps(self, found: Groups, names: list) -> dict[Any, Any]:
        centred = [found.means[g] - found.means[g].mean(axis=0) for g in names]
        p, stacked = centred[0].shape[1], np.hstack(centred)
        total, own = stacked.T @ stacked, np.zeros((p * len(names), p * len(names)))
        for i, x in enumerate(centred):
            own[i * p : (i + 1) * p, i * p : (i + 1) * p] = x.T @ x + self.reg * np.eye(p)
        half = np.linalg.inv(np.linalg.cholesky(own))
        _, vectors = eigen(half @ total @ half.T)
        w = half.T @ vectors[:, : min(self.n_components, p, len(found.classes) - 1)]
        return {g: Affine(found.means[g].mean(axis=0), w[i * p : (i + 1) * p]) for i, g in enumerate(names)}


class GCCA(_Joint):
    """The common space nearest to all groups' column spaces (sum of their projections)."""

    def _maps(self, found: Groups, names: list) -> dict[Any, Any]:
        centred = [found.means[g] - found.means[g].mean(axis=0) for g in names]
        p = centred[0].shape[1]
        inner = [np.linalg.inv(x.T @ x + self.reg * np.eye(p)) @ x.T for x in centred]
        _, shared = eigen(sum(x @ i for x, i in zip(centred, inner, strict=True)))
        k = min(self.n_components, len(found.classes) - 1, p)
        return {g: Affine(found.means[g].mean(axis=0), i @ shared[:, :k]) for g, i in zip(names, inner, strict=True)}


def kernel_matrix(x: np.ndarray, y: np.ndarray, kind: str, gamma: float | None = None, degree: int = 3, coef0: float = 1.0) -> np.ndarray:
    gamma = 1 / x.shape[1] if gamma is None else gamma
    if kind == "linear":
        return x @ y.T
    if kind == "poly":
        return (gamma * x @ y.T + coef0) ** degree
    if kind == "rbf":
        return np.exp(-gamma * np.maximum((x**2).sum(1)[:, None] + (y**2).sum(1)[None] - 2 * x @ y.T, 0))
    if kind == "cosine":
        unit = lambda a: a / np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-300)
        return unit(x) @ unit(y).T
    raise ValueError(f"unknown kernel {kind!r}")


class KernelMap:
    """Centred kernel values against kept rows, times coefficients."""

    def __init__(self, kept: np.ndarray, coef: np.ndarray, kernel: dict):
        self.kept, self.coef, self.kernel = kept, coef, kernel
        own = kernel_matrix(kept, kept, **kernel)
        self.column, self.total = own.mean(axis=0), own.mean()

    def __call__(self, x: np.ndarray) -> np.ndarray:
        k = kernel_matrix(x, self.kept, **self.kernel)
        return (k - k.mean(axis=1, keepdims=True) - self.column + self.total) @ self.coef


class KCCA(_Joint):
    """CCA of two groups' class means in kernel space; new rows are centred against the kept means."""

    pairs_only = True

    def __init__(self, group_coord: str = "session", target_coord: str | None = None, sample_dim: str = "trial", n_components: int = 10, reg: float = 1e-3, kernel: str = "linear", gamma: float | None = None, degree: int = 3, coef0: float = 1.0, adapt_sel: Mapping | None = None, **kw: Any):
        super().__init__(group_coord, target_coord, sample_dim, n_components, reg, adapt_sel, **kw)
        self.kernel, self.gamma, self.degree, self.coef0 = kernel, gamma, degree, coef0

    def _maps(self, found: Groups, names: list) -> dict[Any, Any]:
        kernel = {"kind": self.kernel, "gamma": self.gamma, "degree": self.degree, "coef0": self.coef0}
        n = len(found.classes)
        centre = np.eye(n) - 1 / n
        own = [centre @ kernel_matrix(found.means[g], found.means[g], **kernel) @ centre for g in names]
        inverse = [np.linalg.inv(k + self.reg * max(np.trace(k) / n, 1e-300) * np.eye(n)) for k in own]
        u, _, v = np.linalg.svd(inverse[0] @ own[0] @ own[1] @ inverse[1])
        k = min(self.n_components, n - 1)
        return {g: KernelMap(found.means[g], i @ w[:, :k], kernel) for g, i, w in zip(names, inverse, (u, v.T), strict=True)}


class JDA(_Joint):
    """Directions that keep variance while two groups' marginal and class-wise means meet (linear kernel).

    The first two groups in order define the map; others go through the second's. From moments alone.
    """

    def __init__(self, group_coord: str = "session", target_coord: str | None = None, sample_dim: str = "trial", n_components: int = 50, mu: float = 0.5, reg: float = 1e-3, adapt_sel: Mapping | None = None, **kw: Any):
        super().__init__(group_coord, target_coord, sample_dim, n_components, reg, adapt_sel, **kw)
        self.mu = mu

    def _maps(self, found: Groups, names: list) -> dict[Any, Any]:
        a, b = names[:2]
        whole = found.stats[a] + found.stats[b]
        apart = found.stats[a].mean - found.stats[b].mean
        classes = found.means[a] - found.means[b]
        mismatch = (1 - self.mu) * np.outer(apart, apart) + self.mu * classes.T @ classes / len(classes)
        p = len(apart)
        half = np.linalg.inv(np.linalg.cholesky(mismatch + self.reg * np.eye(p)))
        _, vectors = eigen(half @ whole.covariance() @ half.T)
        w = half.T @ vectors[:, : min(self.n_components, p)]
        return {g: Affine(whole.mean, w / np.linalg.norm(w, axis=0)) for g in names}
