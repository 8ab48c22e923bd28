"""Projections from second moments: distributed sums, p x p algebra on the driver, scoring by a broadcast matrix.

Moments come from one pass over dense rows: each Arrow batch adds its Gram matrix, so what reaches the driver
is one p x p matrix per group and task, however many samples there are. ``p`` is the number of features
(channels, not samples) and is checked against ``MAX_FEATURES``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coordspark.frame import VALUE, LabeledFrame
from coordspark.operators.base import Transform, TransformError

MAX_FEATURES = 4096


class Moments:
    """Number of rows, sum and Gram matrix of feature vectors; they add up."""

    def __init__(self, n: float, total: np.ndarray, gram: np.ndarray):
        self.n, self.total, self.gram = n, total, gram

    def __add__(self, other: Moments) -> Moments:
        return Moments(self.n + other.n, self.total + other.total, self.gram + other.gram)

    def __sub__(self, other: Moments) -> Moments:
        return Moments(self.n - other.n, self.total - other.total, self.gram - other.gram)

    @property
    def mean(self) -> np.ndarray:
        return self.total / self.n

    def covariance(self, center: bool = True, ddof: int = 1) -> np.ndarray:
        """Of the centred data over n - ddof, or the second moment over n."""
        if not center:
            return self.gram / self.n
        return (self.gram - self.n * np.outer(self.mean, self.mean)) / max(self.n - ddof, 1)


def moments(dense: DataFrame, by: Sequence[str] = (), features: str = "features") -> dict[tuple, Moments]:
    """Moments of the rows of each combination of ``by`` (few: classes, groups, folds). Rows with a null are left out.

    Tasks give their sums out by row of the Gram matrix; these add up in the cluster, and one matrix for each
    combination reaches the driver, however many tasks there are.
    """
    keys = list(by)

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, Moments] = {}
        for f in frames:
            for key, g in f.groupby(keys, dropna=False) if keys else [((), f)]:
                x = np.array(g["x"].tolist(), float)
                if x.shape[1] > MAX_FEATURES:
                    raise ValueError(f"{x.shape[1]} features; moments are made for up to {MAX_FEATURES}")
                own = Moments(len(x), x.sum(axis=0), x.T @ x)
                held[key] = held[key] + own if key in held else own
        for k, m in held.items():
            of_key = pd.DataFrame([dict(zip(keys, k, strict=True))] * len(m.total)) if keys else pd.DataFrame(index=range(len(m.total)))
            yield of_key.assign(row=np.arange(len(m.total)), n=float(m.n), total=m.total, gram=list(m.gram))

    rows = dense.where(F.col(features).isNotNull() & ~F.exists(features, lambda x: x.isNull()))
    rows = rows.select(*keys, F.col(features).alias("x"))
    kinds = [f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys]
    parts = rows.mapInPandas(add, ", ".join([*kinds, "row long", "n double", "total double", "gram array<double>"]))

    def sums(g: pd.DataFrame) -> pd.DataFrame:
        first = g.iloc[:1][[*keys, "row"]]
        return first.assign(n=g["n"].sum(), total=g["total"].sum(), gram=[np.sum(np.stack(g["gram"]), axis=0)])

    added = parts.groupBy(*keys, "row").applyInPandas(sums, parts.schema)
    held: dict[tuple, dict[int, Any]] = {}
    for r in added.toLocalIterator():
        held.setdefault(tuple(r[k] for k in keys), {})[r["row"]] = r
    found = {}
    for key, of_row in held.items():
        own = [of_row[i] for i in range(len(of_row))]
        found[key] = Moments(own[0]["n"], np.array([r["total"] for r in own]), np.array([r["gram"] for r in own]))
    return found


def apply_matrix(features: str | Column, matrix: np.ndarray, offset: np.ndarray | None = None) -> Column:
    """``(x - offset) @ matrix`` for an array column, in vectorised batches."""
    matrix, offset = np.asarray(matrix, float), None if offset is None else np.asarray(offset, float)

    @F.pandas_udf("array<double>")
    def project(xs: pd.Series) -> pd.Series:
        if not len(xs):
            return pd.Series([], dtype=object)
        x = np.array(xs.tolist(), float)
        return pd.Series(list((x if offset is None else x - offset) @ matrix))

    return project.asNondeterministic()(features)  # so that no later expression takes it in


def eigen(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues from the largest, clamped at zero, and their vectors, each with its largest entry positive."""
    values, vectors = np.linalg.eigh((matrix + matrix.T) / 2)
    order = np.argsort(-values, kind="stable")
    vectors = vectors[:, order]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return np.maximum(values[order], 0.0), vectors * np.where(signs == 0, 1, signs)


def kept_components(values: np.ndarray, n_components: float | None, fraction: float | None) -> int:
    """How many to keep: a count, a share of the variance (a float), or a share of the components."""
    if (n_components is None) == (fraction is None):
        raise ValueError("give exactly one of n_components and pca_frac_to_keep")
    if fraction is not None:
        return math.ceil(len(values) * fraction)
    if isinstance(n_components, float):
        share = np.cumsum(values) / max(values.sum(), 1e-300)
        return int(min(np.searchsorted(share, n_components) + 1, len(values)))
    if not 1 <= n_components <= len(values):
        raise ValueError(f"can't keep {n_components} of {len(values)} components")
    return int(n_components)


class _Projection(Transform):
    """Rows are all dimensions but ``feature_dim``; output labels are 0, 1, ..."""

    stateful = True

    def __init__(self, n_components: float | None = None, pca_frac_to_keep: float | None = None, center_data: bool | str = True, epsilon: float = 1e-6, feature_dim: str = "channel", **kw: Any):
        super().__init__(**kw)
        if center_data not in (True, False, "false_oldstyle"):
            raise ValueError("center_data is True, False or 'false_oldstyle'")
        self.n_components, self.pca_frac_to_keep, self.center_data = n_components, pca_frac_to_keep, center_data
        self.epsilon, self.feature_dim = epsilon, feature_dim
        self.matrix: np.ndarray | None = None

    def rows(self, frame: LabeledFrame) -> DataFrame:
        """An array over the fitted feature labels for each of the other labels."""
        return frame.arrays(frame.others(self.feature_dim), [self.feature_dim], grid=self.grid)

    def _fit(self, frame: LabeledFrame) -> None:
        """Rows that lack a cell are left out."""
        frame.require(self.feature_dim)
        self.grid = frame.grid(self.feature_dim)
        if not (found := moments(self.rows(frame))):
            raise TransformError("no complete row to fit on")
        (m,) = found.values()
        self.mean = m.mean if self.center_data is True else np.zeros_like(m.mean)
        values, vectors = eigen(m.covariance(self.center_data is not False))
        self._learn(values, vectors)

    def _learn(self, values: np.ndarray, vectors: np.ndarray) -> None:
        raise NotImplementedError

    def _labels(self, frame: LabeledFrame) -> list | None:
        """Labels of the output features if they are those of the input."""
        return None

    def _transform(self, frame: LabeledFrame) -> LabeledFrame:
        if self.matrix is None:
            raise TransformError(f"{type(self).__name__} is not fitted")
        keys, dim = frame.others(self.feature_dim), self.feature_dim
        coords = {c: d for c, d in frame.coords.items() if d in keys}
        out = self.rows(frame).select(*keys, *coords, F.posexplode(apply_matrix("features", self.matrix, self.mean)).alias(dim, VALUE))
        out = out.withColumn(VALUE, F.nullif(VALUE, F.lit(float("nan"))))  # of rows that lack a cell
        if (labels := self._labels(frame)) is not None:
            out = out.withColumn(dim, F.get(F.array(*map(F.lit, labels)), F.col(dim)))
        return frame.with_cells(out, frame.dims, coords)


class FeaturePCA(_Projection):
    """Principal components over features; ``whiten`` divides by the root of each variance."""

    def __init__(self, n_components: float | None = None, pca_frac_to_keep: float | None = None, center_data: bool | str = True, whiten: bool = False, feature_dim: str = "channel", epsilon: float = 1e-6, **kw: Any):
        super().__init__(n_components, pca_frac_to_keep, center_data, epsilon, feature_dim, **kw)
        self.whiten = whiten

    def _learn(self, values: np.ndarray, vectors: np.ndarray) -> None:
        k = kept_components(values, self.n_components, self.pca_frac_to_keep)
        self.explained_variance, self.explained_variance_ratio = values[:k], values[:k] / max(values.sum(), 1e-300)
        self.components = vectors[:, :k].T
        self.matrix = vectors[:, :k] / np.sqrt(values[:k] + self.epsilon) if self.whiten else vectors[:, :k]


class GlobalZCA(_Projection):
    """Whitening ``U diag((l + eps)^(-s/2)) U'``; dropped components get no weight.

    ``keep_in_pc_space`` leaves out the turn back. Features keep their labels unless it does.
    """

    def __init__(self, n_components: float | None = None, pca_frac_to_keep: float | None = None, center_data: bool | str = True, epsilon: float = 1e-6, whitening_strength: float = 1.0, keep_in_pc_space: bool = False, feature_dim: str = "channel", **kw: Any):
        super().__init__(n_components, pca_frac_to_keep, center_data, epsilon, feature_dim, **kw)
        self.whitening_strength, self.keep_in_pc_space = whitening_strength, keep_in_pc_space

    def _learn(self, values: np.ndarray, vectors: np.ndarray) -> None:
        k = kept_components(values, self.n_components, self.pca_frac_to_keep)
        scale = np.where(np.arange(len(values)) < k, (values + self.epsilon) ** (-self.whitening_strength / 2), 0.0)
        self.matrix = (vectors * scale)[:, :k] if self.keep_in_pc_space else (vectors * scale) @ vectors.T

    def _labels(self, frame: LabeledFrame) -> list | None:
        return None if self.keep_in_pc_space else self.grid[self.feature_dim]


class GlobalColoring(_Projection):
    """The first k rows of the colouring matrix ``U diag((l + eps)^(1/2)) U'`` (of channels, not of modes)."""

    def _learn(self, values: np.ndarray, vectors: np.ndarray) -> None:
        k = kept_components(values, self.n_components, self.pca_frac_to_keep)
        self.matrix = ((vectors * np.sqrt(values + self.epsilon)) @ vectors.T)[:k].T


class ReconstructionPCA(_Projection):
    """Rank-k reconstruction: onto the first components and back, features keep their labels."""

    def _learn(self, values: np.ndarray, vectors: np.ndarray) -> None:
        if self.n_components is None:
            raise ValueError("n_components is needed")
        k = kept_components(values, self.n_components, None)
        self.matrix = vectors[:, :k] @ vectors[:, :k].T

    def _transform(self, frame: LabeledFrame) -> LabeledFrame:
        out = super()._transform(frame)
        means = dict(zip(self.grid[self.feature_dim], self.mean, strict=True))
        entries = F.create_map(*[F.lit(x) for k, v in means.items() for x in (k, float(v))])
        return out.with_value(F.col(VALUE) + F.element_at(entries, F.col(self.feature_dim)))

    def _labels(self, frame: LabeledFrame) -> list | None:
        return self.grid[self.feature_dim]


class ClassMoments:
    """Class means, priors and the pooled within-class scatter, from per-class moments."""

    def __init__(self, per_class: dict[Any, Moments], priors: Sequence[float] | None = None):
        self.classes = sorted(per_class)
        parts = [per_class[c] for c in self.classes]
        self.n = sum(p.n for p in parts)
        self.means = np.array([p.mean for p in parts])
        self.priors = np.array([p.n / self.n for p in parts]) if priors is None else np.asarray(priors, float)
        self.scatter = sum(p.gram - p.n * np.outer(p.mean, p.mean) for p in parts)
        self.mean = self.priors @ self.means


def class_moments(dense: DataFrame, target: str, features: str = "features") -> ClassMoments:
    return ClassMoments({k[0]: m for k, m in moments(dense, [target], features).items() if k[0] is not None})


class LDAProjection(Transform):
    """``(x - mean) @ W`` onto the C - 1 discriminants, columns of unit length."""

    stateful = True

    def __init__(self, target_coord: str = "stimulus", sample_dim: str = "trial", shrinkage: float = 0.0, output_dim: str = "component", **kw: Any):
        super().__init__(**kw)
        self.target_coord, self.sample_dim, self.shrinkage, self.output_dim = target_coord, sample_dim, shrinkage, output_dim

    def _fit(self, frame: LabeledFrame) -> None:
        self.grid = frame.grid(*frame.others(self.sample_dim))
        m = class_moments(frame.dense(self.sample_dim, grid=self.grid), self.target_coord)
        self.mean = m.mean
        self.matrix = discriminants(m, shrunk(m.scatter / m.n, self.shrinkage))

    def _transform(self, frame: LabeledFrame) -> LabeledFrame:
        coords = dict.fromkeys(frame.coords_of(self.sample_dim), self.sample_dim)
        rows = frame.dense(self.sample_dim, grid=self.grid)
        out = rows.select(self.sample_dim, *coords, F.posexplode(apply_matrix("features", self.matrix, self.mean)).alias(self.output_dim, VALUE))
        out = out.withColumn(VALUE, F.nullif(VALUE, F.lit(float("nan"))))  # of samples that lack a cell
        return frame.with_cells(out, (self.sample_dim, self.output_dim), coords)


class NearestCentroidProjection(LDAProjection):
    """The between-class subspace with an identity covariance (a projection, not a classifier)."""

    def __init__(self, target_coord: str = "stimulus", sample_dim: str = "trial", n_components: int | None = None, use_priors: bool = True, output_dim: str = "component", **kw: Any):
        super().__init__(target_coord, sample_dim, 0.0, output_dim, **kw)
        self.n_components, self.use_priors = n_components, use_priors

    def _fit(self, frame: LabeledFrame) -> None:
        self.grid = frame.grid(*frame.others(self.sample_dim))
        m = class_moments(frame.dense(self.sample_dim, grid=self.grid), self.target_coord)
        if not self.use_priors:
            m.priors = np.full(len(m.classes), 1 / len(m.classes))
            m.mean = m.priors @ m.means
        self.mean = m.mean
        self.matrix = discriminants(m, np.eye(m.means.shape[1]), self.n_components)


def shrunk(cov: np.ndarray, shrinkage: float) -> np.ndarray:
    return (1 - shrinkage) * cov + shrinkage * np.trace(cov) / len(cov) * np.eye(len(cov))


def discriminants(m: ClassMoments, cov: np.ndarray, n_components: int | None = None) -> np.ndarray:
    """Directions that part the class means most against ``cov``, from the C x C problem, of unit length."""
    r = min(n_components or len(m.classes) - 1, len(m.classes) - 1)
    spread = (m.means - m.mean) * np.sqrt(m.priors)[:, None]
    half = np.linalg.solve(np.linalg.cholesky(cov + 1e-12 * np.trace(cov) / len(cov) * np.eye(len(cov))), spread.T)
    values, vectors = eigen(half.T @ half)
    w = np.linalg.solve(cov + 1e-12 * np.eye(len(cov)), spread.T @ vectors[:, :r])
    return w / np.maximum(np.linalg.norm(w, axis=0), 1e-300)
