"""Predictors: closed forms from moments, and adapters of Spark's own estimators."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coordspark.frame import VALUE, LabeledFrame
from coordspark.operators.base import Predictor, Transform, TransformError
from coordspark.operators.linear import ClassMoments, apply_matrix, moments, shrunk
from coordspark.operators.sampling import ranked
from coordspark.operators.weights import WEIGHT


def encoded(target: str | Column, classes: Sequence) -> Column:
    """The place of a label among the classes, -1 for an unknown one."""
    c = F.col(target) if isinstance(target, str) else target
    if not classes:
        return F.lit(-1)
    entries = F.create_map(*[F.lit(x) for i, k in enumerate(classes) for x in (k, i)])
    return F.coalesce(F.try_element_at(entries, c), F.lit(-1))


def decoded(code: str | Column, classes: Sequence) -> Column:
    c = F.col(code) if isinstance(code, str) else code
    return F.get(F.array(*map(F.lit, classes)), c.cast("int"))


def whole(features: str | Column) -> Column:
    """Whether no cell is missing."""
    return ~F.exists(features, lambda x: x.isNull())


def vector(features: str | Column) -> Column:
    """For estimators of ``pyspark.ml``, which have no missing values: an error where a cell is missing."""
    c = F.col(features) if isinstance(features, str) else features
    wrong = F.raise_error(F.lit("a sample lacks cells; fill them or leave it out")).cast("array<double>")
    return array_to_vector(F.when(whole(c), c).otherwise(wrong))


def argmax(scores: str | Column) -> Column:
    """The first place of the greatest entry, from 0."""
    return F.array_position(scores, F.array_max(scores)) - 1


class NearestMean(Predictor):
    """The class with the nearest mean; equal distances go to the smaller class. All in SQL over cells."""

    def _learn(self, frame: LabeledFrame) -> None:
        target = self.target_names(frame)[0]
        self.means = frame.cells.where(F.col(target).isNotNull()).groupBy(target, *frame.others(self.sample_dim)).agg(F.avg(VALUE).alias("_mean")).withColumnRenamed(target, "prediction")

    def _predict(self, frame: LabeledFrame) -> DataFrame:
        keys = [self.sample_dim, *frame.coords_of(self.sample_dim)]
        near = frame.cells.join(F.broadcast(self.means), frame.others(self.sample_dim))  # a value for each class and feature
        far = near.groupBy(*keys, "prediction").agg(F.sum((F.col(VALUE) - F.col("_mean")) ** 2).alias("_far"))
        return far.groupBy(*keys).agg(F.min(F.struct("_far", "prediction")).alias("_best")).select(*keys, "_best.prediction")


class LDA(Predictor):
    """Gaussian classes with a pooled, shrunk covariance (over n); softmax of linear scores.

    ``covariance_estimator`` may take the pooled ``ClassMoments`` and give another covariance. The one that is
    used stays in ``covariance``.
    """

    def __init__(self, sample_dim: str = "trial", target_coord: Any = "stimulus", classes: list | None = None, shrinkage: float = 0.0, priors: Sequence[float] | None = None, covariance_estimator: Callable[[ClassMoments], np.ndarray] | None = None, **kw: Any):
        super().__init__(sample_dim, target_coord, classes, **kw)
        self.shrinkage, self.priors, self.covariance_estimator = shrinkage, priors, covariance_estimator

    def _learn(self, frame: LabeledFrame) -> None:
        target = self.target_names(frame)[0]
        found = {k[0]: m for k, m in moments(self.features(frame), [target]).items() if k[0] is not None}
        m = ClassMoments(found, self.priors)
        cov = self.covariance_estimator(m) if self.covariance_estimator else shrunk(m.scatter / m.n, self.shrinkage)
        self.covariance = cov
        own = np.linalg.solve(cov + 1e-9 * max(np.trace(cov) / len(cov), 1e-300) * np.eye(len(cov)), m.means.T)
        self.coef = np.zeros((m.means.shape[1], len(self.classes)))
        self.intercept = np.full(len(self.classes), -np.inf)  # classes that the data lack get no probability
        places = [self.classes.index(c) for c in m.classes]
        self.coef[:, places] = own
        self.intercept[places] = -0.5 * np.einsum("ck,kc->c", m.means, own) + np.log(m.priors)

    def _predict(self, frame: LabeledFrame) -> DataFrame:
        coef, intercept = self.coef, self.intercept

        @F.pandas_udf("array<double>")
        def softmax(xs: pd.Series) -> pd.Series:
            if not len(xs):
                return pd.Series([], dtype=object)
            x = np.array(xs.tolist(), float).reshape(len(xs), -1)
            z = np.nan_to_num(x) @ coef + intercept
            e = np.exp(z - z.max(axis=1, keepdims=True))
            lacking = np.isnan(x).any(axis=1)
            return pd.Series([None if none else p for none, p in zip(lacking, e / e.sum(axis=1, keepdims=True), strict=True)], dtype=object)

        keys = [self.sample_dim, *frame.coords_of(self.sample_dim)]
        scored = self.features(frame).select(*keys, softmax.asNondeterministic()("features").alias("probability"))
        return scored.withColumn("prediction", decoded(argmax("probability"), self.classes))


class Ridge(Predictor):
    """Least squares with a penalty on the slopes, from one pass over (features, targets); any number of targets."""

    is_classifier = False

    def __init__(self, sample_dim: str = "trial", target_coord: Any = "stimulus", classes: list | None = None, alpha: float = 1.0, **kw: Any):
        super().__init__(sample_dim, target_coord, classes, **kw)
        self.alpha = alpha

    def _learn(self, frame: LabeledFrame) -> None:
        names = self.target_names(frame)
        rows = self.features(frame).withColumn("xy", F.concat("features", F.array(*[F.col(t).cast("double") for t in names])))
        if not (found := moments(rows, features="xy")):
            raise TransformError("no row to fit on")
        self._solve(found[()], len(names))

    def _solve(self, m: Any, targets: int) -> None:
        p, cov = len(m.total) - targets, m.covariance(ddof=0) * m.n
        self.coef = np.linalg.solve(cov[:p, :p] + self.alpha * np.eye(p), cov[:p, p:])
        self.intercept = m.mean[p:] - m.mean[:p] @ self.coef

    def _predict(self, frame: LabeledFrame) -> DataFrame:
        keys = [self.sample_dim, *frame.coords_of(self.sample_dim)]
        augmented = F.concat("features", F.array(F.lit(1.0)))
        y = apply_matrix(augmented, np.vstack([self.coef, self.intercept]))
        out = self.features(frame).select(*keys, y.alias("_y"))
        of = lambda i: F.nullif(F.col("_y")[i], F.lit(float("nan")))  # noqa: E731  of a sample that lacks a cell
        names = self.target_names(frame)
        if len(names) == 1:
            return out.select(*keys, of(0).alias("prediction"))
        each = [of(i) for i in range(len(names))]
        return out.select(*keys, F.array(*each).alias("prediction"), *[p.alias(f"prediction__{t}") for p, t in zip(each, names, strict=True)])


class SparkPredictor(Predictor):
    """An estimator of ``pyspark.ml`` by name and parameters. Its parameters are kept in one mapping, so that
    tuned values and seeds survive cloning. A classifier's probabilities stand in the order of ``classes``."""

    def __init__(self, estimator: type, params: Mapping[str, Any] | None = None, sample_dim: str = "trial", target_coord: Any = "stimulus", classes: list | None = None, is_classifier: bool | None = None, weight_coord: str = WEIGHT, **kw: Any):
        super().__init__(sample_dim, target_coord, classes, **kw)
        self.estimator, self.params, self.weight_coord = estimator, dict(params or {}), weight_coord
        self.is_classifier = "Classif" in estimator.__name__ or estimator.__name__ in ("LogisticRegression", "NaiveBayes", "OneVsRest") if is_classifier is None else is_classifier

    def set_seed(self, seed: int) -> None:
        if hasattr(self.estimator, "seed"):
            self.params["seed"] = seed

    def _rows(self, frame: LabeledFrame) -> DataFrame:
        target = self.target_names(frame)[0]
        label = encoded(target, self.classes) if self.is_classifier else F.col(target)
        return self.features(frame).withColumn("features", vector("features")).withColumn("label", label.cast("double"))

    def _estimator(self, frame: LabeledFrame) -> Any:
        params = dict(self.params)
        if self.weight_coord in frame.coords and hasattr(self.estimator, "weightCol"):
            params["weightCol"] = self.weight_coord
        return self.estimator(featuresCol="features", labelCol="label", **params)

    def _learn(self, frame: LabeledFrame) -> None:
        rows = self._rows(frame)
        self.model = self._estimator(frame).fit(rows.where("label >= 0") if self.is_classifier else rows.where("label is not null"))

    def _predict(self, frame: LabeledFrame) -> DataFrame:
        keys = [self.sample_dim, *frame.coords_of(self.sample_dim)]
        out = self.model.transform(self.features(frame).withColumn("features", vector("features")))
        if not self.is_classifier:
            return out.select(*keys, "prediction")
        named = decoded("prediction", self.classes).alias("prediction")
        if "probability" not in out.columns:
            return out.select(*keys, named)
        p = vector_to_array("probability")
        padded = F.concat(p, F.array_repeat(F.lit(0.0), F.greatest(F.lit(len(self.classes)) - F.size(p), F.lit(0))))
        return out.select(*keys, named, F.slice(padded, 1, len(self.classes)).alias("probability"))


class BoostedTrees(SparkPredictor):
    """Gradient-boosted trees that stop early on an inner validation part (split within classes).

    ``early_stopping_tol`` is the least improvement; classes beyond two are one against the rest.
    """

    def __init__(self, params: Mapping[str, Any] | None = None, sample_dim: str = "trial", target_coord: Any = "stimulus", classes: list | None = None, is_classifier: bool = True, validation_size: float = 0.2, validation_seed: int = 0, early_stopping_tol: float | None = 0.01, **kw: Any):
        from pyspark.ml.classification import GBTClassifier
        from pyspark.ml.regression import GBTRegressor

        super().__init__(GBTClassifier if is_classifier else GBTRegressor, params, sample_dim, target_coord, classes, is_classifier, **kw)
        self.validation_size, self.validation_seed, self.early_stopping_tol = validation_size, validation_seed, early_stopping_tol

    @classmethod
    def _names(cls) -> list[str]:
        return [n for n in super()._names() if n != "estimator"]

    def _marked(self, rows: DataFrame) -> DataFrame:
        """Rows with ``held``: true for the validation part."""
        marked = ranked(rows, self.sample_dim, ["label"] if self.is_classifier else [], self.validation_seed)
        return marked.withColumn("held", F.col("rank") <= F.round(F.col("total") * self.validation_size))

    def _learn(self, frame: LabeledFrame) -> None:
        rows, params = self._rows(frame), dict(self.params)
        if self.early_stopping_tol is not None:
            rows, params = self._marked(rows), {**params, "validationIndicatorCol": "held", "validationTol": self.early_stopping_tol}
        make = lambda: self.estimator(featuresCol="features", labelCol="label", **params)
        if not self.is_classifier:
            self.models = [make().fit(rows.where("label is not null"))]
        elif len(self.classes) == 2:
            self.models = [make().fit(rows.where("label >= 0"))]
        else:
            self.models = [make().fit(rows.where("label >= 0").withColumn("label", (F.col("label") == i).cast("double"))) for i in range(len(self.classes))]
        self.best_iterations = [m.getNumTrees for m in self.models]

    def _predict(self, frame: LabeledFrame) -> DataFrame:
        keys = [self.sample_dim, *frame.coords_of(self.sample_dim)]
        rows = self.features(frame).withColumn("features", vector("features"))
        if not self.is_classifier:
            return self.models[0].transform(rows).select(*keys, "prediction")
        for i, m in enumerate(self.models):
            rows = m.transform(rows).withColumn(f"_p{i}", vector_to_array("probability")[1]).drop("prediction", "rawPrediction", "probability")
        raw = [1 - F.col("_p0"), F.col("_p0")] if len(self.classes) == 2 else [F.col(f"_p{i}") for i in range(len(self.models))]
        total = sum(raw[1:], raw[0])
        out = rows.select(*keys, F.array(*[F.coalesce(F.try_divide(p, total), F.lit(0.0)) for p in raw]).alias("probability"))
        return out.withColumn("prediction", decoded(argmax("probability"), self.classes))


class MultiOutput(Predictor):
    """One predictor per target; predictions in ``prediction__<target>``, all of them in an array."""

    def __init__(self, template: Predictor, sample_dim: str = "trial", target_coord: Any = "*", classes: list | None = None, **kw: Any):
        super().__init__(sample_dim, target_coord, classes, **kw)
        self.template = template
        self.is_classifier = template.is_classifier

    def _learn(self, frame: LabeledFrame) -> None:
        self.fitted = {}
        for t in self.target_names(frame):
            self.fitted[t] = self.template.clone().set_params(target_coord=t)
            self.fitted[t].fit(frame)

    def _predict(self, frame: LabeledFrame) -> DataFrame:
        keys = [self.sample_dim, *frame.coords_of(self.sample_dim)]
        out = None
        for t, p in self.fitted.items():
            own = p.predict(frame)
            renamed = own.select(self.sample_dim, F.col("prediction").alias(f"prediction__{t}"), *([F.col("probability").alias(f"probability__{t}")] if "probability" in own.columns else []))
            out = renamed if out is None else out.join(renamed, self.sample_dim)
        joined = frame.samples(self.sample_dim).join(out, self.sample_dim)
        return joined.withColumn("prediction", F.array(*[F.col(f"prediction__{t}") for t in self.fitted])).select(*keys, "prediction", *[c for c in out.columns if c != self.sample_dim])


def thresholded(probability: str | Column, thresholds: Sequence[float] | float = 0.5, n: int | None = None) -> Column:
    """1 where a label's probability reaches its threshold."""
    limits = F.array(*[F.lit(float(t)) for t in thresholds]) if isinstance(thresholds, Sequence) else F.array_repeat(F.lit(float(thresholds)), F.size(probability))
    return F.zip_with(probability, limits, lambda p, t: (p >= t).cast("int"))


class SparkTransformer(Transform):
    """A feature estimator of ``pyspark.ml`` (PCA, scalers) on dense rows; output dims (sample, component)."""

    stateful = True

    def __init__(self, estimator: type, params: Mapping[str, Any] | None = None, sample_dim: str = "trial", output_dim: str = "component", **kw: Any):
        super().__init__(**kw)
        self.estimator, self.params, self.sample_dim, self.output_dim = estimator, dict(params or {}), sample_dim, output_dim

    def _rows(self, frame: LabeledFrame) -> DataFrame:
        return frame.dense(self.sample_dim, grid=self.grid).withColumn("features", vector("features"))

    def _fit(self, frame: LabeledFrame) -> None:
        self.grid = frame.grid(*frame.others(self.sample_dim))
        self.model = self.estimator(inputCol="features", outputCol="_out", **self.params).fit(self._rows(frame))

    def _transform(self, frame: LabeledFrame) -> LabeledFrame:
        coords = dict.fromkeys(frame.coords_of(self.sample_dim), self.sample_dim)
        out = self.model.transform(self._rows(frame)).select(self.sample_dim, *coords, F.posexplode(vector_to_array("_out")).alias(self.output_dim, VALUE))
        return frame.with_cells(out, (self.sample_dim, self.output_dim), coords)
