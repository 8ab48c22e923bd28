"""Cross-validation: folds are a column, the part of a pipeline that needs no fit runs once for all folds.

Ranks by seeded hash make folds that any engine gives alike. Within a stratum samples go round the folds in
turn, and strata start where the one before ended, so folds differ by one sample at most, overall and in each
stratum. ``-1`` marks the holdout.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coordspark.frame import LabeledFrame
from coordspark.functions import scoring as scores
from coordspark.operators.compose import Pipeline, Step
from coordspark.operators.sampling import ranked, turn

HOLDOUT = -1


def stratified_folds(samples: DataFrame, sample: str, stratum: str | None, k: int, seed: int | None) -> DataFrame:
    """``samples`` with ``fold``; without a seed in the order of the samples' labels."""
    strata = [stratum] if stratum else []
    if seed is None:
        order = Window.partitionBy(*strata).orderBy(sample) if strata else Window.orderBy(sample)
        rows = samples.withColumns({"rank": F.row_number().over(order), "total": F.lit(0)})
    else:
        rows = ranked(samples, sample, strata, seed)
    if not strata:
        return rows.withColumn("fold", ((F.col("rank") - 1) % k).cast("int")).drop("rank", "total")
    sizes = samples.groupBy(F.col(stratum).alias("_stratum")).agg(F.count(F.lit(1)).alias("_n"))  # a row per stratum
    starts = sizes.select("_stratum", (F.sum("_n").over(Window.orderBy("_stratum")) - F.col("_n")).alias("_off"))
    met = rows.join(F.broadcast(starts), F.col(stratum).eqNullSafe(F.col("_stratum")))  # a null is a stratum too
    return met.withColumn("fold", ((F.col("rank") - 1 + F.col("_off")) % k).cast("int")).drop("rank", "total", "_off", "_stratum")


def holdout(samples: DataFrame, sample: str, stratum: str | None, test_size: float, seed: int) -> DataFrame:
    """``samples`` with ``held``: the first ``round(n * test_size)`` of each stratum."""
    rows = ranked(samples, sample, [stratum] if stratum else [], seed)
    return rows.withColumn("held", F.col("rank") <= F.round(F.col("total") * test_size)).drop("rank", "total")


class Validator:
    """Gives ``(sample, fold)`` of a frame; a fold's training part is ``train(fold)``."""

    def __init__(self, n_splits: int = 5, shuffle: bool = True, random_state: int = 0, test_size: float | None = None, stratify_coord: str | None = None, sample_dim: str = "trial", scoring: str | Callable | None = None, pooled_score_weight: float = 0.0, exclude_intertrial: bool = False, exclude_time_offset: bool = False, verbose: bool = False):
        if n_splits < 2:
            raise ValueError("n_splits is at least 2")
        self.n_splits, self.shuffle, self.random_state, self.test_size = n_splits, shuffle, random_state, test_size
        self.stratify_coord, self.sample_dim, self.scoring, self.pooled_score_weight = stratify_coord, sample_dim, scoring, pooled_score_weight
        self.exclude_intertrial, self.exclude_time_offset = exclude_intertrial, exclude_time_offset

    @property
    def fold_seed(self) -> int | None:
        return self.random_state if self.shuffle else None

    def _guard(self, samples: DataFrame, stratum: str, least: int) -> None:
        row = samples.groupBy(stratum).agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)), F.min("n")).first()
        if row[0] > 100:
            raise ValueError(f"{stratum} has {row[0]} labels; stratify by 100 at most")
        if row[1] is not None and row[1] < least:
            raise ValueError(f"a label of {stratum} has {row[1]} samples, fewer than {least}")

    def _units(self, frame: LabeledFrame, stratum: str | None) -> tuple[DataFrame, str, str | None]:
        """What is dealt out: samples, or groups of repeats of one ``orig_trial`` (with ``session``)."""
        d = self.sample_dim
        samples = frame.samples(d)
        if "orig_trial" not in frame.coords:
            return samples.withColumn("_unit", F.col(d)), d, stratum
        parts = ["session", "orig_trial"] if "session" in frame.coords else ["orig_trial"]
        named = samples.withColumn("_unit", F.concat_ws("::", *[F.col(p).cast("string") for p in parts]))
        if stratum and named.groupBy("_unit").agg(F.count_distinct(stratum).alias("n")).where("n > 1").limit(1).count():
            warnings.warn("a group of repeats holds several labels: folds are not stratified", stacklevel=3)
            stratum = None
        return named, "_unit", stratum

    def folds(self, frame: LabeledFrame) -> DataFrame:
        """``(sample, fold)``."""
        d = self.sample_dim
        named, _, stratum = self._units(frame, self.stratify_coord)
        units = named.groupBy("_unit").agg(*([F.first(stratum).alias(stratum)] if stratum else [F.count(F.lit(1)).alias("_k")]))
        if stratum:
            self._guard(units, stratum, max(self.n_splits, 2 if self.test_size else 0))
        if self.test_size:
            units = holdout(units, "_unit", stratum, self.test_size, self.random_state)
            kept = stratified_folds(units.where("not held"), "_unit", stratum, self.n_splits, self.fold_seed)
            dealt = kept.select("_unit", "fold").unionByName(units.where("held").select("_unit", F.lit(HOLDOUT).alias("fold")))
        else:
            dealt = stratified_folds(units, "_unit", stratum, self.n_splits, self.fold_seed).select("_unit", "fold")
        return named.select(d, "_unit").join(dealt, "_unit").select(d, "fold")

    def fold_list(self, folds: DataFrame) -> list[int]:
        return [r[0] for r in folds.where(F.col("fold") >= 0).select("fold").distinct().orderBy("fold").collect()]

    def train(self, fold: int) -> Column:
        """Over frames with a ``fold`` coordinate."""
        return (F.col("fold") != fold) & (F.col("fold") != HOLDOUT)

    def validation(self, fold: int) -> Column:
        return F.col("fold") == fold

    def scored(self, predictions: DataFrame) -> DataFrame:
        """Predictions that count."""
        out = predictions
        if self.exclude_intertrial and "event_type" in out.columns:
            out = out.where("event_type is distinct from 'intertrial'")
        if self.exclude_time_offset and "time_offset_ms" in out.columns:
            out = out.where("time_offset_ms = 0 or time_offset_ms is null")
        return out


class KFold(Validator):
    """Folds over samples, stratified by ``stratify_coord`` if given."""


class GroupedKFold(Validator):
    """Folds stratified by group and label; then groups may be kept to training, validation or the holdout."""

    def __init__(self, group_coord: str, train_groups: Sequence | None = None, val_groups: Sequence | None = None, test_groups: Sequence | None = None, stratify_by_group: bool = True, **kw: Any):
        super().__init__(**kw)
        self.group_coord, self.train_groups, self.val_groups, self.test_groups, self.stratify_by_group = group_coord, train_groups, val_groups, test_groups, stratify_by_group

    def folds(self, frame: LabeledFrame) -> DataFrame:
        d = self.sample_dim
        keys = [self.group_coord, *([self.stratify_coord] if self.stratify_coord else [])] if self.stratify_by_group else [self.stratify_coord] if self.stratify_coord else []
        samples = frame.samples(d)
        if keys:
            samples = samples.withColumn("_key", F.concat_ws("_", *[F.col(k).cast("string") for k in keys]))
        stratum = "_key" if keys else None
        if self.test_size:
            marked = holdout(samples, d, stratum, self.test_size, self.random_state)
            held = F.col("held") & (F.col(self.group_coord).isin(list(self.test_groups)) if self.test_groups else F.lit(True))
            samples, rest = marked.where(~F.col("held")).drop("held"), marked.where(held)
        if stratum:
            self._guard(samples, stratum, self.n_splits)
        dealt = stratified_folds(samples, d, stratum, self.n_splits, self.fold_seed).select(d, "fold")
        return dealt.unionByName(rest.select(d, F.lit(HOLDOUT).alias("fold"))) if self.test_size else dealt

    def train(self, fold: int) -> Column:
        own = super().train(fold)
        return own & F.col(self.group_coord).isin(list(self.train_groups)) if self.train_groups else own

    def validation(self, fold: int) -> Column:
        own = super().validation(fold)
        return own & F.col(self.group_coord).isin(list(self.val_groups)) if self.val_groups else own


class LeaveGroupOut(Validator):
    """One group per fold, or shuffled groups in ``n_splits`` nearly equal runs; some may be the holdout."""

    def __init__(self, group_coord: str, test_group_ids: Sequence = (), validation_group_ids: Sequence | None = None, n_splits: int | None = None, **kw: Any):
        super().__init__(n_splits=max(n_splits or 2, 2), **kw)
        if n_splits is not None and n_splits < 2:
            raise ValueError("n_splits is at least 2")
        if set(test_group_ids) & set(validation_group_ids or ()):
            raise ValueError("validation and test groups overlap")
        self.group_coord, self.test_group_ids, self.validation_group_ids, self.splits = group_coord, list(test_group_ids), validation_group_ids, n_splits

    def folds(self, frame: LabeledFrame) -> DataFrame:
        d, g = self.sample_dim, self.group_coord
        samples = frame.samples(d).select(d, g)
        groups = samples.select(g).where(F.col(g).isNotNull()).distinct()
        usable = groups.where(~F.col(g).isin(self.test_group_ids)) if self.test_group_ids else groups
        tried = usable.where(F.col(g).isin(list(self.validation_group_ids))) if self.validation_group_ids else usable
        if not self.splits:
            table = tried.withColumn("fold", (F.row_number().over(Window.orderBy(g)) - 1).cast("int"))
        else:
            n = tried.count()
            k = min(self.splits, n)
            if k < self.splits:
                warnings.warn(f"{n} groups make {k} folds", stacklevel=2)
            small, extra = divmod(n, k)
            place = F.row_number().over(Window.orderBy(turn(g, self.random_state), g)) - 1
            cut = extra * (small + 1)
            run = F.when(F.col("_at") < cut, F.floor(F.col("_at") / (small + 1))).otherwise(extra + F.floor((F.col("_at") - cut) / max(small, 1)))
            table = tried.withColumn("_at", place).withColumn("fold", run.cast("int")).drop("_at")
        rest = usable.join(table, g, "left_anti").withColumn("fold", F.lit(-2))  # trains in every fold
        table = table.unionByName(rest)
        if self.test_group_ids:
            table = table.unionByName(groups.where(F.col(g).isin(self.test_group_ids)).withColumn("fold", F.lit(HOLDOUT)))
        return samples.join(F.broadcast(table), g).select(d, "fold")


class LeaveSessionOut(LeaveGroupOut):
    def __init__(self, **kw: Any):
        super().__init__(group_coord=kw.pop("group_coord", "session"), **kw)


class LeaveAnimalOut(LeaveGroupOut):
    def __init__(self, **kw: Any):
        super().__init__(group_coord=kw.pop("group_coord", "animal"), **kw)


class SampledDomainKFold(Validator):
    """Folds over the target domain; training adds all of the source and some of the remaining target per label."""

    def __init__(self, domain_coord: str, target_domains: Sequence, source_domains: Sequence, label_coord: str, default_samples_per_label: int | None = None, label_sample_counts: dict | None = None, **kw: Any):
        super().__init__(**kw)
        self.domain_coord, self.target_domains, self.source_domains, self.label_coord = domain_coord, list(target_domains), list(source_domains), label_coord
        self.default_samples_per_label, self.label_sample_counts = default_samples_per_label, dict(label_sample_counts or {})

    def folds(self, frame: LabeledFrame) -> DataFrame:
        d = self.sample_dim
        samples = frame.samples(d)
        target = samples.where(F.col(self.domain_coord).isin(self.target_domains))
        if self.test_size:
            marked = holdout(target, d, self.label_coord, self.test_size, self.random_state)
            held, target = marked.where("held").select(d, F.lit(HOLDOUT).alias("fold")), marked.where("not held").drop("held")
        self._guard(target, self.label_coord, self.n_splits)
        dealt = stratified_folds(target, d, self.label_coord, self.n_splits, self.fold_seed).select(d, "fold")
        source = samples.where(F.col(self.domain_coord).isin(self.source_domains)).select(d, F.lit(-2).alias("fold"))
        out = dealt.unionByName(source)
        return out.unionByName(held) if self.test_size else out

    def train_samples(self, samples: DataFrame, fold: int) -> DataFrame:
        """``(sample)`` for training: the source, and the first of each label of the rest of the target."""
        d = self.sample_dim
        rest = ranked(samples.where((F.col("fold") >= 0) & (F.col("fold") != fold)), d, [self.label_coord], self.random_state)
        limit = F.lit(self.default_samples_per_label) if self.default_samples_per_label is not None else F.lit(None).cast("int")
        for label, n in self.label_sample_counts.items():
            limit = F.when(F.col(self.label_coord) == F.lit(label), F.lit(n)).otherwise(limit)
        chosen = rest.where(limit.isNull() | (F.col("rank") <= limit)).select(d)
        return samples.where(F.col("fold") == -2).select(d).unionByName(chosen)


@dataclass
class CVResult:
    """Out-of-fold predictions (a row per sample, with ``fold``), scores by fold and their summary."""

    predictions: DataFrame
    cv_scores: dict[int, float]
    oof_score: float | None
    score: float
    scoring: str | Callable
    truth: str | list[str]
    folds: DataFrame = field(repr=False, default=None)
    holdout_score: float | None = None
    holdout_predictions: DataFrame | None = None

    @property
    def mean_cv_score(self) -> float:
        return sum(self.cv_scores.values()) / len(self.cv_scores)

    def confusion(self) -> DataFrame:
        return scores.normalised(scores.confusion(self.predictions, self.truth))


class CrossValidator:
    """Runs a pipeline over a validator's folds.

    Steps before the first stateful one see all samples once, and their output is persisted for the folds.
    Each fold fits clones of the rest. All folds' predictions are one table, scored by one aggregate.
    """

    def __init__(self, validator: Validator, scoring: str | Callable | None = None):
        self.validator, self.scoring = validator, scoring or validator.scoring
        self.result: CVResult | None = None

    def _parts(self, pipeline: Pipeline) -> tuple[Pipeline | None, Pipeline]:
        if not pipeline.is_predictor:
            raise ValueError("cross-validation needs a pipeline that ends in a predictor")
        at = pipeline.first_stateful()
        prefix = Pipeline("prefix", pipeline.steps[:at]) if at else None
        return prefix, Pipeline("suffix", pipeline.steps[at:])

    def _with_classes(self, pipeline: Pipeline, frame: LabeledFrame) -> None:
        """The label vocabulary comes from all samples, holdout included; statistics never do."""
        p = pipeline.predictor
        if p.is_classifier and len(p.target_names(frame)) == 1:
            p.set_classes(frame.label_list(p.target_names(frame)[0]))

    def cross_validate(self, pipeline: Pipeline, frame: LabeledFrame) -> CVResult:
        v, d = self.validator, self.validator.sample_dim
        prefix, suffix = self._parts(pipeline)
        predictor = suffix.predictor
        truth = predictor.target_names(frame)
        truth = truth[0] if len(truth) == 1 else truth
        folds = v.folds(frame).persist(StorageLevel.MEMORY_AND_DISK)
        ready = prefix.transform(frame) if prefix else frame
        cells = ready.cells.drop("fold").join(folds, d)
        ready = LabeledFrame(cells.persist(StorageLevel.MEMORY_AND_DISK), ready.dims, {**ready.coords, "fold": d}, ready.attrs, ready.history)
        self._with_classes(suffix, ready)
        self.ready, self.suffix = ready, suffix
        parts, splits = [], v.fold_list(folds)
        for fold in splits:
            fitted = suffix.clone()
            self._with_same_classes(fitted, suffix)
            fitted.fit(self._train(ready, fold))
            parts.append(fitted.predict(ready.where(v.validation(fold))))
        shared = [c for c in parts[0].columns if all(c in p.columns for p in parts)]
        out = v.scored(reduce(DataFrame.unionByName, [p.select(*shared) for p in parts]).persist(StorageLevel.MEMORY_AND_DISK))
        name = self.scoring or (("f1_weighted" if isinstance(truth, str) else "f1_samples") if predictor.is_classifier else "r2")
        if callable(name) or name in scores._PRECISION or not isinstance(truth, str) and predictor.is_classifier:
            name = scores.scorer(name)
            counts = {r["fold"] for r in out.select("fold").distinct().collect()}
            by_fold = {f: float(name(out.where(F.col("fold") == f), truth)) for f in splits if f in counts}
        else:
            by_fold = {r["fold"]: float("nan") if r["score"] is None else float(r["score"]) for r in scores.score_table(name, out, truth, ["fold"]).collect()}
        for p in (folds, ready.cells):
            p.unpersist()
        if lacking := sorted(set(splits) - set(by_fold)):
            raise ValueError(f"no prediction is left to score in folds {lacking}")
        mean, w = sum(by_fold.values()) / len(by_fold), v.pooled_score_weight
        pooled = scores.scorer(name)(out, truth) if w else None
        self.result = CVResult(out, by_fold, pooled, (1 - w) * mean + w * pooled if w else mean, name, truth, folds)
        return self.result

    def _with_same_classes(self, clone: Pipeline, like: Pipeline) -> None:
        if like.predictor.classes is not None:
            clone.predictor.set_classes(like.predictor.classes)

    def _train(self, ready: LabeledFrame, fold: int) -> LabeledFrame:
        v = self.validator
        if isinstance(v, SampledDomainKFold):
            chosen = v.train_samples(ready.samples(v.sample_dim), fold)
            return ready.with_cells(ready.cells.join(chosen, v.sample_dim, "left_semi"))
        return ready.where(v.train(fold))

    def score_on_holdout(self, pipeline: Pipeline, frame: LabeledFrame) -> float:
        """Refit on all but the holdout, score there."""
        if self.result is None:
            warnings.warn("cross_validate was not run; the split is made now", stacklevel=2)
            self.cross_validate(pipeline, frame)
        held = self.ready.where(F.col("fold") == HOLDOUT)
        if not held.cells.limit(1).count():
            raise ValueError("the validator has no holdout (test_size)")
        fitted = self.suffix.clone()
        self._with_same_classes(fitted, self.suffix)
        fitted.fit(self.ready.where(F.col("fold") != HOLDOUT))
        out = self.validator.scored(fitted.predict(held))
        self.result.holdout_predictions, self.result.holdout_score = out, scores.scorer(self.result.scoring)(out, self.result.truth)
        return self.result.holdout_score

    def holdout_frame(self, frame: LabeledFrame) -> LabeledFrame:
        """The holdout's samples of ``frame``, as they are before any step."""
        held = self.validator.folds(frame).where(F.col("fold") == HOLDOUT).select(self.validator.sample_dim)
        return frame.with_cells(frame.cells.join(held, self.validator.sample_dim, "left_semi"))

    def holdout_confusion(self) -> DataFrame:
        """Of the holdout's scored predictions."""
        return scores.normalised(scores.confusion(self.result.holdout_predictions, self.result.truth))

    def finalize(self, pipeline: Pipeline, frame: LabeledFrame) -> Pipeline:
        """A clone, fitted on everything, ready for inference."""
        final = pipeline.clone()
        if pipeline.predictor.is_classifier:
            self._with_classes(final, frame)
        return final.fit(frame).prepare_for_inference()


def fold_rows(validator: Validator, frame: LabeledFrame, label: str) -> DataFrame:
    """Dense rows with ``features`` (a vector), ``label`` and ``fold``, for the ``foldCol`` of ``pyspark.ml.tuning``."""
    from pyspark.ml.functions import array_to_vector

    d = validator.sample_dim
    rows = frame.dense(d).join(validator.folds(frame), d).where(F.col("fold") >= 0)
    return rows.select(d, array_to_vector("features").alias("features"), F.col(label).cast("double").alias("label"), F.col("fold").cast("int").alias("fold"))


# One-scan statistics: sums are additive, so a fold's training statistic is the total less the fold's own.

def centroid_sums(frame: LabeledFrame, target: str, by: str = "fold") -> DataFrame:
    """``(by, target, features, total, n)``: one pass for all folds."""
    features = [d for d in frame.dims if d != frame.dim_of(target)]
    return frame.cells.groupBy(by, target, *features).agg(F.sum("value").alias("total"), F.count("value").alias("n"))


def nearest_mean_oof(frame: LabeledFrame, target: str, sample_dim: str = "trial") -> DataFrame:
    """Out-of-fold predictions of the nearest class mean for all folds at once: ``(sample, coordinates, prediction)``.

    ``frame`` has a ``fold`` coordinate. Every sample is scanned once for the sums and once for its distances.
    """
    features = frame.others(sample_dim)
    own = centroid_sums(frame, target)
    total = own.groupBy(target, *features).agg(F.sum("total").alias("all_total"), F.sum("n").alias("all_n"))
    grid = own.select("fold").distinct().crossJoin(total)  # folds by classes by features
    joined = grid.join(own, ["fold", target, *features], "left")
    means = joined.select("fold", F.col(target).alias("prediction"), *features, F.try_divide(F.col("all_total") - F.coalesce("total", F.lit(0.0)), F.col("all_n") - F.coalesce("n", F.lit(0))).alias("mean"))
    keys = [sample_dim, *frame.coords_of(sample_dim)]
    far = frame.cells.join(F.broadcast(means), ["fold", *features]).groupBy(*keys, "prediction").agg(F.sum((F.col("value") - F.col("mean")) ** 2).alias("far"))
    return far.where("far is not null").groupBy(*keys).agg(F.min(F.struct("far", "prediction")).alias("best")).select(*keys, "best.prediction")
