"""Composition: pipelines, switches, unions, per-group application, ensembles."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coordspark.frame import VALUE, LabeledFrame
from coordspark.operators.base import Predictor, Transform, TransformError
from coordspark.operators.select import Identity


@dataclass
class Step:
    name: str
    transform: Transform


def _steps(steps: Sequence) -> list[Step]:
    made = [s if isinstance(s, Step) else Step(*s) if isinstance(s, tuple) else Step(type(s).__name__.lower(), s) for s in steps]
    if len({s.name for s in made}) < len(made):
        raise ValueError(f"names repeat: {[s.name for s in made]}")
    return made


class Composite(Transform):
    """Has named children; stateful if any child is."""

    def children(self) -> list[Step]:
        raise NotImplementedError

    @property
    def is_stateful(self) -> bool:
        return any(s.transform.is_stateful for s in self.children())

    def set_params(self, **params: Any) -> Composite:
        named = {s.name: s.transform for s in self.children()}
        for key, value in params.items():
            own, _, rest = key.partition("__")
            if own in named and rest:
                named[own].set_params(**{rest: value})
            else:
                super().set_params(**{key: value})
        return self

    def get_params(self, deep: bool = False) -> dict[str, Any]:
        params = {n: getattr(self, n) for n in self._names()}
        if deep:
            for s in self.children():
                params |= {f"{s.name}__{k}": v for k, v in s.transform.get_params(True).items()}
        return params

    def prepare_for_inference(self) -> Composite:
        for s in self.children():
            s.transform.prepare_for_inference()
        return self


class Pipeline(Composite):
    """Steps in a row. All is lazy but what a step's fit needs; errors say which step they are from."""

    def __init__(self, name: str, steps: Sequence, expected_input_dims: Sequence[str] | None = None, **kw: Any):
        super().__init__(**kw)
        self.name, self.steps, self.expected_input_dims = name, _steps(steps), expected_input_dims
        if expected_input_dims:
            self.output_dims(tuple(expected_input_dims))

    def clone(self) -> Pipeline:
        return Pipeline(self.name, [Step(s.name, s.transform.clone()) for s in self.steps], self.expected_input_dims)

    def children(self) -> list[Step]:
        return self.steps

    @property
    def is_predictor(self) -> bool:
        return bool(self.steps) and self.steps[-1].transform.is_predictor

    @property
    def predictor(self) -> Predictor:
        last = self.steps[-1].transform
        return last.predictor if isinstance(last, (Pipeline, Switch)) else last

    def output_dims(self, dims: tuple[str, ...]) -> tuple[str, ...]:
        for s in self.steps:
            wanted = s.transform.input_dims
            if wanted and tuple(wanted) != tuple(dims):
                raise TransformError(f"step {s.name} takes dims {wanted}, not {dims}")
            dims = s.transform.output_dims(dims)
        return dims

    def first_stateful(self) -> int:
        """Where the prefix that needs no fit ends."""
        return next((i for i, s in enumerate(self.steps) if s.transform.is_stateful or s.transform.is_predictor), len(self.steps))

    def _run(self, frame: LabeledFrame, fitting: bool, upto: int | None = None) -> LabeledFrame:
        for s in self.steps[:upto]:
            try:
                frame = s.transform.fit_transform(frame) if fitting else s.transform.transform(frame)
            except TransformError as e:
                raise TransformError(f"error in step {s.name}: {e}") from e
            except Exception as e:
                raise TransformError(f"error in step {s.name}: {type(e).__name__}: {e}") from e
        return frame

    def fit(self, frame: LabeledFrame) -> Pipeline:
        """The last step is fitted only, so that any predictor may end a pipeline."""
        frame = self._run(self._narrowed(frame), True, len(self.steps) - 1)
        try:
            self.steps[-1].transform.fit(frame)
        except Exception as e:
            raise TransformError(f"error in step {self.steps[-1].name}: {e}") from e
        return self

    def fit_transform(self, frame: LabeledFrame) -> LabeledFrame:
        return self._run(self._narrowed(frame), True)

    def transform(self, frame: LabeledFrame) -> LabeledFrame:
        return self._run(self._narrowed(frame), False)

    def predict(self, frame: LabeledFrame) -> DataFrame:
        if not self.is_predictor:
            raise TransformError(f"{self.name} does not end in a predictor")
        return self.steps[-1].transform.predict(self._run(self._narrowed(frame), False, len(self.steps) - 1))

    predict_proba = predict


class Switch(Composite):
    """One of several branches, chosen by ``choose`` (or the argument of a call)."""

    def __init__(self, choices: Sequence, choose: str | None = None, **kw: Any):
        super().__init__(**kw)
        self.choices, self.choose = _steps(choices), choose

    def clone(self) -> Switch:
        return Switch([Step(s.name, s.transform.clone()) for s in self.choices], self.choose)

    def children(self) -> list[Step]:
        return self.choices

    def chosen(self, choose: str | None = None) -> Transform:
        name = choose or self.choose
        for s in self.choices:
            if s.name == name:
                return s.transform
        raise TransformError(f"no branch {name!r} among {[s.name for s in self.choices]}")

    @property
    def is_stateful(self) -> bool:
        return self.chosen().is_stateful if self.choose else super().is_stateful

    @property
    def is_predictor(self) -> bool:
        """Undecided: if all branches are."""
        return self.chosen().is_predictor if self.choose else all(s.transform.is_predictor for s in self.choices)

    @property
    def predictor(self) -> Transform:
        return self.chosen()

    def output_dims(self, dims: tuple[str, ...]) -> tuple[str, ...]:
        outs = {s.transform.output_dims(dims) for s in self.choices}
        if len(outs) > 1:
            raise TransformError(f"branches give different dims: {sorted(outs)}")
        return outs.pop()

    def fit(self, frame: LabeledFrame, choose: str | None = None) -> Switch:
        self.chosen(choose).fit(self._narrowed(frame))
        return self

    def transform(self, frame: LabeledFrame, choose: str | None = None) -> LabeledFrame:
        return self.chosen(choose).transform(self._narrowed(frame))

    def fit_transform(self, frame: LabeledFrame, choose: str | None = None) -> LabeledFrame:
        return self.chosen(choose).fit_transform(self._narrowed(frame))

    def predict(self, frame: LabeledFrame, choose: str | None = None) -> DataFrame:
        return self.chosen(choose).predict(frame)


class Optional(Switch):
    """A transform or nothing."""

    def __init__(self, template: Transform, use: bool = True, name: str | None = None, skip_name: str = "identity", choose: str | None = None, **kw: Any):
        self.template, self.use, self.name, self.skip_name = template, use, name or type(template).__name__.lower(), skip_name
        super().__init__([Step(self.name, template), Step(skip_name, Identity())], choose or (self.name if use else skip_name), **kw)

    def clone(self) -> Optional:
        return Optional(self.template.clone(), self.use, self.name, self.skip_name, self.choose)


class Union(Composite):
    """Branches over the same input, side by side: labels of ``from_dims`` become ``branch_label`` of ``to_dim``.

    The other dimensions must agree in name and order; ``exact`` also checks that all branches hold the same
    labels there (which reads them).
    """

    def __init__(self, branches: Sequence, from_dims: Sequence[str], to_dim: str = "feature", exact: bool = True, **kw: Any):
        super().__init__(**kw)
        self.branches, self.from_dims, self.to_dim, self.exact = _steps(branches), list(from_dims), to_dim, exact
        if len(self.from_dims) != len(self.branches):
            raise ValueError("give one of from_dims for each branch")

    def clone(self) -> Union:
        return Union([Step(s.name, s.transform.clone()) for s in self.branches], self.from_dims, self.to_dim, self.exact)

    def children(self) -> list[Step]:
        return self.branches

    def _joined(self, frames: list[LabeledFrame]) -> LabeledFrame:
        parts, shape = [], None
        for s, dim, f in zip(self.branches, self.from_dims, frames, strict=True):
            f.require(dim)
            rest = tuple(self.to_dim if d == dim else d for d in f.dims)
            if shape is not None and rest != shape:
                raise TransformError(f"branch {s.name} gives dims {rest}, not {shape}")
            shape = rest
            coords = {c: d for c, d in f.coords.items() if d != dim}
            named = F.concat_ws("_", F.lit(s.name), F.col(dim).cast("string")).alias(self.to_dim)
            parts.append((f.cells.select(*[named if d == dim else F.col(d) for d in f.dims], *coords, VALUE), coords))
        if self.exact and len(parts) > 1:
            keys = [d for d in shape if d != self.to_dim]
            first, *others = [p.select(*keys).distinct() for p, _ in parts]
            if any(first.exceptAll(o).limit(1).count() or o.exceptAll(first).limit(1).count() for o in others):
                raise TransformError("branches hold different labels outside the joined dimension")
        shared = {c: d for c, d in parts[0][1].items() if all(c in p for _, p in parts)}
        cells = reduce(DataFrame.unionByName, [p.select(*shape, *shared, VALUE) for p, _ in parts])
        return frames[0].with_cells(cells, shape, shared)

    def fit(self, frame: LabeledFrame) -> Union:
        for s in self.branches:
            s.transform.fit(self._narrowed(frame))
        return self

    def transform(self, frame: LabeledFrame) -> LabeledFrame:
        frame = self._narrowed(frame)
        return self._joined([s.transform.transform(frame) for s in self.branches]).logged("Union", {"to_dim": self.to_dim})

    def fit_transform(self, frame: LabeledFrame) -> LabeledFrame:
        frame = self._narrowed(frame)
        return self._joined([s.transform.fit_transform(frame) for s in self.branches]).logged("Union", {"to_dim": self.to_dim})


class UnionWithInput(Union):
    """A transform's output beside its input (branch ``identity``)."""

    def __init__(self, template: Transform, join_dim: str, to_dim: str | None = None, name: str | None = None, exact: bool = True, **kw: Any):
        self.template, self.join_dim, self.name = template, join_dim, name or type(template).__name__.lower()
        super().__init__([Step("identity", Identity()), Step(self.name, template)], [join_dim, join_dim], to_dim or join_dim, exact, **kw)

    def clone(self) -> UnionWithInput:
        return UnionWithInput(self.template.clone(), self.join_dim, self.to_dim, self.name, self.exact)


class GroupApply(Transform):
    """A clone of a transform for each value of one or more coordinates (few: sessions, subjects).

    Unseen groups: an error, or the average of all fitted clones' outputs, equal or by the groups' numbers of
    samples. Stateless templates need no fit. Where a template only adds keys to a window (``per_dim``), it is
    cheaper to name the coordinate there. Groups whose outputs differ in size along a dimension are an error, or
    cut to the first labels that all have (``cut_to_min``; the size is kept from the first output on).
    """

    def __init__(self, group_coord: str | Sequence[str], template: Transform, unseen_policy: str = "error", unequal_output_dims: str | None = None, sample_dim: str = "trial", **kw: Any):
        super().__init__(**kw)
        if unequal_output_dims not in (None, "error", "cut_to_min"):
            raise ValueError(f"unknown strategy {unequal_output_dims!r}")
        self.unequal_output_dims, self.min_sizes = unequal_output_dims, {}
        if unseen_policy not in ("error", "average", "weighted_average"):
            raise ValueError(f"unknown policy {unseen_policy!r}")
        self.group_coord, self.template, self.unseen_policy, self.sample_dim = group_coord, template, unseen_policy, sample_dim
        self.fitted: dict[tuple, Transform] = {}

    def _keys(self) -> list[str]:
        return [self.group_coord] if isinstance(self.group_coord, str) else list(self.group_coord)

    @property
    def is_stateful(self) -> bool:
        return self.template.is_stateful

    @property
    def is_predictor(self) -> bool:
        return self.template.is_predictor

    def _groups(self, frame: LabeledFrame) -> list[tuple]:
        return sorted(tuple(r) for r in frame.cells.select(*self._keys()).distinct().collect())

    def _of(self, frame: LabeledFrame, group: tuple) -> LabeledFrame:
        return frame.where(reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.lit(v)) for k, v in zip(self._keys(), group, strict=True))))

    def _fit(self, frame: LabeledFrame) -> None:
        keys = self._keys()
        self.sizes = {tuple(r[k] for k in keys): r["n"] for r in frame.cells.select(self.sample_dim, *keys).distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).collect()}
        self.fitted = {g: self.template.clone().fit(self._of(frame, g)) for g in sorted(self.sizes)}

    def _for(self, group: tuple) -> list[tuple[Transform, float]]:
        if not self.template.is_stateful:
            return [(self.template, 1.0)]
        if group in self.fitted:
            return [(self.fitted[group], 1.0)]
        if self.unseen_policy == "error" or not self.fitted:
            raise TransformError(f"group {group} was not fitted")
        raw = {g: (self.sizes[g] if self.unseen_policy == "weighted_average" else 1) for g in self.fitted}
        return [(t, raw[g] / sum(raw.values())) for g, t in self.fitted.items()]

    def _transform(self, frame: LabeledFrame) -> LabeledFrame:
        outs = []
        for g in self._groups(frame):
            own, parts = self._of(frame, g), self._for(g)
            made = [(t.transform(own), w) for t, w in parts]
            if len(made) == 1:
                outs.append(made[0][0])
                continue
            first = made[0][0]
            weighted = reduce(DataFrame.unionByName, [m.with_value(F.col(VALUE) * w).cells for m, w in made])
            outs.append(first.with_cells(weighted.groupBy(*first.dims, *first.coords).agg(F.sum(VALUE).alias(VALUE))))
        if not outs:
            return frame
        if self.unequal_output_dims:
            outs = self._evened(outs)
        return outs[0].with_cells(reduce(DataFrame.unionByName, [o.cells for o in outs]))

    def _evened(self, outs: list[LabeledFrame]) -> list[LabeledFrame]:
        for dim in outs[0].dims:
            if dim == self.sample_dim:
                continue
            labels = [o.label_list(dim) for o in outs]  # of a dimension other than the samples
            least = min(self.min_sizes.get(dim, len(labels[0])), *map(len, labels))
            if self.unequal_output_dims == "error" and len({len(x) for x in labels}) > 1:
                raise TransformError(f"groups give {[len(x) for x in labels]} labels of {dim}")
            self.min_sizes[dim] = least
            outs = [o if len(x) == least else o.where(F.col(dim).isin(x[:least])) for o, x in zip(outs, labels, strict=True)]
        return outs

    def predict(self, frame: LabeledFrame) -> DataFrame:
        return reduce(DataFrame.unionByName, [self._for(g)[0][0].predict(self._of(frame, g)) for g in self._groups(frame)])


@dataclass
class Member:
    name: str
    predictor: Any
    weight: float = 1.0


EPS = 1e-10


def entropy(p: str | Column) -> Column:
    """-sum p log(p + eps) of an array of probabilities."""
    return F.aggregate(F.transform(p, lambda x: -x * F.log(x + EPS)), F.lit(0.0), lambda a, x: a + x)


class Ensemble(Predictor):
    """Weighted members. Labels are voted (ties to the smallest), regressions averaged, probabilities summed.

    ``weighting``: ``uniform``, ``custom`` (the members' weights) or ``score_based`` (a score of each member's
    predictions on the fit data, clipped at zero; uniform if all are zero).
    """

    def __init__(self, members: Sequence, sample_dim: str = "trial", target_coord: Any = "stimulus", classes: list | None = None, weighting: str = "custom", scoring: Callable[[DataFrame, str], float] | None = None, normalize_weights: bool = True, normalize_outputs: bool = True, **kw: Any):
        super().__init__(sample_dim, target_coord, classes, **kw)
        self.members = [m if isinstance(m, Member) else Member(*m) for m in members]
        self.weighting, self.scoring, self.normalize_weights, self.normalize_outputs = weighting, scoring, normalize_weights, normalize_outputs
        if weighting == "score_based" and scoring is None:
            raise ValueError("score_based weights need a scoring function")
        self.weights = self._scaled([1.0 if weighting == "uniform" else m.weight for m in self.members])

    def clone(self) -> Ensemble:
        return Ensemble([Member(m.name, m.predictor.clone(), m.weight) for m in self.members], self.sample_dim, self.target_coord, self.classes, self.weighting, self.scoring, self.normalize_weights, self.normalize_outputs)

    def _scaled(self, weights: list[float]) -> list[float]:
        if not (total := sum(weights)):
            raise ValueError("the weights add up to zero")
        return [w / total for w in weights] if self.normalize_weights else weights

    @property
    def regression(self) -> bool:
        p = self.members[0].predictor
        return not (p.predictor if isinstance(p, Pipeline) else p).is_classifier

    def _learn(self, frame: LabeledFrame) -> None:
        for m in self.members:
            m.predictor.fit(frame)
        if self.weighting == "score_based":
            scores = [max(0.0, self.scoring(m.predictor.predict(frame), self.target_names(frame)[0])) for m in self.members]
            self.weights = self._scaled(scores if any(scores) else [1.0] * len(scores))

    def opinions(self, frame: LabeledFrame) -> DataFrame:
        """``(sample, coordinates, member, weight, prediction[, probability])``: all members' predictions."""
        parts = [m.predictor.predict(frame).withColumn("member", F.lit(m.name)).withColumn("weight", F.lit(float(w))) for m, w in zip(self.members, self.weights, strict=True)]
        shared = [c for c in parts[0].columns if all(c in p.columns for p in parts)]
        return reduce(DataFrame.unionByName, [p.select(*shared) for p in parts])

    def _predict(self, frame: LabeledFrame) -> DataFrame:
        keys = [self.sample_dim, *frame.coords_of(self.sample_dim)]
        return combine(self.opinions(frame), keys, self.regression, self.normalize_outputs)

    def predict_with_uncertainty(self, frame: LabeledFrame) -> DataFrame:
        return uncertainty(self.opinions(frame), [self.sample_dim, *frame.coords_of(self.sample_dim)])

    def predict_with_std(self, frame: LabeledFrame, stderr: bool = False) -> DataFrame:
        return spread(self.opinions(frame), [self.sample_dim, *frame.coords_of(self.sample_dim)], stderr)


def combine(opinions: DataFrame, keys: Sequence[str], regression: bool = False, normalize: bool = True) -> DataFrame:
    """Members' predictions to one per sample, with the summed probabilities if all give them."""
    keys = list(keys)
    if regression:
        return opinions.groupBy(*keys).agg((F.sum(F.col("weight") * F.col("prediction")) / F.sum("weight")).alias("prediction"))
    votes = opinions.groupBy(*keys, "prediction").agg(F.sum("weight").alias("_votes"))
    voted = votes.groupBy(*keys).agg(F.min(F.struct((-F.col("_votes")).alias("v"), "prediction")).alias("_best")).select(*keys, "_best.prediction")
    if "probability" not in opinions.columns:
        return voted
    return voted.join(mean_probability(opinions, keys, normalize), keys)


def mean_probability(opinions: DataFrame, keys: Sequence[str], normalize: bool = True) -> DataFrame:
    each = opinions.select(*keys, "weight", F.posexplode("probability").alias("_class", "_p"))
    summed = each.groupBy(*keys, "_class").agg(F.sum(F.col("weight") * F.col("_p")).alias("_p"))
    if normalize:
        total = F.sum("_p").over(Window.partitionBy(*keys))
        summed = summed.withColumn("_p", F.coalesce(F.try_divide("_p", total), F.lit(0.0)))
    return summed.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_class", "_p"))), lambda x: x["_p"]).alias("probability"))


def uncertainty(opinions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``aleatoric``: the weighted mean of members' entropies; ``epistemic``: the mean's entropy beyond that."""
    own = opinions.groupBy(*keys).agg((F.sum(F.col("weight") * entropy("probability")) / F.sum("weight")).alias("aleatoric"))
    mixed = mean_probability(opinions, keys)
    return mixed.join(own, list(keys)).select(*keys, "probability", "aleatoric", (entropy("probability") - F.col("aleatoric")).alias("epistemic"))


def spread(opinions: DataFrame, keys: Sequence[str], stderr: bool = False) -> DataFrame:
    """``(keys, class, mean, std)``: the unweighted mean and population deviation over members."""
    each = opinions.select(*keys, F.posexplode("probability").alias("class", "_p"))
    std = F.stddev_pop("_p") / F.sqrt(F.count(F.lit(1))) if stderr else F.stddev_pop("_p")
    return each.groupBy(*keys, "class").agg(F.avg("_p").alias("mean"), std.alias("std"))
