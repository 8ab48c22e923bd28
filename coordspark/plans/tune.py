"""Hyper-parameter search: seeded random or exhaustive trials over pipelines, each cross-validated.

What precedes the first tuned, switching or stateful step is the same in every trial: it runs once, persisted.
"""

from __future__ import annotations

import itertools
import math
import random
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from coordspark.frame import LabeledFrame
from coordspark.operators.base import TransformError
from coordspark.operators.compose import Composite, Pipeline, Switch
from coordspark.plans.cv import CrossValidator, Validator

_NUMERICAL = ("svd", "singular", "converge", "positive definite", "infs or nans", "ill-conditioned")


@dataclass(frozen=True)
class Space:
    """A list of choices, (int, int), (float, float) or ("log", low, high)."""

    kind: str
    values: tuple

    @classmethod
    def of(cls, spec: Any) -> Space:
        if isinstance(spec, list) and spec:
            return cls("choice", tuple(spec))
        if isinstance(spec, tuple) and len(spec) == 3 and spec[0] == "log":
            if not 0 < spec[1] < spec[2]:
                raise ValueError(f"a log range needs 0 < low < high: {spec}")
            return cls("log", spec[1:])
        if isinstance(spec, tuple) and len(spec) == 2 and all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in spec):
            if spec[0] > spec[1]:
                raise ValueError(f"low is above high: {spec}")
            return cls("int" if all(isinstance(x, int) for x in spec) else "float", spec)
        raise ValueError(f"no search space: {spec!r}")

    def draw(self, rng: random.Random) -> Any:
        if self.kind == "choice":
            return rng.choice(self.values)
        low, high = self.values
        if self.kind == "int":
            return rng.randint(low, high)
        return rng.uniform(low, high) if self.kind == "float" else math.exp(rng.uniform(math.log(low), math.log(high)))

    def holds(self, value: Any) -> bool:
        return value in self.values if self.kind == "choice" else isinstance(value, (int, float)) and self.values[0] <= value <= self.values[1]


@dataclass
class Trial:
    number: int
    pipeline: str
    params: dict[str, Any]
    score: float | None = None
    state: str = "running"
    error: str = ""


@dataclass
class Tuner:
    """``pipelines`` by name, ``param_grid`` as ``{pipeline: {step: {param: space}}}`` (or ``{step: ...}``)."""

    pipelines: Mapping[str, Pipeline]
    validator: Validator
    param_grid: Mapping[str, Mapping]
    frame: LabeledFrame
    scoring: str | Callable | None = None
    direction: str = "maximize"
    seed: int = 0
    sampler: str = "random"
    enqueue_initial: bool = True
    trials: list[Trial] = field(default_factory=list)

    def __post_init__(self) -> None:
        if not isinstance(self.pipelines, Mapping):
            self.pipelines = {p.name: p for p in ([self.pipelines] if isinstance(self.pipelines, Pipeline) else self.pipelines)}
        self.spaces = {name: self._spaces(name, p) for name, p in self.pipelines.items()}

    def _spaces(self, name: str, pipeline: Pipeline) -> dict[str, Space]:
        own = self.param_grid.get(name)
        by_pipeline = isinstance(own, Mapping) and all(isinstance(x, Mapping) for x in own.values())
        others = any(k in self.pipelines and k not in {s.name for s in pipeline.steps} for k in self.param_grid)
        grid = own if by_pipeline else {} if others else self.param_grid
        steps = {s.name: s.transform for s in pipeline.steps}
        spaces: dict[str, Space] = {}
        for step, params in grid.items():
            if step not in steps:
                raise AssertionError(f"pipeline {name} has no step {step!r}; it has {sorted(steps)}")
            for param, spec in params.items():
                if param.partition("__")[0] not in steps[step].get_params(deep=True) and not isinstance(steps[step], Composite):
                    raise ValueError(f"step {step} has no parameter {param!r}")
                target = steps[step]
                if isinstance(target, Switch) and param != "choose" and "__" not in param:
                    real = [c.name for c in target.choices if c.name != "identity"]
                    spaces[f"{step}__choose"] = Space("choice", tuple(real))
                    param = f"{real[0]}__{param}"
                spaces[f"{step}__{param}"] = Space.of(spec)
        for step, t in steps.items():
            if isinstance(t, Switch):
                spaces.setdefault(f"{step}__choose", Space("choice", tuple(c.name for c in t.choices)))
        return spaces

    def _initial(self, name: str) -> dict[str, Any]:
        now = self.pipelines[name].get_params(deep=True)
        found = {k: now[k] for k in self.spaces[name] if k in now and now[k] is not None}
        for k, v in found.items():
            if not self.spaces[name][k].holds(v):
                raise ValueError(f"the current value {v!r} of {k} lies outside its space")
        return found if len(found) == len(self.spaces[name]) else {}

    def _proposals(self, n_trials: int) -> list[tuple[str, dict[str, Any]]]:
        rng, names = random.Random(self.seed), list(self.pipelines)
        out = [(n, p) for n in names if self.enqueue_initial and (p := self._initial(n))]
        if self.sampler == "grid":
            for n in names:
                if any(s.kind != "choice" and s.kind != "int" for s in self.spaces[n].values()):
                    raise ValueError("a grid needs choices or int ranges")
                axes = [s.values if s.kind == "choice" else range(s.values[0], s.values[1] + 1) for s in self.spaces[n].values()]
                out += [(n, p) for x in itertools.product(*axes) if (n, p := dict(zip(self.spaces[n], x, strict=True))) not in out]
            return out[:n_trials]
        while len(out) < n_trials:
            n = rng.choice(names)
            out.append((n, {k: s.draw(rng) for k, s in self.spaces[n].items()}))
        return out[:n_trials]

    def _static(self, name: str) -> int:
        tuned = {k.partition("__")[0] for k in self.spaces[name]}
        steps = self.pipelines[name].steps
        return next((i for i, s in enumerate(steps) if s.name in tuned or s.transform.is_stateful or s.transform.is_predictor or isinstance(s.transform, Switch)), len(steps))

    def tune(self, n_trials: int = 50) -> Trial:
        """Runs the trials; numerical failures prune a trial, other errors are raised."""
        ready: dict[str, tuple[LabeledFrame, int]] = {}
        for i, (name, params) in enumerate(self._proposals(n_trials)):
            trial = Trial(i, name, params)
            self.trials.append(trial)
            if name not in ready:
                at = self._static(name)
                frame = Pipeline("static", self.pipelines[name].steps[:at]).transform(self.frame) if at else self.frame
                if at:
                    frame = LabeledFrame(frame.cells.persist(StorageLevel.MEMORY_AND_DISK), frame.dims, frame.coords, frame.attrs, frame.history)
                ready[name] = frame, at
            frame, at = ready[name]
            rest = Pipeline(name, self.pipelines[name].steps[at:]).clone()
            try:
                rest.set_params(**params)
                self._seeded(rest)
                trial.score, trial.state = CrossValidator(self.validator, self.scoring).cross_validate(rest, frame).score, "complete"
            except (TransformError, ArithmeticError, ValueError) as e:
                if not any(x in str(e).lower() for x in _NUMERICAL):
                    raise
                trial.state, trial.error = "pruned", str(e)[:300]
        return self.best_trial()

    def _seeded(self, pipeline: Pipeline) -> None:
        for s in pipeline.steps:
            if hasattr(s.transform, "set_seed"):
                s.transform.set_seed(self.seed)
            elif "random_state" in s.transform.get_params():
                s.transform.set_params(random_state=self.seed)

    def best_trial(self) -> Trial:
        done = [t for t in self.trials if t.state == "complete"]
        if not done:
            raise RuntimeError("no trial was completed")
        return (max if self.direction == "maximize" else min)(done, key=lambda t: t.score)

    def best_pipeline(self) -> Pipeline:
        best = self.best_trial()
        return self.pipelines[best.pipeline].clone().set_params(**best.params)

    def finalize_best_pipeline(self) -> Pipeline:
        return CrossValidator(self.validator, self.scoring).finalize(self.best_pipeline(), self.frame)

    def score_best_pipeline_on_holdout(self) -> float:
        cv = CrossValidator(self.validator, self.scoring)
        best = self.best_pipeline()
        cv.cross_validate(best, self.frame)
        return cv.score_on_holdout(best, self.frame)

    def runs(self, spark: SparkSession) -> DataFrame:
        """The trials as a table, for a store of runs."""
        rows = [(t.number, t.pipeline, {k: str(v) for k, v in t.params.items()}, t.score, t.state, t.error) for t in self.trials]
        return spark.createDataFrame(rows, "number int, pipeline string, params map<string,string>, score double, state string, error string")


def tune_over_seeds(pipelines: Any, make_validator: Callable[[int, Sequence], Validator], param_grid: Mapping, frame: LabeledFrame, n_seeds: int = 3, n_trials: int = 10, holdout_ids: Sequence = (), n_holdouts: int = 0, scoring: str | Callable | None = None) -> dict[str, Any]:
    """A tuner per seed, each with its own holdout groups; mean and standard error of the scores."""
    ids = list(holdout_ids)
    if n_holdouts * n_seeds > len(ids):
        raise ValueError(f"{n_seeds} seeds with {n_holdouts} holdouts each need {n_seeds * n_holdouts} ids, not {len(ids)}")
    random.Random(0).shuffle(ids)
    tuners, cv, held = [], [], []
    for seed in range(n_seeds):
        own = ids[seed * n_holdouts : (seed + 1) * n_holdouts]
        t = Tuner(pipelines, make_validator(seed, own), param_grid, frame, scoring, seed=seed)
        cv.append(t.tune(n_trials).score)
        if own:
            held.append(t.score_best_pipeline_on_holdout())
        tuners.append(t)

    def summary(x: list[float]) -> tuple[float, float]:
        m = sum(x) / len(x)
        return m, math.sqrt(sum((v - m) ** 2 for v in x) / max(len(x) - 1, 1) / len(x))

    return {"tuners": tuners, "cv": summary(cv), "holdout": summary(held) if held else None}
