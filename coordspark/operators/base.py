"""Contracts of transforms: parameters, cloning, selection, partial write-back, provenance."""

from __future__ import annotations

import copy
import inspect
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coordspark.frame import VALUE, LabeledFrame


class TransformError(RuntimeError):
    """A step of a pipeline failed; says which."""


class Parametrised:
    """Parameters are the constructor's arguments, kept in attributes of the same names."""

    @classmethod
    def _names(cls) -> list[str]:
        names = []
        for k in cls.__mro__:
            if "__init__" in k.__dict__:
                own = inspect.signature(k.__init__).parameters.values()
                names += [p.name for p in own if p.name != "self" and p.kind in (p.POSITIONAL_OR_KEYWORD, p.KEYWORD_ONLY) and p.name not in names]
                if not any(p.kind is p.VAR_KEYWORD for p in own):
                    break
        return names

    def get_params(self, deep: bool = False) -> dict[str, Any]:
        params = {n: getattr(self, n) for n in self._names()}
        if deep:
            for n, v in list(params.items()):
                if isinstance(v, Parametrised):
                    params |= {f"{n}__{k}": x for k, x in v.get_params(True).items()}
                elif isinstance(v, Mapping):
                    params |= {f"{n}__{k}": x for k, x in v.items()}
        return params

    def set_params(self, **params: Any) -> Parametrised:
        """``name`` or ``name__key`` of a nested object or mapping."""
        for name, value in params.items():
            own, _, rest = name.partition("__")
            if own not in self._names():
                raise ValueError(f"{type(self).__name__} has no parameter {own!r}")
            if not rest:
                setattr(self, own, value)
                continue
            held = getattr(self, own)
            if isinstance(held, Parametrised):
                held.set_params(**{rest: value})
            else:
                keys = {str(k): k for k in held or {}}
                setattr(self, own, {**(held or {}), keys.get(rest, rest): value})
        return self

    def clone(self) -> Parametrised:
        """A copy with the same parameters and no fitted state."""

        def fresh(v: Any) -> Any:
            if isinstance(v, Parametrised):
                return v.clone()
            if isinstance(v, list):
                return [fresh(x) for x in v]
            if isinstance(v, tuple):
                return tuple(fresh(x) for x in v)
            if isinstance(v, dict):
                return {k: fresh(x) for k, x in v.items()}
            return v if callable(v) else copy.copy(v)

        return type(self)(**{n: fresh(v) for n, v in self.get_params().items()})


class Transform(Parametrised):
    """``fit`` learns from a frame, ``transform`` gives a new one.

    ``sel`` / ``drop_sel`` narrow the input first. ``transform_sel`` / ``transform_drop_sel`` (where the shape
    is kept) fit and change a part of the cells and leave the others in place.
    """

    stateful = False
    keeps_shape = False
    input_dims: tuple[str, ...] | None = None

    def __init__(self, sel: Mapping | None = None, drop_sel: Mapping | None = None, transform_sel: Mapping | None = None, transform_drop_sel: Mapping | None = None):
        if transform_sel and transform_drop_sel:
            raise ValueError("give transform_sel or transform_drop_sel, not both")
        if (transform_sel or transform_drop_sel) and not self.keeps_shape:
            raise ValueError(f"{type(self).__name__} changes the shape and can't work on a part")
        self.sel, self.drop_sel, self.transform_sel, self.transform_drop_sel = sel, drop_sel, transform_sel, transform_drop_sel

    @property
    def is_stateful(self) -> bool:
        return self.stateful

    @property
    def is_predictor(self) -> bool:
        return False

    # What subclasses write.
    def _fit(self, frame: LabeledFrame) -> None:
        """Learn from the frame."""

    def _transform(self, frame: LabeledFrame) -> LabeledFrame:
        raise NotImplementedError

    def output_dims(self, dims: tuple[str, ...]) -> tuple[str, ...]:
        return dims

    # What callers use.
    def _narrowed(self, frame: LabeledFrame) -> LabeledFrame:
        if self.sel:
            frame = frame.sel(self.sel)
        return frame.drop_sel(self.drop_sel) if self.drop_sel else frame

    def _part(self, frame: LabeledFrame) -> Column | None:
        if self.transform_sel:
            return frame.selected(self.transform_sel)
        if self.transform_drop_sel:
            return ~frame.selected(self.transform_drop_sel)
        return None

    def _checked(self, frame: LabeledFrame) -> LabeledFrame:
        if self.input_dims and tuple(frame.dims) != tuple(self.input_dims):
            raise TransformError(f"{type(self).__name__} takes dims {self.input_dims}, not {frame.dims}")
        return self._narrowed(frame)

    def fit(self, frame: LabeledFrame) -> Transform:
        frame = self._checked(frame)
        part = self._part(frame)
        self._fit(frame if part is None else frame.where(part))
        return self

    def transform(self, frame: LabeledFrame) -> LabeledFrame:
        frame = self._checked(frame)
        part = self._part(frame)
        if part is None:
            out = self._transform(frame)
        else:
            out = frame.with_cells(self._transform(frame.where(part)).cells.unionByName(frame.where(~part | part.isNull()).cells))
        return out.logged(type(self).__name__, {k: v for k, v in self.get_params().items() if v is not None})

    def fit_transform(self, frame: LabeledFrame) -> LabeledFrame:
        if self.is_stateful:
            self.fit(frame)
        return self.transform(frame)

    def prepare_for_inference(self) -> Transform:
        return self


class Predictor(Transform):
    """Ends a pipeline: ``fit`` sees a target coordinate, ``predict`` gives a row per sample.

    Predictions are DataFrames ``(sample, its coordinates, prediction[, probability])``; classes are the
    ascending labels of the target, probabilities an array in their order.
    """

    stateful = True

    def __init__(self, sample_dim: str = "trial", target_coord: Any = "stimulus", classes: list | None = None, **kw: Any):
        super().__init__(**kw)
        self.sample_dim, self.target_coord, self.classes = sample_dim, target_coord, classes

    @property
    def is_predictor(self) -> bool:
        return True

    is_classifier = True

    def set_classes(self, classes: list) -> Predictor:
        """The vocabulary of labels, so that parts of the data agree on it."""
        self.classes = list(classes)
        return self

    #: Feature labels that the fit has seen.
    grid: dict[str, list] | None = None

    def features(self, frame: LabeledFrame) -> DataFrame:
        """``(sample, coordinates, features array)``, by the fitted labels; a missing cell is null."""
        return frame.dense(self.sample_dim, grid=self.grid)

    def target_names(self, frame: LabeledFrame) -> list[str]:
        return frame.targets(self.target_coord)

    def _fit(self, frame: LabeledFrame) -> None:
        if self.is_classifier and self.classes is None and len(self.target_names(frame)) == 1:
            self.classes = frame.label_list(self.target_names(frame)[0])
        self.grid = frame.grid(*frame.others(self.sample_dim))
        self._learn(frame)

    def _learn(self, frame: LabeledFrame) -> None:
        raise NotImplementedError

    def _predict(self, frame: LabeledFrame) -> DataFrame:
        raise NotImplementedError

    def predict(self, frame: LabeledFrame) -> DataFrame:
        return self._predict(self._checked(frame))

    def predict_proba(self, frame: LabeledFrame) -> DataFrame:
        out = self.predict(frame)
        if "probability" not in out.columns:
            raise TransformError(f"{type(self).__name__} has no probabilities")
        return out

    def _transform(self, frame: LabeledFrame) -> LabeledFrame:
        """Class probabilities (sample, class), or the prediction (sample, prediction)."""
        out = self._predict(frame)
        coords = frame.coords_of(self.sample_dim)
        if "probability" in out.columns:
            cells = out.select(self.sample_dim, *coords, F.posexplode("probability").alias("class", VALUE))
            return frame.with_cells(cells, (self.sample_dim, "class"), dict.fromkeys(coords, self.sample_dim))
        cells = out.select(self.sample_dim, *coords, F.lit(0).alias("prediction_index"), F.col("prediction").cast("double").alias(VALUE))
        return frame.with_cells(cells, (self.sample_dim, "prediction_index"), dict.fromkeys(coords, self.sample_dim))
