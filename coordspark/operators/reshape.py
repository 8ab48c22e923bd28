"""Order, names and nesting of dimensions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import replace
from typing import Any

from pyspark.sql import functions as F

from coordspark.frame import VALUE, LabeledFrame
from coordspark.operators.base import Transform


class Transpose(Transform):
    """The dimensions in another order; cells stay as they are."""

    def __init__(self, dims: Sequence[str], **kw: Any):
        super().__init__(**kw)
        self.dims = tuple(dims)

    def output_dims(self, dims: tuple[str, ...]) -> tuple[str, ...]:
        return self.dims

    def _transform(self, frame: LabeledFrame) -> LabeledFrame:
        if sorted(self.dims) != sorted(frame.dims):
            raise ValueError(f"{self.dims} is no order of {frame.dims}")
        return replace(frame, dims=self.dims)


class RenameDims(Transform):
    """Dimensions (or coordinates) under other names."""

    def __init__(self, names: Mapping[str, str], **kw: Any):
        super().__init__(**kw)
        self.names = dict(names)

    def output_dims(self, dims: tuple[str, ...]) -> tuple[str, ...]:
        return tuple(self.names.get(d, d) for d in dims)

    def _transform(self, frame: LabeledFrame) -> LabeledFrame:
        for n in self.names:
            frame.dim_of(n)
        new = lambda n: self.names.get(n, n)
        return replace(frame, cells=frame.cells.withColumnsRenamed(self.names), dims=tuple(map(new, frame.dims)), coords={new(c): new(d) for c, d in frame.coords.items()})


def flat_name(dims: Sequence[str]) -> str:
    return "flat_" + "__".join(dims)


class Flatten(Transform):
    """Two or more dimensions as one, last, of struct labels; struct order is C order."""

    def __init__(self, dims: Sequence[str], **kw: Any):
        super().__init__(**kw)
        self.dims = tuple(dims)
        if len(self.dims) < 2:
            raise ValueError("flatten two dimensions at least")

    def output_dims(self, dims: tuple[str, ...]) -> tuple[str, ...]:
        return (*(d for d in dims if d not in self.dims), flat_name(self.dims))

    def _transform(self, frame: LabeledFrame) -> LabeledFrame:
        frame.require(*self.dims)
        flat = flat_name(self.dims)
        cells = frame.cells.withColumn(flat, F.struct(*self.dims))
        return frame.with_cells(cells, self.output_dims(frame.dims))


class Unflatten(Transform):
    """The inverse of Flatten; combinations that had no cell have none again."""

    def __init__(self, dim: str, **kw: Any):
        super().__init__(**kw)
        self.dim = dim
        if not dim.startswith("flat_"):
            raise ValueError("a flattened dimension's name starts with flat_")

    def output_dims(self, dims: tuple[str, ...]) -> tuple[str, ...]:
        return (*(d for d in dims if d != self.dim), *self.dim.removeprefix("flat_").split("__"))

    def _transform(self, frame: LabeledFrame) -> LabeledFrame:
        frame.require(self.dim)
        names = frame.cells.schema[self.dim].dataType.names
        cells = frame.cells.select(*[c for c in frame.cells.columns if c not in (self.dim, VALUE)], *[F.col(f"{self.dim}.{n}").alias(n) for n in names], VALUE)
        return frame.with_cells(cells, (*(d for d in frame.dims if d != self.dim), *names))
