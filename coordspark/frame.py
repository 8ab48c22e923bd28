"""LabeledFrame: a labelled n-dimensional array as a table of cells.

One column per named dimension holds its label, ``value`` holds the cell and further columns hold auxiliary
coordinates, each of which hangs on one dimension. A missing cell is an absent row or a null, never NaN.
Everything is immutable: operations give a new frame over a new lazy plan.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

VALUE = "value"


@dataclass(frozen=True)
class LabeledFrame:
    """Cells, the order of the dimensions, auxiliary coordinates (name to dimension) and metadata."""

    cells: DataFrame
    dims: tuple[str, ...]
    coords: Mapping[str, str] = field(default_factory=dict)
    attrs: Mapping[str, Any] = field(default_factory=dict)
    history: tuple[dict, ...] = ()

    @classmethod
    def from_table(cls, df: DataFrame, dims: Sequence[str], value: str | Column = VALUE, coords: Mapping[str, str] | None = None, **attrs: Any) -> LabeledFrame:
        """Cells from a table with a row each. NaN becomes null."""
        coords = dict(coords or {})
        cell = (F.col(value) if isinstance(value, str) else value).cast("double")
        return cls(df.select(*dims, *coords, F.nullif(cell, F.lit(float("nan"))).alias(VALUE)), tuple(dims), coords, attrs)

    @classmethod
    def from_dense(cls, df: DataFrame, sample: str, array: str, dims: Mapping[str, int] | str = "feature", coords: Sequence[str] = (), **attrs: Any) -> LabeledFrame:
        """Cells from an array per sample, in C order over ``dims`` (name to size; one name for a flat array)."""
        at, value = F.posexplode(F.transform(array, lambda x: x.cast("double"))).alias("_at", VALUE), F.nullif(VALUE, F.lit(float("nan"))).alias(VALUE)
        flat = df.select(sample, *coords, at)
        if isinstance(dims, str):
            labels, names = [F.col("_at").alias(dims)], [dims]
        else:
            labels, names, inner = [], list(dims), 1
            for name in reversed(names):
                labels.insert(0, F.expr(f"cast((_at div {inner}) % {dims[name]} as int)").alias(name))
                inner *= dims[name]
        return cls(flat.select(sample, *coords, *labels, value), (sample, *names), dict.fromkeys(coords, sample), attrs)

    # -- structure -------------------------------------------------------------------------------------------

    def require(self, *dims: str) -> None:
        if lacking := [d for d in dims if d not in self.dims]:
            raise KeyError(f"no dimension {lacking}; the frame has {list(self.dims)}")

    def others(self, *dims: str) -> list[str]:
        self.require(*dims)
        return [d for d in self.dims if d not in dims]

    def coords_of(self, *dims: str) -> list[str]:
        """Auxiliary coordinates on the given dimensions."""
        return [c for c, d in self.coords.items() if d in dims]

    def dim_of(self, coord: str) -> str:
        """The dimension that a dimension or coordinate name stands on."""
        if coord in self.dims:
            return coord
        if coord not in self.coords:
            raise KeyError(f"no coordinate {coord!r}; the frame has {sorted(self.coords)}")
        return self.coords[coord]

    def with_cells(self, cells: DataFrame, dims: Sequence[str] | None = None, coords: Mapping[str, str] | None = None) -> LabeledFrame:
        dims = tuple(self.dims if dims is None else dims)
        coords = {c: d for c, d in (self.coords if coords is None else coords).items() if d in dims}
        return replace(self, cells=cells.select(*dims, *coords, VALUE), dims=dims, coords=coords)

    def with_value(self, value: Column) -> LabeledFrame:
        return replace(self, cells=self.cells.withColumn(VALUE, value))

    def logged(self, name: str, params: Mapping[str, Any]) -> LabeledFrame:
        return replace(self, history=(*self.history, {"class": name, "params": dict(params)}))

    def targets(self, spec: str | Iterable[str]) -> list[str]:
        """Coordinate names for a name, a list of names or a glob, whose matches are sorted."""
        if not isinstance(spec, str):
            return [t for s in spec for t in self.targets(s)]
        if "*" in spec:
            if not (found := sorted(c for c in self.coords if fnmatch.fnmatchcase(c, spec))):
                raise KeyError(f"no coordinate matches {spec!r}")
            return found
        self.dim_of(spec)
        return [spec]

    def labels(self, name: str) -> DataFrame:
        """``(name, pos)``: the distinct labels of a dimension or coordinate of a bounded size, in ascending order."""
        self.dim_of(name)
        distinct = self.cells.select(name).where(F.col(name).isNotNull()).distinct()
        return distinct.select(name, (F.row_number().over(Window.orderBy(name)) - 1).alias("pos"))

    def label_list(self, name: str) -> list:
        """The labels on the driver: for dimensions of a bounded size (channels, classes, groups), not samples."""
        return [r[0] for r in self.cells.select(name).where(F.col(name).isNotNull()).distinct().orderBy(name).collect()]

    def samples(self, sample: str) -> DataFrame:
        """A row for each label of ``sample``, with its coordinates."""
        self.require(sample)
        return self.cells.select(sample, *self.coords_of(sample)).distinct()

    # -- selection -------------------------------------------------------------------------------------------

    def where(self, condition: Column) -> LabeledFrame:
        return replace(self, cells=self.cells.where(condition))

    def _selected(self, dim: str, labels: Any) -> Column:
        column = F.col(dim)
        if isinstance(labels, slice):
            low = F.lit(True) if labels.start is None else column >= F.lit(labels.start)
            return low & (F.lit(True) if labels.stop is None else column <= F.lit(labels.stop))
        if isinstance(labels, (list, tuple, set, frozenset)):
            return column.isin(list(labels))
        return column == F.lit(labels)

    def selected(self, sel: Mapping[str, Any]) -> Column:
        """The predicate of ``{dim: label | list | slice}``; slices hold both ends."""
        self.require(*sel)
        found = F.lit(True)
        for dim, labels in sel.items():
            found = found & self._selected(dim, labels)
        return found

    def sel(self, sel: Mapping[str, Any], check: bool = True) -> LabeledFrame:
        """The cells with the given labels. A single label drops its dimension; a label that is absent raises
        KeyError (unless ``check`` is off, which saves a pass over the labels)."""
        if check:
            for dim, labels in sel.items():
                self.require(dim)
                if isinstance(labels, slice):
                    continue
                wanted = set(labels) if isinstance(labels, (list, tuple, set, frozenset)) else {labels}
                present = {r[0] for r in self.cells.where(F.col(dim).isin(list(wanted))).select(dim).distinct().collect()}
                if wanted - present:
                    raise KeyError(f"{dim} has no label {sorted(map(str, wanted - present))}")
        single = [d for d, x in sel.items() if not isinstance(x, (slice, list, tuple, set, frozenset))]
        return self.where(self.selected(sel)).with_cells_dropped(*single)

    def with_cells_dropped(self, *dims: str) -> LabeledFrame:
        kept = [d for d in self.dims if d not in dims]
        return self.with_cells(self.cells, kept) if dims else self

    def drop_sel(self, sel: Mapping[str, Any]) -> LabeledFrame:
        """All but the given labels of each dimension."""
        found = F.lit(True)
        for dim, labels in sel.items():
            self.require(dim)
            found = found & ~self._selected(dim, labels)
        return self.where(found)

    # -- layout ----------------------------------------------------------------------------------------------

    def grid(self, *dims: str) -> dict[str, list]:
        """The labels of dimensions of a bounded size, on the driver: what ``arrays`` are laid out by."""
        return {d: self.label_list(d) for d in dims}

    def dense(self, sample: str, features: Sequence[str] | None = None, name: str = "features", grid: Mapping[str, Sequence] | None = None) -> DataFrame:
        """A row per sample: its coordinates and an array over the other dimensions in label order."""
        return self.arrays([sample], list(features or self.others(sample)), name, grid)

    def arrays(self, keys: Sequence[str], features: Sequence[str], name: str = "features", grid: Mapping[str, Sequence] | None = None) -> DataFrame:
        """A row for each combination of ``keys``: their coordinates and an array over ``features``, in C order.

        Each label has its place: of ``grid`` (what a fit has seen), else of the frame's own labels. A missing cell
        is a null in its place, and a cell whose label the grid lacks an error.
        """
        held = [*keys, *self.coords_of(*keys)]
        rows, axes = self.cells, []
        for i, d in enumerate(features):
            if grid is None:  # a row, of a dimension of a bounded size
                labels = self.cells.select(d).where(F.col(d).isNotNull()).distinct()
                rows = rows.crossJoin(F.broadcast(labels.agg(F.array_sort(F.collect_set(d)).alias(f"_axis{i}"))))
                axes.append(F.first(f"_axis{i}"))
            else:
                axes.append(F.array(*map(F.lit, grid[d])).cast(ArrayType(self.cells.schema[d].dataType)))
        sizes, inner = [F.size(x) for x in axes], []
        for i in range(len(axes)):  # how many places a step along the axis is
            inner.append(reduce(lambda a, b: a * b, sizes[i + 1 :], F.lit(1)))
        at = lambda n, i: F.get(axes[i], (F.floor(n / inner[i]) % sizes[i]).cast("int")).alias(features[i])
        every = F.sequence(F.lit(0), inner[0] * sizes[0] - 1)
        places = F.transform(every, lambda n: F.struct(*[at(n, i) for i in range(len(axes))]))
        found = F.array_sort(F.collect_list(F.struct(F.struct(*features).alias("place"), VALUE)))
        own = F.transform(found, lambda x: x["place"])
        # a lookup in a map: Spark can't take a lambda within a lambda into the arguments of a Python function
        by_place = F.map_from_entries(found)
        spread = F.transform(places, lambda p: F.try_element_at(by_place, p))
        wrong = F.raise_error(F.lit(f"a label of {', '.join(features)} was not there before")).cast("array<double>")
        strange = F.size(F.array_except(own, places)) > 0
        laid = F.when(own == places, F.transform(found, lambda x: x[VALUE])).when(strange, wrong).otherwise(spread)
        return rows.groupBy(*held).agg(laid.alias(name))

    def complete(self, sample: str) -> LabeledFrame:
        """Every combination of a sample with the labels of the other dimensions, null where there is no cell."""
        rest = self.others(sample)
        grid = self.samples(sample)
        for d in rest:
            grid = grid.crossJoin(F.broadcast(self.cells.select(d, *self.coords_of(d)).distinct()))  # labels of a bounded dimension
        joined = grid.join(self.cells.select(*self.dims, VALUE), list(self.dims), "left")
        return self.with_cells(joined)

    def map_value(self, function: Callable[[Column], Column]) -> LabeledFrame:
        return self.with_value(function(F.col(VALUE)))
