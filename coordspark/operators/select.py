"""Selection: coordinate conditions, time crops, groups, functions of the value, frequency ranges."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from coordspark.frame import VALUE, LabeledFrame
from coordspark.operators.base import Transform

_COMPARE = {">": "gt", ">=": "ge", "<": "lt", "<=": "le"}


def condition(name: str, wanted: Any) -> Column:
    """A predicate on one coordinate: a value equals, a list holds, a pair bounds (both ends), a mapping of
    ``> >= < <= !=`` compares (``!=`` with a list excludes)."""
    c = F.col(name)
    if isinstance(wanted, Mapping):
        parts = []
        for op, x in wanted.items():
            if op == "!=":
                parts.append(~c.isin(list(x)) if isinstance(x, (list, tuple, set)) else c != F.lit(x))
            elif op in _COMPARE:
                parts.append(getattr(c, f"__{_COMPARE[op]}__")(F.lit(x)))
            else:
                raise ValueError(f"unknown comparison {op!r}")
        return reduce(lambda a, b: a & b, parts, F.lit(True))
    if isinstance(wanted, tuple):
        if len(wanted) != 2:
            raise ValueError("a range is a pair")
        return c.between(*wanted)
    if isinstance(wanted, list):
        return c.isin(wanted)
    return c == F.lit(wanted)


def by_conditions(frame: LabeledFrame, conditions: Mapping[str, Any]) -> LabeledFrame:
    """The cells whose coordinates meet every condition."""
    for name in conditions:
        frame.dim_of(name)
    return frame.where(reduce(lambda a, b: a & b, (condition(n, x) for n, x in conditions.items()), F.lit(True)))


def groups(frame: LabeledFrame, coord: str) -> list:
    """The distinct values of a coordinate, ascending."""
    return frame.label_list(coord)


def select_group(frame: LabeledFrame, coord: str, value: Any) -> LabeledFrame:
    frame.dim_of(coord)
    return frame.where(F.col(coord) == F.lit(value))


def signal_channels(dim: str = "channel", excluded: Sequence[str] = ()) -> Column:
    """True for channels that carry signal."""
    return ~F.col(dim).isin(list(excluded)) if excluded else F.lit(True)


def is_electrode(dim: str = "channel") -> Column:
    """Channels with a plain number for a name; others are auxiliary."""
    return F.col(dim).cast("string").rlike("^[0-9]+$")


class Identity(Transform):
    """The input itself."""

    keeps_shape = True

    def _transform(self, frame: LabeledFrame) -> LabeledFrame:
        return frame


class CropTime(Transform):
    """Cells whose time lies in [start, end]; an open end is None."""

    def __init__(self, start: float | None = None, end: float | None = None, time_dim: str = "time", **kw: Any):
        super().__init__(**kw)
        self.start, self.end, self.time_dim = start, end, time_dim

    def _transform(self, frame: LabeledFrame) -> LabeledFrame:
        return frame.where(frame.selected({self.time_dim: slice(self.start, self.end)}))


class Function(Transform):
    """A function of the value column, built-in or a pandas UDF; tried on two rows when it is given."""

    keeps_shape = True

    def __init__(self, func: Callable[[Column], Column], **kw: Any):
        super().__init__(**kw)
        self.func = func
        if (spark := SparkSession.getActiveSession()) is not None:
            probe = spark.range(2).select(func(F.col("id").cast("double")).alias(VALUE))
            if probe.schema[VALUE].dataType.typeName() not in ("double", "float", "integer", "long", "decimal", "boolean"):
                raise TypeError("the function must give a number for each value")

    def _transform(self, frame: LabeledFrame) -> LabeledFrame:
        return frame.map_value(self.func)


def freq_band_indices(freqs: Sequence[float], low: float, high: float) -> tuple[int, int]:
    """The half-open range of ascending ``freqs`` within [low, high]."""
    return bisect_left(freqs, low), bisect_right(freqs, high)


def remaining_freq_ranges(ranges: Mapping[str, tuple[float, float]], n: int, remove_high: bool = True) -> dict:
    """The ranges without the ``n`` highest (or lowest) by their order."""
    if not 0 <= n <= len(ranges):
        raise ValueError(f"can't remove {n} of {len(ranges)} ranges")
    items = list(ranges.items())
    return dict(items[: len(items) - n] if remove_high else items[n:])
