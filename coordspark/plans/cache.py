"""Results kept by the meaning of their plan: a frame's semantic hash, a transform's class and its parameters.

Data and fitted state are kept together, so a hit never leaves a transform unfitted.
"""

from __future__ import annotations

import hashlib
import inspect
import json
from collections import OrderedDict
from typing import Any

from pyspark import StorageLevel

from coordspark.frame import LabeledFrame
from coordspark.operators.base import Transform


def hash_dict(d: Any) -> str:
    return hashlib.md5(json.dumps(d, sort_keys=True, default=repr).encode()).hexdigest()


def code_hash(obj: Any) -> str:
    """Of the source of an object's class and its bases, so that changed code misses."""
    parts = []
    for k in type(obj).__mro__:
        try:
            parts.append(inspect.getsource(k))
        except (OSError, TypeError):
            parts.append(k.__qualname__)
    return hashlib.md5("".join(parts).encode()).hexdigest()


class ResultCache:
    """Keeps up to ``limit`` persisted results, the least recently used goes first."""

    def __init__(self, limit: int = 32):
        self.limit, self.held = limit, OrderedDict()

    def key(self, transform: Transform, frame: LabeledFrame) -> tuple:
        return frame.cells.semanticHash(), frame.dims, type(transform).__qualname__, code_hash(transform), hash_dict(transform.get_params(True))

    def fit_transform(self, transform: Transform, frame: LabeledFrame) -> tuple[Transform, LabeledFrame]:
        """The fitted transform and its output."""
        key = self.key(transform, frame)
        if (found := self.held.get(key)) and found[2].sameSemantics(frame.cells):
            self.held.move_to_end(key)
            return found[0], found[1]
        fitted = transform.clone()
        out = fitted.fit_transform(frame)
        out = LabeledFrame(out.cells.persist(StorageLevel.MEMORY_AND_DISK), out.dims, out.coords, out.attrs, out.history)
        self.held[key] = fitted, out, frame.cells
        while len(self.held) > self.limit:
            self.held.popitem(last=False)[1][1].cells.unpersist()
        return fitted, out

    def clear(self) -> None:
        for _, out, _ in self.held.values():
            out.cells.unpersist()
        self.held.clear()
