"""Constant arrays as one parsed literal expression."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(value) -> str:
    if isinstance(value, (list, tuple)):
        return "array(" + ",".join(_text(v) for v in value) + ")"
    if isinstance(value, float):
        return f"{value!r}D"
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return repr(int(value))


def const_array(values: Sequence, element: str | None = None) -> Column:
    """A foldable array column; `element` is a Spark type such as `bigint`."""
    text = _text(list(values))
    return F.expr(f"CAST({text} AS array<{element}>)" if element else text)


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and use it in `body`.

    Adjacent projections are merged by the optimiser, which would copy an array
    expression into the inner function of a transform and evaluate it for every
    element. As the variable of an outer function it is computed once per row.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
