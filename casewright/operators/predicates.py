"""Constraint trees: nested ``[(field, op, value), 'OR', [...]]`` lists compiled to one Column."""

from __future__ import annotations

import operator
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_OPS: dict[str, Callable[[Column, object], Column]] = {
    "=": operator.eq,
    "!=": operator.ne,
    "<": operator.lt,
    "<=": operator.le,
    ">": operator.gt,
    ">=": operator.ge,
    "LIKE": lambda c, v: c.like(v),
    "IN": lambda c, v: c.isin(list(v)),
}


def compile_constraints(tree: list | tuple) -> Column:
    """A tuple is a leaf; a list joins its members by the one connective it holds (AND if none).

    Raises ValueError for an empty list, an unknown operator or mixed connectives.
    """
    if isinstance(tree, tuple):
        field, op, value = tree
        if op.upper() not in _OPS:
            raise ValueError(f"unknown operator {op!r}")
        return _OPS[op.upper()](F.col(field), value)
    words = {x.upper() for x in tree if isinstance(x, str)}
    parts = [compile_constraints(x) for x in tree if not isinstance(x, str)]
    if not parts or len(words) > 1 or words - {"AND", "OR"}:
        raise ValueError(f"not a constraint tree: {tree!r}")
    joined = parts[0]
    for part in parts[1:]:
        joined = joined | part if words == {"OR"} else joined & part
    return joined
