"""Combinable aggregates: (output name, operation, column) triples to Spark expressions.

Catalyst splits each into a partial and a final step, so nothing here is decomposed by hand.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Spec = tuple[str, str, str | None]


def _number(df: DataFrame, name: str) -> Column:
    """The column, with NaN as null in floating columns: extremes ignore NaN."""
    c = F.col(name)
    return F.when(~F.isnan(c), c) if dict(df.dtypes).get(name) in ("float", "double") else c


def _sum(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.sum(name), F.lit(0).cast(df.select(F.sum(name)).schema[0].dataType))


def _extreme(fn: Callable[[Column], Column]) -> Callable[[DataFrame, str], Column]:
    def build(df: DataFrame, name: str) -> Column:
        # all-NaN groups stay NaN, all-null groups null
        return F.coalesce(fn(_number(df, name)), fn(F.col(name)))

    return build


OPERATIONS: dict[str, Callable[[DataFrame, str], Column]] = {
    "sum": _sum,  # 0 for groups without values
    "min": _extreme(F.min),
    "max": _extreme(F.max),
    "count": lambda df, name: F.count(F.lit(1)),  # rows, whatever the column
    "mean": lambda df, name: F.avg(name),
    "mean_all": lambda df, name: F.coalesce(F.sum(name), F.lit(0)) / F.count(F.lit(1)),  # nulls count as rows
}


def expressions(df: DataFrame, specs: Sequence[Spec]) -> list[Column]:
    names = [s[0] for s in specs]
    if len(set(names)) != len(names):
        raise ValueError(f"output names repeat: {names}")
    out = []
    for name, op, column in specs:
        if op not in OPERATIONS:
            raise ValueError(f"unknown aggregate {op!r}; allowed: {', '.join(sorted(OPERATIONS))}")
        if column is None and op != "count":
            raise ValueError(f"aggregate {op!r} needs a column")
        out.append(OPERATIONS[op](df, column or "").alias(name))
    return out
