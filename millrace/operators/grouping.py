"""Group-by aggregation and map-reduce over DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.aggregates import Spec, expressions

CHUNK = "_chunk_id"


def group_agg(df: DataFrame, by: str | Sequence[str], aggs: Sequence[Spec], where: Column | str | None = None, *, mean_counts_nulls: bool = False) -> DataFrame:
    """Filter, group and aggregate; the keys come first, then the aggregates in their order."""
    keys = [by] if isinstance(by, str) else list(by)
    if clash := {s[0] for s in aggs} & set(keys):
        raise ValueError(f"output names repeat keys: {sorted(clash)}")
    if mean_counts_nulls:
        aggs = [(n, "mean_all" if op == "mean" else op, c) for n, op, c in aggs]
    if where is not None:
        df = df.where(where)
    return df.groupBy(*keys).agg(*expressions(df, aggs)).select(*keys, *[s[0] for s in aggs])


def map_reduce(df: DataFrame, map: Callable, reduce: Callable[[DataFrame], DataFrame], *, scope: str = "global", schema: StructType | str | None = None, chunk: str = CHUNK) -> DataFrame:
    """``reduce(map(df))``.

    With scope "global" the map is a DataFrame function over everything. With "chunk" it is a pandas
    function that sees one chunk (rows of equal ``chunk`` column) at a time, for maps that depend on
    what lies together, such as a top-k or sample per file; ``schema`` then names its output.
    """
    if scope == "global":
        return reduce(map(df))
    if scope != "chunk":
        raise ValueError(f"unknown scope {scope!r}")
    if schema is None:
        raise ValueError("a chunk-scoped map needs the schema of its output")

    def apply(pdf: pd.DataFrame) -> pd.DataFrame:
        return map(pdf.drop(columns=[chunk]))

    return reduce(df.groupBy(chunk).applyInPandas(apply, schema))


def length(df: DataFrame, by: str | Sequence[str]) -> DataFrame:
    """Rows per group in column ``len``."""
    return df.groupBy(*([by] if isinstance(by, str) else by)).agg(F.count(F.lit(1)).alias("len"))
