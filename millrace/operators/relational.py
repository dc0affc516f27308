"""Small relational operators the pipeline layer and its users share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def concat(frames: list[DataFrame]) -> DataFrame:
    """Bag union of frames that must agree in names and types (order is free)."""
    if not frames:
        raise ValueError("nothing to concatenate")
    first = {f.name: f.dataType for f in frames[0].schema}
    for other in frames[1:]:
        if {f.name: f.dataType for f in other.schema} != first:
            raise ValueError(f"schemas differ: {frames[0].schema.simpleString()} and {other.schema.simpleString()}")
    return reduce(DataFrame.unionByName, frames)


def sort(df: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """Order by a column, nulls first either way."""
    return df.orderBy(F.desc_nulls_first(column) if descending else F.asc_nulls_first(column))


def heaviest_first(df: DataFrame, weight: str, tie: str) -> DataFrame:
    """Order by falling weight; ``tie`` keeps the order of equals."""
    return df.orderBy(F.desc(weight), F.asc(tie))


def repeat_rows(df: DataFrame, times: str, index: str) -> DataFrame:
    """Each row ``times`` times, numbered from 0 in ``index``; none for counts below 1."""
    return df.where(F.col(times) > 0).withColumn(index, F.explode(F.sequence(F.lit(0), F.col(times) - 1)))


def pending(plan: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the plan that no finished row matches."""
    return plan.join(done.select(*keys).distinct(), keys, "left_anti")


def replace(manifest: DataFrame, old: Column, new: DataFrame) -> DataFrame:
    """The manifest without the rows ``old`` selects, and with ``new``."""
    return manifest.where(~old).unionByName(new)


def state_histogram(status: DataFrame) -> DataFrame:
    """Rows by stage and state."""
    return status.groupBy("stage", "state").agg(F.count(F.lit(1)).alias("n"))


def latest(status: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of each key the row greatest in ``order``: one partial aggregation, no sort."""
    rest = [c for c in status.columns if c not in keys]
    best = status.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("x"))
    return best.select(*keys, "x.*")


def peer_stats(status: DataFrame) -> DataFrame:
    """Finished chunks and their greatest peak memory, by stage."""
    return status.where("state = 'success'").groupBy("stage").agg(F.count(F.lit(1)).alias("n"), F.max("peak_mem_mb").alias("max_peak_mem_mb"))
