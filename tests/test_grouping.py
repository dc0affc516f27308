import math

import pytest
from pyspark.sql import functions as F

from millrace.operators import grouping, relational


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def frame(spark):
    data = [("A", 1.0, 1), ("A", None, 2), ("B", math.nan, 3), ("B", 4.0, None), ("C", None, None)]
    return spark.createDataFrame(data, "k string, v double, n int")


def test_all_aggregates_and_order(frame):
    out = grouping.group_agg(frame, "k", [("s", "sum", "n"), ("lo", "min", "v"), ("hi", "max", "v"), ("c", "count", "v"), ("m", "mean", "n")])
    assert out.columns == ["k", "s", "lo", "hi", "c", "m"]
    assert rows(out) == [("A", 3, 1.0, 1.0, 2, 1.5), ("B", 3, 4.0, 4.0, 2, 3.0), ("C", 0, None, None, 1, None)]


def test_mean_over_nulls_is_optional(frame):
    assert rows(grouping.group_agg(frame.where("k = 'A'"), "k", [("m", "mean", "v")])) == [("A", 1.0)]
    assert rows(grouping.group_agg(frame.where("k = 'A'"), "k", [("m", "mean", "v")], mean_counts_nulls=True)) == [("A", 0.5)]


def test_filter_drops_nulls_and_keys_may_be_many(frame):
    assert rows(grouping.group_agg(frame, ["k", "n"], [("c", "count", None)], "n > 1")) == [("A", 2, 1), ("B", 3, 1)]


def test_empty_input_gives_no_rows(frame):
    assert grouping.group_agg(frame.where("false"), "k", [("s", "sum", "n")]).count() == 0


@pytest.mark.parametrize("aggs", [[("x", "median", "v")], [("x", "sum", "v"), ("x", "min", "v")], [("k", "sum", "v")], [("x", "sum", None)]])
def test_bad_specs(frame, aggs):
    with pytest.raises(ValueError):
        grouping.group_agg(frame, "k", aggs)


def test_plan_is_partial_exchange_final(frame):
    plan = grouping.group_agg(frame, "k", [("s", "sum", "n")])._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan and plan.count("Exchange") == 1


def test_map_reduce_scopes(spark):
    df = spark.createDataFrame([("f0", 1), ("f0", 9), ("f1", 5), ("f1", 7)], "_chunk_id string, v int")
    top = grouping.map_reduce(df, lambda p: p.nlargest(1, "v"), lambda d: d.agg(F.sum("v").alias("s")), scope="chunk", schema="v int")
    assert rows(top) == [(16,)]
    assert rows(grouping.map_reduce(df, lambda d: d.where("v > 5"), lambda d: d.agg(F.sum("v").alias("s")))) == [(16,)]
    with pytest.raises(ValueError):
        grouping.map_reduce(df, lambda p: p, lambda d: d, scope="chunk")


def test_relational_helpers(spark):
    a = spark.createDataFrame([("x", 2), ("y", None), ("z", 3)], "k string, n int")
    assert [r.n for r in relational.sort(a, "n", descending=True).collect()] == [None, 3, 2]
    assert relational.concat([a, a.select("n", "k")]).count() == 6
    with pytest.raises(ValueError):
        relational.concat([a, a.withColumnRenamed("n", "m")])
    assert rows(relational.repeat_rows(spark.createDataFrame([("p", 2), ("q", 0), ("r", -1)], "k string, t int"), "t", "i").select("k", "i")) == [("p", 0), ("p", 1)]
    assert rows(relational.pending(a, a.where("n = 2"), ["k"]).select("k")) == [("y",), ("z",)]
    s = spark.createDataFrame([("g", "1", "failed", 1, 5.0), ("g", "1", "success", 2, 9.0), ("g", "2", "success", 1, 7.0)], "stage string, key string, state string, seq int, peak_mem_mb double")
    last = relational.latest(s, ["key"], "seq")
    assert rows(relational.state_histogram(last)) == [("g", "success", 2)]
    assert rows(relational.peer_stats(last)) == [("g", 2, 9.0)]
