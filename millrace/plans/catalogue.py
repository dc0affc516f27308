"""The registered queries of the core engine, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import grouping, relational
from . import chunks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
SIZES = (3, 30, 5, 50, 8, 80, 12)
PACK_TARGET = 1000.0


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Sums of doubles depend on their order in the last digits; results are compared rounded."""
    return df.withColumns({c: F.round(c, 2) for c in columns})


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice), 2) AS revenue, min(l_quantity) AS least, max(l_quantity) AS most, round(avg(l_discount), 4) AS discount FROM lineitem WHERE l_quantity > 25 GROUP BY ALL")
def agg_by_returnflag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: filter, two keys, all five aggregates in one partial and one final pass."""
    aggs = [("n", "count", None), ("revenue", "sum", "l_extendedprice"), ("least", "min", "l_quantity"), ("most", "max", "l_quantity"), ("discount", "mean", "l_discount")]
    out = grouping.group_agg(read(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], aggs, F.col("l_quantity") > 25)
    return rounded(out, "revenue").withColumn("discount", F.round("discount", 4))


@query("SELECT event_type, min(value) AS least, max(value) AS most FROM events GROUP BY event_type")
def agg_min_max_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.group_agg(read(spark, sf_dir, "events"), "event_type", [("least", "min", "value"), ("most", "max", "value")])


@query("SELECT user_id, count(*) AS hits, round(sum(value), 2) AS spend, round(avg(value), 2) AS mean FROM events WHERE value > 10 GROUP BY user_id")
def agg_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = grouping.group_agg(read(spark, sf_dir, "events"), "user_id", [("hits", "count", None), ("spend", "sum", "value"), ("mean", "mean", "value")], "value > 10")
    return rounded(out, "spend", "mean")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def count_ignores_col(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.group_agg(read(spark, sf_dir, "events"), "event_type", [("n", "count", "value")])


@query("SELECT event_type, user_id % 7 AS part, round(sum(CASE WHEN value > 20 THEN value END) / count(*), 3) AS mean FROM events GROUP BY ALL")
def mean_over_all_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean whose denominator is all rows, nulls included."""
    df = read(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 7).alias("part"), F.when(F.col("value") > 20, F.col("value")).alias("v"))
    return grouping.group_agg(df, ["event_type", "part"], [("mean", "mean", "v")], mean_counts_nulls=True).withColumn("mean", F.round("mean", 3))


@query("SELECT user_id, count(*) AS len FROM events WHERE event_type = 'error' GROUP BY user_id ORDER BY len DESC")
def mr_filter_len_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.map_reduce(read(spark, sf_dir, "events"), lambda df: df.where("event_type = 'error'"), lambda df: relational.sort(grouping.length(df, "user_id"), "len", descending=True))


@query("SELECT o_orderstatus, round(sum(o_totalprice), 2) AS spend FROM orders GROUP BY o_orderstatus ORDER BY spend DESC")
def mr_region_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partials per day summed again: one exchange per level, both map-side combined."""
    def per_day(df: DataFrame) -> DataFrame:
        return grouping.group_agg(df, ["o_orderstatus", "o_orderdate"], [("s", "sum", "o_totalprice")])

    def total(df: DataFrame) -> DataFrame:
        return relational.sort(rounded(grouping.group_agg(df, "o_orderstatus", [("spend", "sum", "s")]), "spend"), "spend", descending=True)

    return grouping.map_reduce(read(spark, sf_dir, "orders"), per_day, total)


@query("SELECT month, o_orderkey, o_totalprice FROM (SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY strftime(o_orderdate, '%Y-%m') ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r = 1 ORDER BY o_totalprice DESC, o_orderkey LIMIT 5")
def mr_chunk_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map that must see whole chunks: each month's top order, then the top five of those."""
    df = read(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("_chunk_id"), F.date_format("o_orderdate", "yyyy-MM").alias("month"), "o_orderkey", "o_totalprice")
    top = lambda pdf: pdf.sort_values(["o_totalprice", "o_orderkey"], ascending=[False, True]).head(1)
    return grouping.map_reduce(df, top, lambda d: d.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(5), scope="chunk", schema="month string, o_orderkey long, o_totalprice double")


_SIZES_SQL = ", ".join(f"({i}, {n})" for i, n in enumerate(SIZES))


@query(f"SELECT count(*) AS count, CAST(sum(((i * 7) % 13) * 2) AS BIGINT) AS sum_f FROM (SELECT unnest(range(n)) AS i FROM (VALUES {_SIZES_SQL}) t(d, n))")
def fan_out_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows generated per day, a feature each, folded to one row."""
    days = spark.createDataFrame(list(enumerate(SIZES)), "day int, n int")
    rows = relational.repeat_rows(days, "n", "i").withColumn("f", (F.col("i") * 7) % 13 * 2)
    return rows.agg(F.count(F.lit(1)).alias("count"), F.sum("f").alias("sum_f"))


def months(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = read(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("weight"))
    return by.withColumn("ordinal", (F.row_number().over(Window.orderBy("month")) - 1).cast("int"))  # a row per month


_MONTHS_SQL = "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS weight FROM orders GROUP BY 1"


@query(
    f"""WITH RECURSIVE m AS (SELECT month, weight, row_number() OVER (ORDER BY month) AS i FROM ({_MONTHS_SQL})),
f(i, month, weight, chunk, used) AS (SELECT i, month, weight, 0, weight FROM m WHERE i = 1 UNION ALL
SELECT m.i, m.month, m.weight, CASE WHEN f.used + m.weight > {PACK_TARGET} THEN f.chunk + 1 ELSE f.chunk END, CASE WHEN f.used + m.weight > {PACK_TARGET} THEN m.weight ELSE f.used + m.weight END FROM f JOIN m ON m.i = f.i + 1)
SELECT chunk, count(*) AS members, CAST(sum(weight) AS BIGINT) AS weight FROM f GROUP BY chunk"""
)
def pack_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months packed in order to a weight target; a plan's rows, not the data's."""
    packed = chunks.pack_frame(months(spark, sf_dir), "weight", PACK_TARGET)
    return packed.groupBy("chunk").agg(F.count(F.lit(1)).alias("members"), F.sum("weight").alias("weight"))


@query(f"SELECT month, weight, row_number() OVER (ORDER BY weight DESC, month) AS place FROM ({_MONTHS_SQL})")
def heaviest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = months(spark, sf_dir)
    return m.select("month", "weight", F.row_number().over(Window.orderBy(F.desc("weight"), "month")).cast("long").alias("place"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS chunk, o_totalprice * 2 AS f FROM orders")
def one_to_one_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM").alias("chunk"), (F.col("o_totalprice") * 2).alias("f"))


@query("SELECT event_type, value FROM events WHERE event_type = 'error' UNION ALL SELECT event_type, value FROM events WHERE value > 50")
def union_partials(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("event_type", "value")
    return relational.concat([e.where("event_type = 'error'"), e.where("value > 50")])


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def pending_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The resume step: planned keys that no finished row matches."""
    done = read(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return relational.pending(read(spark, sf_dir, "customer").select("c_custkey"), done, ["c_custkey"])


@query("SELECT o_orderpriority AS stage, o_orderstatus AS state, count(*) AS n FROM orders GROUP BY ALL")
def state_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.state_histogram(read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("stage"), F.col("o_orderstatus").alias("state")))


@query("SELECT o_custkey, arg_max(o_orderkey, o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey")
def latest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest row wins, as the status view reads its table."""
    return relational.latest(read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_orderkey").alias("seq")), ["o_custkey"], "seq").select("o_custkey", "o_orderkey")


@query("SELECT r_name FROM region WHERE r_regionkey <> 1 UNION ALL SELECT n_name FROM nation WHERE n_regionkey = 1")
def replace_in_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One entry of a manifest gives way to its parts."""
    region, nation = read(spark, sf_dir, "region"), read(spark, sf_dir, "nation")
    new = nation.where("n_regionkey = 1").select(F.lit(-1).alias("r_regionkey"), F.col("n_name").alias("r_name"))
    return relational.replace(region.select("r_regionkey", "r_name"), F.col("r_regionkey") == 1, new).select("r_name")


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def window_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming roll-up over a batch: days of event time."""
    from ..streaming.rollup import window_agg

    out = window_agg(read(spark, sf_dir, "events"), "ts", "1 day", ["event_type"], [("n", "count", None), ("total", "sum", "value")])
    return rounded(out.select(F.col("window_start").cast("timestamp_ntz").alias("day"), "event_type", "n", "total"), "total")
