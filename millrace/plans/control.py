"""Registered queries that run whole pipelines: real plans, stages, failures and remedies over the tables.

Each builds a pipeline in a folder of its own under the shared one, runs it, and returns what a user
would read: a stage's output, the snapshot, or the status table.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..agents import Remediation
from ..operators import relational
from .catalogue import query, read
from .pipeline import Config, Pipeline, Source, groupby_agg, map_reduce, parquet_source
from .runner import Runner, SmokeFailed


def root(spark: SparkSession) -> str:
    """A new folder for a run's data, shared where the cluster names one."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{(shared or tempfile.mkdtemp(prefix='millrace-')).rstrip('/')}/runs/{uuid.uuid4().hex}"


def pipeline(spark: SparkSession, name: str, **config) -> Pipeline:
    return Pipeline(name, Config(root=root(spark), **{"max_redeliveries": 0, **config}))


def nations(spark: SparkSession, sf_dir: str, pipe: Pipeline, **options) -> Source:
    """One chunk per nation, as heavy as its name is long: plan rows, so they are listed on the driver."""
    rows = read(spark, sf_dir, "nation").orderBy("n_nationkey").collect()
    chunks = [{"id": f"n{r.n_nationkey:02d}", "params": {"nation": r.n_nationkey, "name": r.n_name, "region": r.n_regionkey}, "weight": float(len(r.n_name))} for r in rows]
    return pipe.source("nations", enumerate=lambda cfg, **_: chunks, **options)


@query("SELECT CAST(n_nationkey AS BIGINT) AS nation, n_name AS name, i, i * n_regionkey AS v FROM nation, (SELECT unnest(range(4)) AS i)")
def run_reader_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An enumerated source whose reader expands each member, and a stage of one chunk per member."""
    pipe = pipeline(spark, "reader")
    src = nations(spark, sf_dir, pipe, reader=lambda cfg, p: [{"nation": p["nation"], "name": p["name"], "i": i, "v": i * p["region"]} for i in range(4)])

    @pipe.stage(src, schema="nation long, name string, i long, v long")
    def rows(ctx):
        ctx.write(ctx.input())

    run = Runner(pipe, spark)
    run.run()
    return run.output(rows).drop("_chunk_id")


@query("SELECT n_regionkey AS region, count(*) AS n, CAST(sum(length(n_name)) AS BIGINT) AS letters, DATE '2024-01-01' + CAST(n_regionkey AS INTEGER) AS day FROM nation GROUP BY n_regionkey")
def run_packed_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members packed by weight, typed partial records per chunk, and one chunk that folds them all."""
    import datetime

    pipe = pipeline(spark, "packed")
    src = nations(spark, sf_dir, pipe)

    @pipe.stage(src, target_rows=40)
    def partial(ctx):
        by = {}
        for m in ctx.members:
            n, letters = by.get(m["region"], (0, 0))
            by[m["region"]] = n + 1, letters + len(m["name"])
        ctx.write([{"region": r, "n": n, "letters": x, "day": datetime.date(2024, 1, 1) + datetime.timedelta(days=r)} for r, (n, x) in by.items()])

    @pipe.stage(partial, target_rows=10**15, schema="region int, n long, letters long, day date")
    def fold(ctx):
        df = ctx.input_df()
        ctx.write(df.groupby(["region", "day"], as_index=False)[["n", "letters"]].sum()[["region", "n", "letters", "day"]])

    run = Runner(pipe, spark)
    run.run()
    return run.output(fold).drop("_chunk_id")


def counts(spark: SparkSession, snapshot: dict) -> DataFrame:
    rows = [(s["name"], state, n) for s in snapshot["stages"] for state, n in s["counts"].items()]
    return spark.createDataFrame(rows, "stage string, state string, n long")


@query("SELECT run, stage, CASE run WHEN 1 THEN 'success' WHEN 2 THEN 'skipped' ELSE CASE stage WHEN 'one' THEN 'skipped' ELSE 'success' END END AS state, count(*) AS n FROM nation, (VALUES (1), (2), (3)) r(run), (VALUES ('one'), ('two')) s(stage) GROUP BY ALL")
def run_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run, the same again, and one with a changed second stage: which chunks were done anew."""
    pipe = pipeline(spark, "resume")
    src = nations(spark, sf_dir, pipe)
    pipe.stage(src, name="one")(lambda ctx: ctx.write({"v": ctx.members[0]["nation"]}))
    first = lambda ctx: ctx.write([{"v": r["v"] + 1} for r in ctx.input()])
    pipe.stage(pipe.stages["one"], name="two")(first)
    runs = [counts(spark, Runner(pipe, spark).run()), counts(spark, Runner(pipe, spark).run())]
    pipe.stages["two"].fn = lambda ctx: ctx.write([{"v": r["v"] + 2} for r in ctx.input()])
    runs.append(counts(spark, Runner(pipe, spark).run()))
    return relational.concat([df.withColumn("run", F.lit(i)) for i, df in enumerate(runs, 1)]).select("run", "stage", "state", "n")


def out_of_memory(ctx) -> None:
    """A stage that can take one member at a time."""
    if len(ctx.members) > 1:
        raise MemoryError("more than one member")
    ctx.write({"nation": ctx.members[0]["nation"], "letters": len(ctx.members[0]["name"])})


@query("SELECT CAST(n_nationkey AS BIGINT) AS nation, length(n_name) AS letters FROM nation")
def run_resplit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed chunks run out of memory; the heuristic splits them to their members."""
    pipe = pipeline(spark, "resplit", failure_policy="remediate")
    st = pipe.stage(nations(spark, sf_dir, pipe), name="gen", target_rows=40, schema="nation long, letters long")(out_of_memory)
    run = Runner(pipe, spark, smoke=False)
    run.run()
    return run.output(st).drop("_chunk_id")


def no_third_region(ctx) -> None:
    if ctx.members[0]["region"] == 3:
        raise ValueError("no such region")
    ctx.write({"nation": ctx.members[0]["nation"]})


@query("SELECT CASE n_regionkey WHEN 3 THEN 'skipped' ELSE 'success' END AS state, CAST(CASE n_regionkey WHEN 3 THEN NULL ELSE 1 END AS BIGINT) AS records, count(*) AS n FROM nation GROUP BY ALL")
def run_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that always fail are skipped; the status table's latest rows say what became of each."""
    pipe = pipeline(spark, "skip", failure_policy="remediate", failure_handler=lambda e, t: Remediation("skip"))
    pipe.stage(nations(spark, sf_dir, pipe), name="gen", schema="nation long")(no_third_region)
    run = Runner(pipe, spark, smoke=False)
    run.run()
    latest = relational.latest(run.status.frame(spark), ["key"], "seq")
    return latest.groupBy("state", F.col("n_records").alias("records")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CASE WHEN length(n_name) = (SELECT max(length(n_name)) FROM nation) AND n_nationkey = (SELECT min(n_nationkey) FROM nation WHERE length(n_name) = (SELECT max(length(n_name)) FROM nation)) THEN 'failed' ELSE 'queued' END AS state, count(*) AS n FROM nation GROUP BY ALL")
def run_smoke_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The heaviest chunk goes first and alone; it fails, and no other is started."""
    pipe = pipeline(spark, "smoke")

    def never(ctx):
        raise ValueError("does not work")

    pipe.stage(nations(spark, sf_dir, pipe), name="gen")(never)
    run = Runner(pipe, spark)
    try:
        run.run()
    except SmokeFailed:
        return counts(spark, run.tracker.snapshot()).select("state", "n")
    raise AssertionError("the gate let a failing stage through")


@query("SELECT state, max(attempt) AS attempts, count(*) AS n FROM (SELECT unnest(['failed', 'failed', 'success']) AS state, unnest([1, 2, 3]) AS attempt) GROUP BY state")
def run_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stage without input that works the third time; every attempt has its row."""
    pipe = pipeline(spark, "retry", max_redeliveries=3)

    @pipe.stage(schema="n long")
    def flaky(ctx):
        tries = len(ctx.store.list("tries"))
        ctx.store.put(f"tries/{tries}", b"")
        if tries < 2:
            raise RuntimeError("not yet")
        ctx.write({"n": tries})

    run = Runner(pipe, spark)
    run.run()
    return run.status.frame(spark).groupBy("state").agg(F.max("attempt").alias("attempts"), F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(n_regionkey AS BIGINT) AS region, count(*) AS n, CAST(sum(length(n_name)) AS BIGINT) AS letters FROM nation GROUP BY ALL HAVING count(*) > 0")
def run_side_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names lie beside the plan as an object; a custom hook makes one chunk per region of the members."""
    pipe = pipeline(spark, "aux")
    src = nations(spark, sf_dir, pipe)

    def by_region(members, cfg):
        regions = sorted({m.params["region"] for m in members})
        return [{"id": f"r{r}", "params": {"region": r}, "weight": 1.0, "members": [m for m in members if m.params["region"] == r]} for r in regions]

    @pipe.stage(src, partition=by_region, schema="region long, n long, letters long")
    def fold(ctx):
        names = dict(x.split("=") for x in ctx.aux("side/names").decode().split("\n"))
        mine = [names[str(m["nation"])] for m in ctx.members]
        ctx.write_bytes("names.txt", "\n".join(mine).encode())
        ctx.write({"region": ctx.params["region"], "n": len(mine), "letters": len(ctx.store.get(f"{ctx.out_prefix}/names.txt").decode().replace("\n", ""))})

    run = Runner(pipe, spark)
    run.store.put("side/names", "\n".join(f"{c.params['nation']}={c.params['name']}" for c in src.list(pipe.config)).encode())
    run.run()
    return run.output(fold).drop("_chunk_id")


@query("SELECT a.event_type, a.n, a.spend, b.big FROM (SELECT event_type, count(*) AS n, round(sum(value), 2) AS spend FROM events WHERE value > 5 GROUP BY 1) a JOIN (SELECT event_type, count(*) AS big FROM events WHERE value > 50 GROUP BY 1) b USING (event_type)")
def run_frame_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Parquet source, a group-by stage, a map-reduce stage, and a stage that joins the two."""
    pipe = pipeline(spark, "frames")
    src = parquet_source(pipe, "events", [f"{sf_dir}/events.parquet"])
    by: Callable = groupby_agg(pipe, "by", source=src, by="event_type", aggs=[("n", "count", None), ("spend", "sum", "value")], where="value > 5")
    mr = map_reduce(pipe, "mr", source=src, map=lambda d: d.where("value > 50"), reduce=lambda d: d.groupBy("event_type").agg(F.count(F.lit(1)).alias("big")))

    @pipe.stage([by, mr], frame=True)
    def joined(a, b):
        return a.join(b, "event_type").withColumn("spend", F.round("spend", 2))

    run = Runner(pipe, spark)
    run.run()
    return run.output(joined)


@query("SELECT CAST(n_regionkey AS BIGINT) AS region, count(*) AS n, CAST(sum(n_nationkey) AS BIGINT) AS keys FROM nation GROUP BY n_regionkey")
def run_frame_into_python(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame stage's typed rows go to a Python stage that folds them as one chunk."""
    pipe = pipeline(spark, "mixed")
    src = parquet_source(pipe, "nation", [f"{sf_dir}/nation.parquet"])

    @pipe.stage(src, frame=True)
    def slim(df):
        return df.select("n_regionkey", "n_nationkey")

    @pipe.stage(slim, schema="region long, n long, keys long")
    def fold(ctx):
        by = {}
        for r in ctx.input():
            by.setdefault(r["n_regionkey"], []).append(r["n_nationkey"])
        ctx.write([{"region": k, "n": len(v), "keys": sum(v)} for k, v in by.items()])

    run = Runner(pipe, spark)
    run.run()
    return run.output(fold).drop("_chunk_id")


class Rounds:
    """A model that counts the rounds it was fitted for."""

    def __init__(self) -> None:
        self.rounds = self.more = 0

    def set_params(self, n_estimators: int) -> None:
        self.more = n_estimators

    def fit(self, x, y, xgb_model: str | None = None) -> None:
        if xgb_model:
            self.load_model(xgb_model)
        self.rounds += self.more

    def save_model(self, path: str) -> None:
        with open(path, "w") as f:
            f.write(str(self.rounds))

    def load_model(self, path: str) -> None:
        with open(path) as f:
            self.rounds = int(f.read())


@query("SELECT CAST(r_regionkey AS BIGINT) AS region, CAST(70 + 10 * r_regionkey AS BIGINT) AS rounds, CAST(ceil((70 + 10 * r_regionkey) / 25.0) AS BIGINT) AS saved FROM region")
def run_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fits in blocks of 25 rounds that break off once and go on from the last block saved."""
    pipe = pipeline(spark, "fits", max_redeliveries=1)
    chunks = [{"id": f"r{r.r_regionkey}", "params": {"region": r.r_regionkey}} for r in read(spark, sf_dir, "region").collect()]

    @pipe.stage(pipe.source("regions", chunks=chunks), schema="region long, rounds long, saved long")
    def fit(ctx):
        rounds = 70 + 10 * ctx.members[0]["region"]
        if ctx.checkpoint.restore()[1] == 0:
            ctx.checkpoint.fit(Rounds(), [], [], 50, every=25)
            raise RuntimeError("interrupted")
        model = ctx.checkpoint.fit(Rounds(), [], [], rounds, every=25)
        ctx.write({"region": ctx.members[0]["region"], "rounds": model.rounds, "saved": len(ctx.store.list(f"checkpoints/fit/{ctx.chunk_id}"))})

    run = Runner(pipe, spark, smoke=False)
    run.run()
    return run.output(fit).drop("_chunk_id")
