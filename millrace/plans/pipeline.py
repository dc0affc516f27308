"""The authoring surface: pipelines, sources and stages."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..functions.aggregates import Spec
from ..operators import grouping
from ..sources.files import file_chunks, read_parquet
from .chunks import Chunk


@dataclass
class Config:
    root: str = "millrace-data"
    workers: int = 4
    max_redeliveries: int = 3
    failure_policy: str = "off"  # off, report or remediate
    failure_handler: Callable | None = None
    max_remediations: int = 2
    #: jobs that may die before any chunk of a stage has finished
    worker_failure_cap: int = 8
    vcpu: int = 2
    mem: int = 16384
    viz_host: str = "127.0.0.1"
    viz_port: int = 8765
    enable_agent_api: bool = False
    extra: dict = field(default_factory=dict)


@dataclass
class Source:
    """Outside input: literal ``chunks``, or ``enumerate(config, **run_args)``; a ``reader`` expands a member to records."""

    name: str
    chunks: Sequence[Chunk | dict] | None = None
    enumerate: Callable | None = None
    reader: Callable | None = None
    #: DataFrame of the whole source, for frame stages
    frame: Callable[[SparkSession], DataFrame] | None = None
    kind: str = "source"

    def list(self, config: Config, **run_args) -> list[Chunk]:
        if self.enumerate is not None:
            return [Chunk.of(c) for c in self.enumerate(config, **run_args)]
        if self.chunks is not None:
            return [Chunk.of(c) for c in self.chunks]
        raise ValueError(f"source {self.name!r} has neither chunks nor an enumerator")


@dataclass
class Stage:
    """A Python stage runs ``fn(ctx)`` per chunk; a frame stage is a DataFrame function over all its inputs."""

    name: str
    fn: Callable
    reads: tuple = ()
    frame: bool = False
    schema: StructType | str | None = None
    target_rows: float | None = None
    target_bytes: float | None = None
    partition: Callable | None = None
    vcpu: int | None = None
    mem: int | None = None
    omp: int | None = None
    cap_rows: int = 1_000_000
    kind: str = "stage"

    @property
    def target(self) -> float | None:
        return self.target_rows or self.target_bytes

    def source_text(self) -> str:
        try:
            return inspect.getsource(self.fn)
        except (OSError, TypeError):
            return repr(self.fn)

    def resources(self, config: Config) -> dict[str, int]:
        """Cores, memory and threads; large tasks come in steps of 4096 MB."""
        vcpu, mem = self.vcpu or config.vcpu, self.mem or config.mem
        if vcpu >= 8:
            mem = -(-mem // 4096) * 4096
        return {"vcpu": vcpu, "mem": mem, "omp": self.omp or vcpu}


class Pipeline:
    def __init__(self, name: str, config: Config | None = None) -> None:
        self.name = name
        self.config = config or Config()
        self.stages: dict[str, Stage] = {}
        self.sources: dict[str, Source] = {}

    def source(self, name: str, **options) -> Source:
        self.sources[name] = Source(name, **options)
        return self.sources[name]

    def stage(self, reads: Stage | Source | Sequence | None = None, *, name: str | None = None, **options) -> Callable[[Callable], Stage]:
        """Decorator for ``fn(ctx)``, or with ``frame=True`` for ``fn(df, ...) -> df``.

        Python stages read one input; frame stages may read several.
        """
        inputs = tuple(reads) if isinstance(reads, list | tuple) else () if reads is None else (reads,)
        if len(inputs) > 1 and not options.get("frame"):
            raise ValueError("a Python stage reads one input; use frame=True to join several")

        def add(fn: Callable) -> Stage:
            st = Stage(name or fn.__name__, fn, inputs, **options)
            self.stages[st.name] = st
            return st

        return add

    def parents(self, stage: Stage) -> list[str]:
        return [r.name for r in stage.reads if r.kind == "stage" and r.name in self.stages]

    def order(self) -> list[Stage]:
        """Stages after all they read, otherwise as they were declared."""
        out: dict[str, Stage] = {}

        def visit(st: Stage, path: tuple[str, ...]) -> None:
            if st.name in path:
                raise ValueError(f"stages form a cycle: {' -> '.join((*path, st.name))}")
            if st.name not in out:
                for p in self.parents(st):
                    visit(self.stages[p], (*path, st.name))
                out[st.name] = st

        for st in self.stages.values():
            visit(st, ())
        return list(out.values())

    def run(self, spark: SparkSession | None = None, **options) -> dict:
        """Runs every stage and returns the status snapshot; see ``runner.Runner``."""
        from .runner import Runner

        names = ("force", "smoke", "on_event", "viz", "workers")
        given = {k: options.pop(k) for k in names if k in options}
        return Runner(self, spark, **given).run(**options)


def parquet_source(pipe: Pipeline, name: str, paths: Sequence[str], weights: Sequence[float] | None = None) -> Source:
    """One chunk per file; read as one DataFrame by frame stages."""
    paths = list(paths)

    def enumerate_files(config: Config, **_: object) -> list[Chunk]:
        return file_chunks(SparkSession.getActiveSession(), paths, weights)

    return pipe.source(name, enumerate=enumerate_files, frame=lambda spark: read_parquet(spark, paths))


def map_reduce(pipe: Pipeline, name: str, *, source: Source | Stage, map: Callable, reduce: Callable, scope: str = "global", schema: StructType | str | None = None, **options) -> Stage:
    """A stage ``<name>_reduce`` with ``reduce(map(source))``; map and reduce fuse into one plan."""
    return pipe.stage(source, name=f"{name}_reduce", frame=True, **options)(lambda df: grouping.map_reduce(df, map, reduce, scope=scope, schema=schema))


def groupby_agg(pipe: Pipeline, name: str, *, source: Source | Stage, by: str | Sequence[str], aggs: Sequence[Spec], where: Column | str | None = None, mean_counts_nulls: bool = False, **options) -> Stage:
    """A stage ``<name>_reduce`` with the source grouped and aggregated."""
    return pipe.stage(source, name=f"{name}_reduce", frame=True, **options)(lambda df: grouping.group_agg(df, by, aggs, where, mean_counts_nulls=mean_counts_nulls))


def explain(pipe: Pipeline, spark: SparkSession, **run_args) -> str:
    """The chunks each stage would run, without writing anything, and the plan of each frame stage."""
    from .runner import Runner

    return Runner(pipe, spark).explain(**run_args)
