"""Chunk plans: what one task of a stage works on.

Plans are metadata (a row per file, date or key range), so they are made on the driver; the data
itself is dealt by ``assign``, which joins a plan to rows by member.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable, Iterator
from dataclasses import asdict, dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass
class Chunk:
    id: str
    params: dict = field(default_factory=dict)
    weight: float = 1.0
    #: the upstream chunks it is made of
    members: list[Chunk] = field(default_factory=list)

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True, default=str)

    @classmethod
    def of(cls, x: Chunk | dict) -> Chunk:
        if isinstance(x, Chunk):
            return x
        return cls(**{**x, "members": [cls.of(m) for m in x.get("members", [])]})


def one_to_one(members: Iterable[Chunk]) -> list[Chunk]:
    return [Chunk(m.id, dict(m.params), m.weight, [m]) for m in members]


def pack(members: Iterable[Chunk], target: float, prefix: str = "c") -> list[Chunk]:
    """Next-fit in the given order: a chunk closes before the member that would take it over the target.

    A member heavier than the target is alone; members are never split; no target packs nothing.
    """
    if target <= 0:
        return one_to_one(members)
    groups: list[list[Chunk]] = []
    room = 0.0
    for m in members:
        if not groups or m.weight > room:
            groups.append([])
            room = target
        groups[-1].append(m)
        room -= m.weight
    return [Chunk(f"{prefix}{i}", {}, sum(m.weight for m in g), g) for i, g in enumerate(groups)]


def split(chunk: Chunk) -> list[Chunk]:
    """One chunk per member, keeping the chunk's own parameters."""
    return [Chunk(f"{chunk.id}-m{j}", dict(chunk.params), m.weight, [m]) for j, m in enumerate(chunk.members)]


def heaviest_first(chunks: Iterable[Chunk]) -> list[Chunk]:
    return sorted(chunks, key=lambda c: -c.weight)


def plan(upstream: list[Chunk], target: float | None, hook: Callable | None, config: object) -> list[Chunk]:
    """The hook if there is one, else packing to the target, else one to one."""
    if hook:
        return [Chunk.of(c) for c in hook(upstream, config)]
    return pack(upstream, float(target)) if target else one_to_one(upstream)


def fingerprint(*parts: object) -> str:
    """Names what a chunk's result depends on, so that a stale result is never taken for it."""
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()[:32]


def plan_frame(spark: SparkSession, chunks: list[Chunk]) -> DataFrame:
    """Chunks as rows: ordinal, id, weight and JSON."""
    rows = [(i, c.id, float(c.weight), c.to_json()) for i, c in enumerate(chunks)]
    return spark.createDataFrame(rows, "ordinal int, _chunk_id string, weight double, chunk string")


def assign(df: DataFrame, member: str, chunks: list[Chunk]) -> DataFrame:
    """``df`` with ``_chunk_id``: the chunk that holds the row's member."""
    pairs = [(m.id, c.id) for c in chunks for m in c.members]
    return df.join(df.sparkSession.createDataFrame(pairs, f"{member} string, _chunk_id string"), member)


def pack_frame(df: DataFrame, weight: str, target: float) -> DataFrame:
    """``pack`` over the rows of a plan in order of ``ordinal``: adds ``chunk`` numbers.

    Next-fit is a fold, so the plan is one partition; it is streamed, with only the open chunk's room carried along.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, room = -1, 0.0
        for b in batches:
            numbers = []
            for w in b.column("__weight").to_pylist():
                if chunk < 0 or w > room:
                    chunk, room = chunk + 1, float(target)
                room -= w
                numbers.append(chunk)
            yield pa.RecordBatch.from_arrays([b.column("ordinal"), pa.array(numbers, pa.int32())], names=["ordinal", "chunk"])

    slim = df.select("ordinal", F.col(weight).cast("double").alias("__weight"))
    placed = slim.repartition(1).sortWithinPartitions("ordinal").mapInArrow(fold, T.StructType([df.schema["ordinal"], T.StructField("chunk", T.IntegerType())]))
    return df.join(placed, "ordinal")
