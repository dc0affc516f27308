"""Best-fit packing of token pieces into sequences (component 2).

Hierarchical residual packing. Documents are tokenised and cut into pieces of at most ``length``
tokens by a map. Each partition packs its own pieces best-fit, longest first, in runs of at most
``RUN`` items; nearly full bins are final. Underfull bins are items of the next round, dealt anew by
hash to groups of about ``RUN``, until one group is left and packed or a round frees less than
``GAIN`` of the open bins. Between rounds only bins travel, never pieces or tokens; the pieces learn
their places in one join at the end.

Defined cases: a null or empty text is the closing id alone; texts of any length are read whole and
cut. Rows repeated in the input are packed one by one; ties are packed in order of document, piece and
content. Columns beside ``doc_id`` and ``text`` are not read, whatever their names. An empty table
gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, documents, materialize
from .tokens import WordBpe

LENGTH = 2048
CLOSE = 0
RUN = 1 << 16
#: a bin with at most this many free tokens is final
NEARLY = 8
#: further rounds stop once one frees less than this share of the open bins
GAIN = 0.001
MAX_ROUNDS = 31

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """One row per piece of each document's ids and closing id; ``with_ids`` adds the ids themselves."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = WordBpe(tokenizer)
        end = np.array([CLOSE], "<u4").tobytes()
        step = 4 * length
        for b in batches:
            rows: list[tuple] = []
            for doc, ids in zip(b.column("doc_id").to_pylist(), bpe.encode(b.column("text").to_pylist()), strict=True):
                ids += end
                for k, a in enumerate(range(0, len(ids), step)):
                    part = ids[a : a + step]
                    rows.append((doc, k, a // 4, len(part) // 4, zlib.crc32(part), part))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            arrays = [pa.array(c, t) for c, t in zip(cols[:5], (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                flat = np.frombuffer(b"".join(cols[5]), "<u4").astype(np.int32)
                arrays.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(cols[3], dtype=np.int64)]).astype(np.int32)), pa.array(flat)))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return documents(docs).mapInArrow(cut, PIECES + (", ids array<int>" if with_ids else ""))


def best_fit(sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, longest first into the fullest bin that takes it; fill of each bin.

    Bins are found by free space: a bit set has a bit for each free space that some bin has.
    """
    bins = np.zeros(len(sizes), np.int64)
    offset = np.zeros(len(sizes), np.int64)
    fill: list[int] = []
    by_free: list[list[int]] = [[] for _ in range(length + 1)]
    mask = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fits = mask >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            b = by_free[free].pop()
            if not by_free[free]:
                mask ^= 1 << free
        else:
            free, b = length, len(fill)
            fill.append(0)
        bins[i], offset[i] = b, fill[b]
        fill[b] += size
        free -= size
        if not by_free[free]:
            mask |= 1 << free
        by_free[free].append(b)
    return bins, offset, np.array(fill, np.int64)


def number(level: int, part: int, first: int) -> int:
    """A bin number that no other round, partition or run uses."""
    return (level << 58) | (part << 32) | first


def _pack_pieces(length: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal done
            t = pa.Table.from_batches(held).sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")]).combine_chunks()
            b, off, fill = best_fit(t.column("length").to_numpy(), length)
            t = t.append_column("bin", pa.array(b + number(0, part, done))).append_column("offset", pa.array(off)).append_column("fill", pa.array(fill[b]))
            done += len(fill)
            yield from t.to_batches(max_chunksize=8192)

        rows = 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= RUN:
                yield from flush()
                held, rows = [], 0
        if rows:
            yield from flush()

    return pack


def _pack_bins(level: int, length: int):
    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by("bin").combine_chunks()
        b, off, fill = best_fit(t.column("fill").to_numpy(), length)
        group = t.column("g")[0].as_py() if len(t) else 0
        return pa.table({"bin": t.column("bin"), "parent": pa.array(b + number(level, group, 0)), "base": pa.array(off), "parent_fill": pa.array(fill[b])})

    return pack


def pack(items: DataFrame, length: int = LENGTH) -> DataFrame:
    """``items`` (of ``PIECES``) with ``sequence_id`` and gapless ``offset``."""
    items = materialize(items, "pack-pieces")
    placed = materialize(items.mapInArrow(_pack_pieces(length), PIECES + ", bin long, offset long, fill long"), "pack-0")
    discard(items)
    open_bins = placed.where(F.col("fill") < length - NEARLY).groupBy("bin").agg(F.max("fill").alias("fill"))
    moved: DataFrame | None = None  # where the first round's bins lie by now
    for level in range(1, MAX_ROUNDS + 1):
        n = open_bins.count()
        if n < 2:
            break
        groups = -(-n // RUN)
        dealt = open_bins.withColumn("g", F.pmod(F.xxhash64("bin", F.lit(level)), F.lit(groups)))
        step = materialize(dealt.groupBy("g").applyInArrow(_pack_bins(level, length), "bin long, parent long, base long, parent_fill long"), f"pack-{level}")
        before, moved = moved, step.select("bin", "parent", "base") if moved is None else _composed(moved, step)
        moved = materialize(moved, "pack-moved")
        discard(before)
        merged = step.select("parent").distinct().count()
        if groups == 1 or merged > n * (1 - GAIN):
            discard(step)
            break
        open_bins = materialize(step.where(F.col("parent_fill") < length - NEARLY).groupBy(F.col("parent").alias("bin")).agg(F.max("parent_fill").alias("fill")), "pack-open")
        discard(step)
    if moved is not None:
        placed = placed.join(moved, "bin", "left").withColumns({"offset": F.col("offset") + F.coalesce("base", F.lit(0)), "bin": F.coalesce("parent", "bin")})
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), "offset")


def _composed(moved: DataFrame, step: DataFrame) -> DataFrame:
    """Places after one more round."""
    on = step.select(F.col("bin").alias("parent"), F.col("parent").alias("to"), F.col("base").alias("more"))
    return moved.join(on, "parent", "left").select("bin", F.coalesce("to", "parent").alias("parent"), (F.col("base") + F.coalesce("more", F.lit(0))).alias("base"))


def run(docs: DataFrame, tokenizer: str, length: int = LENGTH) -> DataFrame:
    return pack(pieces(docs, tokenizer, length), length)
