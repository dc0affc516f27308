"""Suffix-array dedup of long repeated byte strings (component 4).

Removes each byte that a ``LENGTH``-byte string covers which starts anywhere else too, in the same
document or another. Only starts of such strings (suffixes with LENGTH bytes left) matter, and only
the first LENGTH bytes of a suffix decide, so suffixes are put in order by these.

1. *Suffix buckets.* A suffix belongs to the bucket of the least hash among the ``GRAM``-byte grams of
   its first LENGTH bytes, so equal strings share a bucket and a bucket can be sorted by itself.
   Consecutive suffixes of one bucket form a run; a run's key is a hash of all bytes its suffixes
   span. Runs are what travels: about one for every 140 bytes. Runs with equal keys are copies; they
   are one run that weighs as many, counted by partial aggregation before anything is shuffled.
2. A bucket with a single run that meets its least gram once is in order as it is: its strings all
   differ, and each weighs what the run weighs. All others are fetched once per distinct run and sorted
   bucket by bucket, in blocks of bounded bytes.
3. *Difference cover.* In a block, the strings of ``LENGTH - V + 1`` bytes at a cover sample of the
   positions get ranks by doubling. Suffixes are sorted by their first V bytes; longer ties are settled
   by the ranks at the offset where both are in the sample, and the last V bytes. Of any two residues
   there is exactly one such offset, so sorting the four residues of each offset places every suffix
   among all others without comparing further bytes. A suffix repeats if those of its place in the
   order weigh two or more.
4. A bucket of more than ``BLOCK`` bytes is split into one bucket per suffix (its 128-bit hash), in
   which all are equal and partial aggregation sums the weights, so no task ever holds a bucket
   without bound. Both ways give the same bytes.

Defined cases: null counts as empty; texts shorter than LENGTH lose nothing; texts of any length are
read whole, in overlapping segments; matches never cross documents; repeated rows are each other's
copies; texts under one id (or none) are kept apart by a hash of the text; of the places of an equal
string all are removed, none is preferred; columns beside ``doc_id`` and ``text`` are not read,
whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit
from .common import arrow_batches, materialize

LENGTH = 400
GRAM = 128
#: the difference cover: every distance modulo V is a difference of two of its elements
V = 13
COVER = (0, 1, 3, 9)
#: suffixes of a text that are bucketed at once
SEGMENT = 1 << 20
#: bytes of distinct runs sorted at once
BLOCK = 1 << 21

_POWERS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB), np.uint64(0x8EBC6AF09C88C6E3), np.uint64(0x589965CC75374CC3), np.uint64(0x1D8E4E27C47D124F))


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the ``gram`` bytes from each position (a power of two), by doubling."""
    h = textkit.mix(data.astype(np.uint64) + np.uint64(0x1234567))
    size, k = 1, 0
    while size < gram:
        h = h[:-size] * _POWERS[k] + h[size:]
        h ^= h >> np.uint64(29)
        size, k = size * 2, k + 1
    return textkit.mix(h)


def window_min(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values, by doubling."""
    size = 1
    while size * 2 <= width:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    rest = width - size
    return np.minimum(h[: len(h) - rest], h[rest:]) if rest else h


def runs(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bucket, first and last suffix start of each run, and whether its least gram recurs in its span."""
    h = gram_hashes(data, gram)
    m = window_min(h, length - gram + 1)
    cut = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]]))
    last = np.concatenate([cut[1:], [len(m)]]) - 1
    own = m[cut]
    span = last - cut + length - gram + 1  # grams of the run's span
    where = np.repeat(cut - np.concatenate([[0], np.cumsum(span)[:-1]]), span) + np.arange(int(span.sum()))
    same = h[where] == np.repeat(own, span)
    first = np.concatenate([[0], np.cumsum(span)[:-1]])
    return own, cut, last, np.add.reduceat(same.astype(np.int64), first) > 1


RUNS = "doc_id long, key long, bucket long, content long, first int, last int, recurs boolean"


def _find(length: int, gram: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = textkit.buffers(b.column("text"))
            docs, keys = b.column("doc_id").to_pylist(), b.column("key").to_pylist()
            out: list[list] = [[] for _ in range(7)]
            for i in range(b.num_rows):
                text = data[off[i] : off[i + 1]]
                if len(text) < length:
                    continue
                # long texts in overlapping segments; that a run ends at a segment's edge changes nothing
                parts = [[x + a if j in (1, 2) else x for j, x in enumerate(runs(text[a : a + SEGMENT + length - 1], length, gram))] for a in range(0, len(text) - length + 1, SEGMENT)]
                own, first, last, recurs = (np.concatenate(x) for x in zip(*parts, strict=True)) if len(parts) > 1 else parts[0]
                raw = text.tobytes()
                digest = b"".join([hashlib.md5(raw[a:z]).digest()[:8] for a, z in zip(first.tolist(), (last + length).tolist(), strict=True)])
                for c, v in zip(out, ([docs[i]] * len(own), [keys[i]] * len(own), own.view(np.int64), np.frombuffer(digest, np.int64), first.astype(np.int32), last.astype(np.int32), recurs), strict=True):
                    c.append(v)
            if out[0]:
                cols = [pa.array(sum(out[0], []), pa.int64()), pa.array(sum(out[1], []), pa.int64()), *[pa.array(np.concatenate(c)) for c in out[2:]]]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "key", "bucket", "content", "first", "last", "recurs"])

    return go


def _cut_texts(length: int):
    """The bytes of each wanted run of a text."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for doc, key, text, want in zip(b.column("doc_id").to_pylist(), b.column("key").to_pylist(), b.column("text").to_pylist(), b.column("want").to_pylist(), strict=True):
                raw = (text or "").encode()
                rows += [(w["bucket"], w["content"], doc, key, w["first"], w["n"], raw[w["first"] : w["last"] + length]) for w in want]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["bucket", "content", "doc_id", "key", "first", "n", "bytes"])

    return go


def rank(keys: list[np.ndarray]) -> np.ndarray:
    """Dense numbers of rows of keys, equal for equal rows, in their order."""
    out = _dense(keys[0])
    for k in keys[1:]:
        out = _dense(out * (len(k) + 1) + _dense(k))
    return out


def _dense(key: np.ndarray) -> np.ndarray:
    order = np.argsort(key)
    s = key[order]
    out = np.empty(len(key), np.int64)
    out[order] = np.cumsum(np.concatenate([[False], s[1:] != s[:-1]])[: len(key)])
    return out


def packed(data: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """n <= 8 bytes from each position as one number."""
    out = np.zeros(len(at), np.uint64)
    for j in range(n):
        out = (out << np.uint64(8)) | data[at + j]
    return out


def names(data: np.ndarray, wanted: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of the ``size``-byte strings at the wanted positions, by doubling; and each position's place among them.

    Steps double a string's length within its residue class, so they stay in the sample; the last one overlaps.
    """
    steps, s = [], V
    while s < size:
        jump = min(s, size - s)
        jump -= jump % V
        if not jump:
            break
        steps.append((s, jump))
        s += jump
    tail = size - s
    sample = wanted.copy()
    for _, jump in reversed(steps):
        sample[jump:] |= sample[:-jump]
    pos = np.flatnonzero(sample)
    index = np.zeros(len(data), np.int64)
    index[pos] = np.arange(len(pos))
    at = np.where(pos + V <= len(data), pos, 0)
    name = rank([packed(data, at, 7), packed(data, at + 7, V - 7)])
    for _, jump in steps:
        to = np.minimum(pos + jump, len(data) - 1)
        name = rank([name * (int(name.max()) + 1) + name[index[to]]])
    if tail:
        end = np.minimum(pos + s, len(data) - 8)
        name = rank([name, packed(data, end, min(tail, 7)), packed(data, np.minimum(end + 7, len(data) - 8), max(tail - 7, 0))])
    return name, index


def suffix_order(data: np.ndarray, start: np.ndarray, length: int, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Of the suffixes at ``start``: how many are less by their first ``length`` bytes, and what those equal to it weigh.

    ``data`` must go on for at least ``length`` bytes from every start.
    """
    n = len(start)
    weight = np.ones(n, np.int64) if weight is None else weight
    pad = np.concatenate([data, np.zeros(2 * length, np.uint8)])
    cover = np.zeros(V, bool)
    cover[list(COVER)] = True
    wanted = np.zeros(len(pad), bool)
    for d in range(V):
        at = start + d
        wanted[at[cover[at % V]]] = True
    name, index = names(pad, wanted, length - V + 1)
    head = rank([packed(pad, start, 7), packed(pad, start + 7, V - 7)])
    last = rank([packed(pad, start + length - V, 7), packed(pad, start + length - 7, 7)])
    wide = int(name.max(initial=0)) + 1
    less, equal = np.zeros(n, np.int64), np.zeros(n, np.int64)

    def place(mine: np.ndarray, d: int, times: int) -> None:
        """Adds the places of some suffixes among each other, ``times`` over."""
        if not len(mine):
            return
        key, end = head[mine] * wide + name[index[start[mine] + d]], last[mine]
        order = np.argsort(key)
        k, e = key[order], end[order]
        same = k[1:] == k[:-1]
        if (e[1:] != e[:-1])[same].any():  # the name leaves out the last bytes, and here they differ
            key = _dense(key) * (n + 1) + end
            order = np.argsort(key)
            k = key[order]
            same = k[1:] == k[:-1]
        first = np.flatnonzero(np.concatenate([[True], ~same]))
        group = np.cumsum(np.concatenate([[0], ~same]))
        at = mine[order]
        less[at] += times * first[group]
        equal[at] += times * np.add.reduceat(weight[at], first)[group]

    residue = start % V
    for d in range(V):
        place(np.flatnonzero(cover[(residue + d) % V]), d, 1)
    # a suffix has met each other residue once, and its own as often as the cover has elements
    for r in range(V):
        place(np.flatnonzero(residue == r), next(d for d in range(V) if cover[(r + d) % V]), 1 - len(COVER))
    return less, equal


def repeated(data: np.ndarray, start: np.ndarray, length: int, weight: np.ndarray | None = None) -> np.ndarray:
    """Whether the ``length`` bytes from each start also stand at another of the starts, or weigh more than one."""
    return suffix_order(data, start, length, weight)[1] > 1


def spans(start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Consecutive starts as byte spans."""
    if not len(start):
        return start, start
    cut = np.flatnonzero(np.concatenate([[True], np.diff(start) != 1]))
    last = np.concatenate([cut[1:], [len(start)]]).astype(int) - 1
    return start[cut], start[last] + length


FOUND = "bucket long, content long, n long, doc_id long, key long, start int, end int"


def _sort_block(length: int):
    """The spans of a block's runs that repeat."""

    def go(t: pa.Table) -> pa.Table:
        data, off = textkit.buffers(t.column("bytes").combine_chunks().cast(pa.binary()))
        # buckets can't share a string, so one block sorts many of them together
        count = np.maximum(np.diff(off) - length + 1, 0)
        first = np.concatenate([[0], np.cumsum(count)[:-1]])
        local = np.arange(int(count.sum())) - np.repeat(first, count)
        start = local + np.repeat(off[:-1], count)
        weight = t.column("n").to_numpy()
        hit = repeated(data, start, length, np.repeat(weight, count))
        at = t.column("first").to_numpy()
        rows: list[tuple] = []
        for i in range(len(count)):
            a, z = spans(np.flatnonzero(hit[first[i] : first[i] + count[i]]) + at[i], length)
            rows += [(i, int(x), int(y)) for x, y in zip(a, z, strict=True)]
        own, a, z = (np.array(c, np.int64) for c in zip(*rows, strict=True)) if rows else [np.zeros(0, np.int64)] * 3
        return pa.table([*[t.column(c).take(pa.array(own)) for c in ("bucket", "content", "n", "doc_id", "key")], pa.array(a.astype(np.int32)), pa.array(z.astype(np.int32))], names=["bucket", "content", "n", "doc_id", "key", "start", "end"])

    return go


def _one_each(length: int):
    """A row for every suffix of a run of a huge bucket."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, key, first, n, raw in zip(*(b.column(c).to_pylist() for c in ("doc_id", "key", "first", "n", "bytes")), strict=True):
                size = len(raw) - length + 1
                h = [hashlib.md5(raw[i : i + length]).digest() for i in range(size)]
                yield pa.RecordBatch.from_arrays([pa.array([doc] * size, pa.int64()), pa.array([key] * size, pa.int64()), pa.array(range(first, first + size), pa.int32()), pa.array([n] * size, pa.int64()), pa.array(h, pa.binary())], names=["doc_id", "key", "start", "n", "suffix"])

    return go


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for text, found in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True):
            raw = (text or "").encode()
            kept, gone, runs_, at = hashlib.sha256(), 0, 0, 0
            for s in sorted((s["start"], s["end"]) for s in found or ()):
                if s[0] > at or not runs_:
                    kept.update(raw[at : s[0]])
                    runs_ += 1
                    gone += s[1] - s[0]
                    at = s[1]
                elif s[1] > at:
                    gone += s[1] - at
                    at = s[1]
            kept.update(raw[at:])
            rows.append((len(raw), gone, runs_, kept.hexdigest()))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)]], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def keyed(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` and a hash of the text, which keeps texts under one id apart."""
    arrow_batches(docs.sparkSession)
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1 << 63)).alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("key", F.xxhash64("text"))


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, block: int = BLOCK) -> DataFrame:
    """Byte spans (doc_id, key, start, end) to remove; spans of one document may overlap."""
    found = materialize(docs.mapInArrow(_find(length, gram), RUNS), "sd-runs")
    stats = found.groupBy("bucket", "content").agg(F.count(F.lit(1)).alias("n"), F.max("recurs").alias("recurs"), F.min(F.struct("doc_id", "key", "first", "last")).alias("at"))
    stats = materialize(stats, "sd-stats")
    span = F.col("at.last") - F.col("at.first") + length
    buckets = stats.groupBy("bucket").agg(F.count(F.lit(1)).alias("distinct"), F.max("recurs").alias("recurs"), F.max("n").alias("most"), F.sum(span.cast("long")).alias("size"))
    # a single run without its least gram twice holds no two equal strings
    open_ = buckets.where((F.col("distinct") > 1) | F.col("recurs")).select("bucket", (F.col("size") > block).alias("huge"))
    lone = buckets.where((F.col("distinct") == 1) & ~F.col("recurs") & (F.col("most") > 1)).select("bucket")
    reps = materialize(stats.join(open_, "bucket").select("bucket", "content", "n", "huge", "at.*"), "sd-open")
    total = reps.where("NOT huge").agg(F.sum(F.col("last") - F.col("first") + length)).first()[0] or 0
    wanted = reps.groupBy("doc_id", "key").agg(F.collect_list(F.struct("bucket", "content", "first", "last", "n")).alias("want"))
    cut = docs.join(wanted, ["doc_id", "key"]).mapInArrow(_cut_texts(length), "bucket long, content long, doc_id long, key long, first int, n long, bytes binary")
    cut = materialize(cut.dropDuplicates(["doc_id", "key", "first"]), "sd-cut")
    huge = reps.where("huge").select("bucket").distinct()
    groups = max(1, -(-int(total) // block))
    small = cut.join(huge, "bucket", "left_anti").withColumn("g", F.pmod(F.xxhash64("bucket"), F.lit(groups)))
    sorted_ = materialize(small.groupBy("g").applyInArrow(_sort_block(length), FOUND), "sd-sorted")
    each = materialize(cut.join(huge, "bucket", "left_semi").mapInArrow(_one_each(length), "doc_id long, key long, start int, n long, suffix binary"), "sd-each")
    twice = each.groupBy("suffix").agg(F.sum("n").alias("k")).where("k > 1").select("suffix")
    split = each.where("n = 1").join(twice, "suffix", "left_semi").select("doc_id", "key", "start", (F.col("start") + length).alias("end"))
    # a run that weighs more than one repeats from end to end, at every place where it stands
    copies = sorted_.where("n > 1").select("bucket", "content").unionByName(reps.where("huge AND n > 1").select("bucket", "content")).unionByName(stats.join(lone, "bucket").select("bucket", "content")).distinct()
    whole = found.join(copies, ["bucket", "content"]).select("doc_id", "key", F.col("first").alias("start"), (F.col("last") + length).alias("end"))
    return sorted_.where("n = 1").select("doc_id", "key", "start", "end").unionByName(split).unionByName(whole)


def run(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, block: int = BLOCK) -> DataFrame:
    """Digest of what each document keeps."""
    docs = keyed(docs)
    found = repeats(docs, length, gram, block).groupBy("doc_id", "key").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"))
    out = docs.join(found, ["doc_id", "key"], "left").select("doc_id", "text", "spans").mapInArrow(_strip, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != F.lit(-1 << 63), F.col("doc_id")))
