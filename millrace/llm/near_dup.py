"""N-gram Jaccard join: T-occurrence search with DivideSkip (component 7).

Documents are sets of distinct 5-word shingles (64-bit hashes). Two documents link when their
Jaccard similarity is at least ``PERCENT`` hundredths, so they must share at least
T = ceil(p (|x| + |y|) / (100 + p)) shingles.

1. Equal sets collapse to one class by the set's hash; a class of any size is one row from here on.
2. Shingles that recur within a task's rows are counted and the counts summed. Every set is ordered
   rare shingles first, then the counted ones by rising count, and only its first
   |x| - ceil(p |x| / 100) + 1 shingles are posted: two linked sets share t = T less the larger rest
   of those, not just one.
3. Postings are dealt by shingle (long lists salted) and streamed in order, so no list is ever held.
   What remains are the inverted lists with several classes. Each class's lists are then ordered by
   their exact length, and DivideSkip divides them: linked classes share t of them, so they meet in
   one of the first (lists - t + 1) of either. Only these short lists are merged for candidates; the
   t - 1 longest are never walked, they are probed for the candidates alone.
4. In star rounds each short list names a leader and pairs it with the members of other components
   only, so copies of one text cost a pair each, not all pairs. The last round drops the lists that
   lie within one component, divides anew, which leaves classes near a large component hardly any
   short list, and pairs what still meets.
5. Candidates are answered by T-occurrence search: a leader's shingles are looked up in the inverted
   lists of a block of its candidates; a heap merges the short lists, and candidates that could still
   reach T are probed in the long ones by binary search.
6. Components by distributed label propagation over the graph of components, until no label falls.

Defined cases: null, empty or wordless texts have the empty set, are linked with nothing and are
their own component; fewer than five words make one shingle; texts of any length are read whole.
Repeated rows (same id) are returned once each and share a component; ties choose the smaller number.
Columns beside ``doc_id`` and ``text`` are not read, whatever their names. An empty table gives no
rows. Which shingles are counted changes only the cost, never the result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textkit
from .common import discard, documents, materialize

PERCENT = 80
WORDS = 5
#: a task forgets shingle counts after so many shingles, keeping those seen LOCAL times or more
CHUNK = 3_000_000
LOCAL = 2
#: shingles whose counts order the sets: seen LONG times or more, MAX_LONG of them at most (12 bytes each are broadcast)
LONG = 8
MAX_LONG = 1 << 19
SALT = 64
#: postings of a list that one task streams in a star round
PART = 4096
BLOCK = 256
STAR_ROUNDS = 3
#: pairs, or places in the documents, that are broadcast (some 40 bytes each); beyond, they are joined by a shuffle
MAX_SOUGHT = 500_000


def need(a: np.ndarray | int, b: np.ndarray | int, percent: int = PERCENT) -> np.ndarray | int:
    """Shared shingles that sets of a and b must have to link."""
    return -(-percent * (a + b) // (100 + percent))


def set_key(s: np.ndarray) -> int:
    """A 64-bit hash of a set of shingles."""
    h = np.array([len(s)], np.uint64) * np.uint64(0x9E3779B97F4A7C15) + textkit.mix(s).sum(dtype=np.uint64) + (textkit.mix(s ^ np.uint64(0x5851F42D4C957F2D)) * np.uint64(0x14057B7EF767814F)).sum(dtype=np.uint64)
    return int(textkit.mix(h).view(np.int64)[0])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of documents (doc_id, cid, n) and, with a null doc_id, of recurring shingles (cid, n)."""
    held: list[np.ndarray] = []
    size = 0
    known: set[int] = set()

    def recurring() -> pa.RecordBatch:
        k = np.sort(np.concatenate(held)) if held else np.zeros(0, np.uint64)
        cut = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
        n = np.diff(np.concatenate([cut, [len(k)]])) if len(k) else cut
        m = n >= LOCAL
        return pa.RecordBatch.from_arrays([pa.array([False] * int(m.sum()), pa.bool_()), pa.nulls(int(m.sum()), pa.int64()), pa.nulls(int(m.sum()), pa.int64()), pa.array(k[cut[m]].view(np.int64)), pa.array(n[m].astype(np.int64))], names=["is_doc", "doc_id", "text_key", "cid", "n"])

    for b in batches:
        sets = textkit.shingle_sets(*textkit.buffers(b.column("text")), WORDS)
        keys = [set_key(s) for s in sets]
        yield pa.RecordBatch.from_arrays([pa.array([True] * b.num_rows, pa.bool_()), b.column("doc_id"), b.column("text_key"), pa.array(keys, pa.int64()), pa.array([len(s) for s in sets], pa.int64())], names=["is_doc", "doc_id", "text_key", "cid", "n"])
        for k, x in zip(keys, sets, strict=True):
            if k not in known:  # copies of one set are one class
                known.add(k)
                held.append(x)
                size += len(x)
        if size >= CHUNK:
            yield recurring()
            held, size = [], 0
            known.clear()
    yield recurring()


def _postings(frequent, percent: int):
    """Each class's prefix: its first shingles, rare ones first. A task posts a class once."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        long, place = frequent.value
        done: set[int] = set()
        for b in batches:
            cols: list[list[np.ndarray]] = [[], [], [], []]
            for s in textkit.shingle_sets(*textkit.buffers(b.column("text")), WORDS):
                n = len(s)
                if not n or (cid := set_key(s)) in done:
                    continue
                done.add(cid)
                m = prefix(n, percent)
                hot = np.zeros(n, bool)
                if len(long):
                    at = np.minimum(np.searchsorted(long, s), len(long) - 1)
                    hot = long[at] == s
                order = np.concatenate([s[~hot], s[hot][np.argsort(place[at[hot]])]])[:m] if hot.any() else s[:m]
                flags = np.arange(m) >= n - int(hot.sum())
                for c, v in zip(cols, (order.view(np.int64), np.full(m, cid, np.int64), np.full(m, n, np.int32), flags), strict=True):
                    c.append(v)
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], names=["shingle", "cid", "n", "hot"])

    return post


def _columns(b: pa.RecordBatch) -> dict[str, np.ndarray]:
    return {f.name: b.column(f.name).to_numpy(zero_copy_only=False) for f in b.schema}


def _join(a: dict[str, np.ndarray] | None, b: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return b if a is None else {k: np.concatenate([a[k], b[k]]) for k in b}


def _starts(c: dict[str, np.ndarray], keys: list[str]) -> np.ndarray:
    """Whether each row begins a group of rows with equal keys."""
    n = len(c[keys[0]])
    new = np.ones(n, bool)
    if n > 1:
        new[1:] = np.any([c[k][1:] != c[k][:-1] for k in keys], axis=0)
    return new


def _take(c: dict[str, np.ndarray], m: np.ndarray | slice) -> dict[str, np.ndarray]:
    return {k: v[m] for k, v in c.items()}


def _batch(c: dict[str, np.ndarray], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c[n]) for n in names], names=names)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of postings sorted by shingle and class: one row a class, of lists with several classes or of long ones.

    Only the last row is carried from batch to batch, with whether it has been sent.
    """
    last, sent = None, False
    names = ["shingle", "cid", "n", "hot"]
    for b in batches:
        if not b.num_rows:
            continue
        c = _join(last, _columns(b))
        once = _starts(c, ["shingle", "salt", "cid"])
        c = _take(c, once)  # the carried row comes first, so it stays
        new = _starts(c, ["shingle", "salt"])
        group = np.cumsum(new) - 1
        many = np.bincount(group)[group] > 1
        keep = many | c["hot"]
        if last is not None and sent:
            keep |= group == 0
        out = keep.copy()
        if last is not None and sent:
            out[0] = False
        sent = bool(keep[-1])
        last = _take(c, slice(-1, None))
        if out.any():
            yield _batch(_take(c, out), names)


def prefix(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    """How many shingles a set of n posts."""
    return n - -(-percent * n // 100) + 1


def _alike(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Length filter."""
    a, b = n.astype(np.int64), m.astype(np.int64)
    return 100 * np.minimum(a, b) >= percent * np.maximum(a, b)


def _least(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Postings that sets of n and m must share to link: T, less what may lie beyond the longer prefix.

    All shared shingles up to the end of one prefix are in both, so of T at most the rest of that set is missing.
    """
    a, b = n.astype(np.int64), m.astype(np.int64)
    return np.maximum(1, need(a, b, percent) - np.maximum(-(-percent * a // 100), -(-percent * b // 100)) + 1)


def _least_column(n: Column, m: Column, percent: int) -> Column:
    """``_least`` as a column."""
    rest = lambda x: F.ceil(x * percent / 100)
    return F.greatest(F.lit(1), F.ceil((n + m) * percent / (100 + percent)) - F.greatest(rest(n), rest(m)) + 1)


def _reach(c: dict[str, np.ndarray], d: dict[str, np.ndarray], percent: int) -> np.ndarray:
    """Whether the list is among the first (lists - t + 1) of both classes of each pair, of different components and like length."""
    t = _least(c["n"], d["n"], percent)
    return (c["comp"] != d["comp"]) & _alike(c["n"], d["n"], percent) & (c["at"] <= c["lists"] - t) & (d["at"] <= d["lists"] - t)


STARS = "head boolean, shingle long, cid long, comp long, n int, at int, lists int, lack int, lead long"
_STARS = ["head", "shingle", "cid", "comp", "n", "at", "lists", "lack", "lead"]


def _stars(percent: int, leaders: bool):
    """Of postings sorted by list and a random order: (leader, member) of different components.

    With ``leaders``, a salted part of a long list also sends its own leader (``head``) for the list's next pass.
    """

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = None
        for b in batches:
            if not b.num_rows:
                continue
            c = _join(head, _columns(b))
            new = _starts(c, ["shingle", "salt"])
            first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
            lead = _take(c, first)
            ok = _reach(c, lead, percent)
            out = _take(c, ok) | {"head": np.zeros(int(ok.sum()), bool), "lead": lead["cid"][ok]}
            if leaders:
                sel = new & c["hot"]
                if head is not None:
                    sel[0] = False
                own = _take(c, sel)
                own |= {"head": np.ones(len(own["cid"]), bool), "lead": own["cid"]}
                out = {k: np.concatenate([out[k], own[k]]) for k in _STARS}
            head = _take(c, slice(first[-1], first[-1] + 1))
            if len(out["cid"]):
                yield _batch(out, _STARS)

    return go


def _across(percent: int):
    """Of list blocks (bounded): the pairs that meet there, each once a list."""

    def pairs_of(c: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        group = np.cumsum(_starts(c, ["shingle", "lo", "hi"]))
        for d in range(1, len(group)):
            i = np.flatnonzero(group[:-d] == group[d:])
            if not len(i):
                break
            j = i + d
            ok = _reach(_take(c, i), _take(c, j), percent) & ((c["lo"][i] == c["hi"][i]) | (c["side"][i] != c["side"][j]))
            if ok.any():
                a, b = c["cid"][i[ok]], c["cid"][j[ok]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["lead", "cid"])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            c = _join(held, _columns(b))
            cut = int(np.flatnonzero(_starts(c, ["shingle", "lo", "hi"]))[-1])
            held = _take(c, slice(cut, None))
            if cut:
                yield from pairs_of(_take(c, slice(0, cut)))
        if held is not None:
            yield from pairs_of(held)

    return go


def divide_skip(query: np.ndarray, sets: list[np.ndarray], wanted: np.ndarray) -> np.ndarray:
    """Which sets share at least ``wanted`` elements with ``query`` (all sorted and distinct).

    The block's inverted lists of the query's elements are divided: the longest are kept aside, a heap
    merges the others, and the sets that the long ones could still lift to their count are probed there.
    """
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    if not len(query) or not len(owner):
        return wanted <= 0
    flat = np.concatenate(sets)
    at = np.minimum(np.searchsorted(query, flat), len(query) - 1)
    hit = query[at] == flat
    order = np.argsort(at[hit], kind="stable")  # stable: each list holds its sets in order
    at, owner = at[hit][order], owner[hit][order]
    cut = np.searchsorted(at, np.arange(len(query) + 1))
    length = np.diff(cut)
    least = max(int(wanted.min()), 1)
    aside = min(least - 1, int(least / (0.0085 * np.log2(max(2, int(length.max(initial=0)))) + 1)))
    by_length = np.argsort(length, kind="stable")
    short, long = by_length[: len(query) - aside], by_length[len(query) - aside :]
    count = np.zeros(len(sets), np.int64)
    for i in heapq.merge(*[owner[cut[q] : cut[q + 1]].tolist() for q in short if length[q]]):
        count[i] += 1
    may = np.flatnonzero(count >= wanted - aside)
    for q in long if len(may) else []:
        part = owner[cut[q] : cut[q + 1]]
        if len(part):
            count[may] += part[np.minimum(np.searchsorted(part, may), len(part) - 1)] == may
    return count >= wanted


def _verify(percent: int):
    """Of (leader text, then its members' texts) streams: the linked (lead, cid)."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, query = None, None
        for b in batches:
            lead, salt, cid = (b.column(x).to_numpy() for x in ("lead", "salt", "cid"))
            is_lead = b.column("is_lead").to_numpy(zero_copy_only=False)
            sets = textkit.shingle_sets(*textkit.buffers(b.column("text")), WORDS)
            new = np.flatnonzero(_starts({"lead": lead, "salt": salt}, ["lead", "salt"])) if len(lead) else []
            u, v = [], []
            for a, z in zip(new, [*new[1:], len(lead)], strict=True):
                if (lead[a], salt[a]) != key:
                    key, query = (lead[a], salt[a]), None
                rows = range(a, z)
                if is_lead[a]:
                    query, rows = sets[a], range(a + 1, z)
                for lo in range(rows.start, rows.stop, BLOCK):
                    block = sets[lo : min(lo + BLOCK, rows.stop)]
                    wanted = need(np.array([len(s) for s in block]), len(query), percent)
                    ok = np.flatnonzero(divide_skip(query, block, wanted)) + lo
                    u.append(lead[ok])
                    v.append(cid[ok])
            if u:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], names=["lead", "cid"])

    return go


def _near(small: DataFrame) -> DataFrame:
    """``small`` marked for broadcast if it has at most ``MAX_SOUGHT`` rows; else it meets its partner by a shuffle."""
    return F.broadcast(small) if small.count() <= MAX_SOUGHT else small


def _untried(pairs: DataFrame, tried: list[DataFrame]) -> DataFrame:
    """The pairs that no round before has answered, from either end."""
    for old in tried:
        for lead, cid in (("lead", "cid"), ("cid", "lead")):
            pairs = pairs.join(old.select(F.col(lead).alias("lead"), F.col(cid).alias("cid")), ["lead", "cid"], "left_anti")
    return materialize(pairs, "nd-fresh") if tried else pairs


def _probed(pairs: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """The pairs (lead, cid) that share as many posted shingles, the long lists' included, as a link needs."""
    of = lambda end, tag: held.select(F.col("cid").alias(end), F.col("n").cast("long").alias(f"n_{tag}"), F.col("shingles").alias(f"s_{tag}"))
    one = materialize(of("lead", "a").join(_near(pairs), "lead"), "nd-probe")
    both = of("cid", "b").join(_near(one), "cid")
    shared = F.size(F.array_intersect("s_a", "s_b"))
    out = materialize(both.where(shared >= _least_column(F.col("n_a"), F.col("n_b"), percent)).select("lead", "cid"), "nd-pairs")
    discard(one)
    return out


def _links(pairs: DataFrame, docs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (lead, cid) whose sets link. A popular leader's members are dealt over many tasks."""
    size = pairs.groupBy("lead").agg(F.count(F.lit(1)).alias("k"))
    parts = F.ceil(F.col("k") / (2 * BLOCK)).cast("int")
    members = pairs.join(size, "lead").select("lead", F.pmod(F.xxhash64("cid"), parts).cast("int").alias("salt"), "cid", F.lit(False).alias("is_lead"))
    heads = size.select("lead", F.explode(F.sequence(F.lit(0), parts - 1)).alias("salt"), F.col("lead").alias("cid"), F.lit(True).alias("is_lead"))
    # a class is read from the row of its smallest id, or of none; the text's hash tells rows of one id apart
    ends = materialize(classes.withColumnsRenamed({"doc_id": "__id", "text_key": "__key"}).join(heads.unionByName(members), "cid"), "nd-ends")
    rows = docs.join(_near(ends), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__key"))).select("lead", "salt", "is_lead", "cid", "text")
    dealt = rows.repartition("lead", "salt").sortWithinPartitions("lead", "salt", F.desc("is_lead"))
    out = materialize(dealt.mapInArrow(_verify(percent), "lead long, cid long").where("lead != cid").distinct(), "nd-links")
    discard(ends)
    return out


def _propagate(links: DataFrame, labels: DataFrame | None) -> DataFrame | None:
    """``labels`` (cid, comp) of all classes linked so far, each with its component's smallest class.

    The links are taken to the components they join; those labels fall until none falls any more,
    which ends as a label only falls and is a class's number.
    """
    if labels is None:
        ends = links.select(F.col("lead").alias("u"), F.col("cid").alias("v"))
    else:
        of = lambda c, to: labels.select(F.col("cid").alias(c), F.col("comp").alias(to))
        ends = links.join(of("lead", "cu"), "lead", "left").join(of("cid", "cv"), "cid", "left").select(F.coalesce("cu", "lead").alias("u"), F.coalesce("cv", "cid").alias("v")).where("u != v")
    both = materialize(ends.unionByName(ends.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "nd-edges")
    if both.isEmpty():
        discard(both)
        return labels
    nodes = both.select(F.col("u").alias("cid")).distinct()
    own = materialize(nodes.withColumn("comp", F.col("cid")), "nd-step")
    while True:
        near = both.join(own.withColumnRenamed("cid", "v"), "v").groupBy("u").agg(F.min("comp").alias("m"))
        step = own.join(near.withColumnRenamed("u", "cid"), "cid").select("cid", F.col("comp").alias("old"), F.least("comp", "m").alias("comp"))
        # a label is a class too: everything that had my old label follows the smallest any of them saw
        jump = step.groupBy("old").agg(F.min("comp").alias("to"))
        after = materialize(step.join(jump, "old").select("cid", "old", F.least("comp", "to").alias("comp")), "nd-step")
        discard(own)
        own = after.select("cid", "comp")
        own.scratch = after.scratch
        if after.where("comp != old").isEmpty():
            break
    if labels is None:
        out = own
    else:
        known = labels.unionByName(nodes.withColumn("comp", F.col("cid"))).distinct()
        out = known.join(own.select(F.col("cid").alias("comp"), F.col("comp").alias("now")), "comp", "left").select("cid", F.coalesce("now", "comp").alias("comp"))
    out = materialize(out, "nd-labels")
    discard(both, own, labels)
    return out


def _divided(held: DataFrame, percent: int, labels: DataFrame | None = None) -> DataFrame:
    """The postings of the short lists: of each class the first (lists - t + 1), shortest list first, with t for the
    partner in the list that needs least. With ``labels``, only lists that more than one component shares count."""
    held = held.withColumn("comp", F.col("cid")) if labels is None else held.join(labels, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    rows = held.select(F.explode("shingles").alias("shingle"), "cid", "n", "comp")
    stats = rows.groupBy("shingle").agg(F.count(F.lit(1)).cast("int").alias("k"), F.min("n").alias("least_n"), F.max("n").alias("most_n"), F.min("comp").alias("a"), F.max("comp").alias("b")).where("a != b").drop("a", "b")
    own = Window.partitionBy("cid").orderBy("k", "shingle")
    rows = rows.join(stats, "shingle").withColumns({"at": F.row_number().over(own) - 1, "lists": F.count(F.lit(1)).over(own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).cast("int")})
    n = F.col("n").cast("long")
    small, large = F.greatest(F.col("least_n").cast("long"), F.ceil(n * percent / 100)), F.least(F.col("most_n").cast("long"), F.floor(n * 100 / percent))
    t = F.greatest(F.lit(1), F.least(_least_column(n, small, percent), _least_column(n, large, percent)) - 1)  # 1 less, as sizes between may round to less
    return rows.where(F.col("at") <= F.col("lists") - t).select("shingle", "cid", "comp", "n", "at", "lists", "k")


def _star_round(short: DataFrame, labels: DataFrame | None, turn: int, percent: int) -> DataFrame:
    """Candidates (lead, cid) of one round."""
    rows = short if labels is None else short.drop("comp").join(labels, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    parts = F.ceil(F.col("k") / PART)
    # how much of a class's prefix nobody else has: a copy without edits lacks least and leads first
    lack = F.floor(100 - 100 * F.col("lists") / (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)).cast("int")
    rows = rows.withColumns({"hot": parts > 1, "salt": F.pmod(F.xxhash64("cid"), parts).cast("int"), "order": F.xxhash64("cid", F.lit(turn)), "lack": lack}).drop("k")
    order = ["lack", "order"] if turn % 2 == 0 else ["order"]
    out = materialize(rows.repartition("shingle", "salt").sortWithinPartitions("shingle", "salt", *order).mapInArrow(_stars(percent, True), STARS), "nd-stars")
    heads = out.where("head").select("shingle", "cid", "comp", "n", "at", "lists", "lack", F.lit(True).alias("hot"), F.lit(0).alias("salt"), F.xxhash64("cid", F.lit(turn)).alias("order"))
    more = heads.repartition("shingle").sortWithinPartitions("shingle", *order).mapInArrow(_stars(percent, False), STARS)
    pairs = materialize(out.where("NOT head").unionByName(more).select("lead", "cid").distinct(), "nd-met")
    discard(out)
    return pairs


def _last_round(held: DataFrame, labels: DataFrame | None, percent: int) -> DataFrame:
    """All candidates (lead, cid) of different components that are left."""
    short = materialize(_divided(held, percent, labels), "nd-mixed")
    mixed = short.groupBy("shingle").agg(F.count(F.lit(1)).alias("m"), F.min("comp").alias("a"), F.max("comp").alias("b")).where("a != b").select("shingle", F.ceil(F.col("m") / (4 * BLOCK)).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")
    rows = short.join(mixed, "shingle").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("shingle", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), (F.col("own") <= F.col("other")).alias("side"), "cid", "comp", "n", "at", "lists")
    pairs = rows.repartition("shingle", "lo", "hi").sortWithinPartitions("shingle", "lo", "hi").mapInArrow(_across(percent), "lead long, cid long")
    pairs = materialize(pairs.distinct(), "nd-met")
    discard(short)
    return pairs


def components(docs: DataFrame, percent: int = PERCENT, *keep: str) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of every row; with "text_key" a hash of its text, with "comp"
    its component's own key (null for empty sets), which needs no ids."""
    docs = documents(docs)
    spark = docs.sparkSession
    seen = materialize(docs.withColumn("text_key", F.xxhash64("text")).mapInArrow(_sets, "is_doc boolean, doc_id long, text_key long, cid long, n long"), "nd-sets")
    sets = seen.where("is_doc")
    counted = seen.where("NOT is_doc").groupBy("cid").agg(F.sum("n").alias("n")).where(F.col("n") >= LONG).orderBy(F.desc("n"), "cid").limit(MAX_LONG).select("cid").toArrow()
    by_count = np.array(counted.column("cid"), np.int64).view(np.uint64)
    by_key = np.argsort(by_count)
    long = spark.sparkContext.broadcast((by_count[by_key], (len(by_count) - 1 - by_key).astype(np.uint32)))  # sorted shingles, and their place by rising count
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("cid"), F.lit(SALT))).otherwise(F.lit(0)).cast("int")
    posted = docs.mapInArrow(_postings(long, percent), "shingle long, cid long, n int, hot boolean").withColumn("salt", salt)
    lists = posted.repartition("shingle", "salt").sortWithinPartitions("shingle", "salt", "cid").mapInArrow(_shared, "shingle long, cid long, n int, hot boolean")
    lists = materialize(lists.drop("hot"), "nd-lists")
    held = materialize(lists.groupBy("cid").agg(F.min("n").alias("n"), F.collect_list("shingle").alias("shingles")), "nd-held")  # a class's posted shingles that others post too
    discard(lists)
    short = materialize(_divided(held, percent), "nd-short")
    classes = materialize(sets.where("n > 0").groupBy("cid").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("row")).select("cid", "row.doc_id", "row.text_key"), "nd-classes")
    labels, tried, turn = None, [], 0
    while turn <= STAR_ROUNDS:
        met = _star_round(short, labels, turn, percent) if turn < STAR_ROUNDS else _last_round(held, labels, percent)
        fresh = _untried(met, tried)
        before = labels
        if not fresh.isEmpty():
            pairs = _probed(fresh, held, percent)
            links = _links(pairs, docs, classes, percent)
            labels = _propagate(links, labels)
            tried.append(pairs)
            discard(links)
        discard(met, *([fresh] if fresh is not met else []))
        turn = STAR_ROUNDS if labels is before and turn < STAR_ROUNDS else turn + 1  # stars that join nothing give way to the last round
    root = classes.withColumn("comp", F.col("cid")) if labels is None else classes.join(labels, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    first = root.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    named = materialize(root.join(first, "comp").select("cid", "comp", "component_id"), "nd-named")
    discard(held, short, classes, labels, *tried)
    out = sets.join(named, "cid", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"), *keep)


def deduplicate(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row of each component: that with its smallest id, of several texts under it the one with the smaller
    hash; a null id comes last. Rows of one id (or of none) and text count as one document; unrelated texts under
    one id all stay, as do empty ones."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = materialize(components(slim, percent, "text_key", "comp"), "nd-found")
    best = found.where("n_shingles > 0").groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("row"))
    # what goes is less than what stays, so rows are looked up in that; all but a few pass without a shuffle
    same = (F.col("row.doc_id").eqNullSafe(F.col("doc_id"))) & (F.col("row.text_key") == F.col("text_key"))
    gone = found.where("n_shingles > 0").join(best, "comp").where(~same).select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct()
    twice = found.groupBy("doc_id", "text_key").count().where("count > 1").select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"))
    gone, twice = materialize(gone, "nd-gone"), materialize(twice, "nd-twice")
    discard(found)
    rows = docs.withColumn("__text_key", F.xxhash64(F.col("text").cast("string")))
    on = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__text_key") == F.col("__key"))
    kept = rows.join(_near(gone), on, "left_anti")
    if twice.isEmpty():
        return kept.select(*docs.columns)
    near = _near(twice)
    once = kept.join(near, on, "left_semi").dropDuplicates(["doc_id", "__text_key"])
    return kept.join(near, on, "left_anti").unionByName(once).select(*docs.columns)


def run(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    return components(docs, percent)
