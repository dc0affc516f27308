"""Near duplicates and repeated strings against brute force."""

import bisect
import collections
import hashlib
import random
import re

import numpy as np
import pytest

from millrace.llm import common, near_dup, suffix_dedup
from tests.llm.conftest import prose

TO_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(t):
    w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(TO_LOWER))
    return frozenset(zip(*[w[k:] for k in range(5)], strict=False)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def components(texts):
    sets = [shingles(t) for t in texts]
    top = list(range(len(texts)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * shared >= 80 * (len(sets[a]) + len(sets[b]) - shared):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in range(len(texts))}


def check(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.run(df).collect()}
    assert got == components(texts)


def test_components_with_all_odd_cases(docs, texts, empty):
    rows = near_dup.run(docs).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == components(texts) and len(rows) == len(texts) + 1
    assert near_dup.run(empty).count() == 0
    kept = near_dup.deduplicate(docs)
    want = {c for _, c in components(texts).values()}
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(want)
    assert near_dup.deduplicate(empty).count() == 0


def test_survivors_with_null_and_repeated_ids(spark):
    """Each component keeps one row, whatever its ids: none, one for unrelated texts, or one with an empty text too."""
    rng = random.Random(12)
    a, b, c, d, e, f = (prose(rng, 80) for _ in range(6))
    near = " ".join(["edited", *a.split(" ")[1:]])
    rows = [(None, a), (None, near), (None, b), (None, c), (None, c), (7, d), (7, e), (9, None), (9, f), (11, f), (12, b)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in near_dup.deduplicate(df).collect()), key=str)
    first = [x for x in got if x[1] in (a, near)]
    assert len(first) == 1 and first[0][0] is None
    assert sorted([x for x in got if x not in first], key=str) == sorted([(None, c), (7, d), (7, e), (9, None), (9, f), (12, b)], key=str)


def test_chains_borders_and_long_lists(spark, monkeypatch):
    """Chains of edits, sizes at the border of the threshold, and a text that a third of the rows edit."""
    monkeypatch.setattr(near_dup, "LONG", 3)
    rng = random.Random(11)
    texts = []
    for n in (9, 14, 30, 60):
        w = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        for _ in range(12):
            texts.append(" ".join(w))
            for _ in range(max(1, n // 25)):
                w[rng.randrange(n)] = f"w{rng.randrange(10**6)}"
            if rng.random() < 0.3:
                w.append(f"w{rng.randrange(10**6)}")
    hot = [f"h{i}" for i in range(80)]
    for _ in range(60):
        w = list(hot)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(80)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    shared = [f"p{i}" for i in range(50)]  # a common passage between different words must link nothing by itself
    texts += [" ".join([f"a{i}{j}" for j in range(30)] + shared + [f"b{i}{j}" for j in range(30)]) for i in range(40)]
    texts += [" ".join(shared + [f"c{i}{j}" for j in range(k)]) for i, k in enumerate((3, 5, 6, 8, 9, 10, 11, 12, 13, 14))]
    rng.shuffle(texts)
    check(spark, texts)


def test_blocks_of_long_lists(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 2)
    monkeypatch.setattr(near_dup, "STAR_ROUNDS", 0)
    monkeypatch.setattr(near_dup, "LONG", 4)
    rng = random.Random(5)
    base = [f"h{i}" for i in range(60)]
    texts = []
    for _ in range(40):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    check(spark, texts)


def counted(monkeypatch):
    """Rows of each table that the operator writes."""
    rows = collections.defaultdict(int)
    write = near_dup.materialize

    def count(df, name):
        out = write(df, name)
        rows[name] += out.count()
        return out

    monkeypatch.setattr(near_dup, "materialize", count)
    return rows


def test_groups_make_rows_in_proportion(spark, monkeypatch):
    """Twice the members of a linked group (1 edit) and of one that is not (9) make about twice the candidates, not four times."""
    rows = counted(monkeypatch)
    made = []
    for k in (80, 160):
        rng = random.Random(3)
        texts = []
        for edits in (1, 9):
            base = [f"h{edits}x{i}" for i in range(200)]
            texts.append(" ".join(base))
            for i in range(k):
                w = list(base)
                for e in range(edits):
                    w[rng.randrange(200)] = f"x{i}e{e}of{edits}"
                texts.append(" ".join(w))
        rows.clear()
        check(spark, texts)
        made.append(rows["nd-met"] + rows["nd-stars"] + rows["nd-mixed"])
    assert made[1] < 3 * made[0] + 50


def test_scratch_is_removed(spark, docs):
    """What is left is only what the result still reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(common.scratch(spark))
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = lambda: {s.getPath().getName() for s in system.listStatus(path)} if system.exists(path) else set()
    before = names()
    near_dup.run(docs).count()
    assert {n.rsplit("-", 1)[0] for n in names() - before} == {"nd-sets", "nd-named"}


def test_divide_skip_is_exact():
    rng = np.random.default_rng(1)
    for _ in range(200):
        query = np.unique(rng.integers(0, 60, rng.integers(0, 40))).astype(np.uint64)
        sets = [np.unique(rng.integers(0, 60, rng.integers(0, 40))).astype(np.uint64) for _ in range(rng.integers(1, 12))]
        wanted = rng.integers(0, 20, len(sets))
        got = near_dup.divide_skip(query, sets, wanted)
        assert got.tolist() == [len(np.intersect1d(query, s)) >= w for s, w in zip(sets, wanted, strict=True)]


def stripped(texts, length):
    raw = [(t or "").encode() for t in texts]
    count = collections.Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = {}
    for k, r in enumerate(raw):
        gone = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - length + 1):
            if count[r[i : i + length]] > 1:
                gone[i : i + length] = True
        out[k] = (len(r), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[0]), hashlib.sha256(bytes(b for b, g in zip(r, gone, strict=False) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("block", [suffix_dedup.BLOCK, 3000])
def test_repeated_strings(docs, texts, empty, block, spark):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.run(docs, block=block).collect()}
    assert got == {**stripped([*texts, texts[8]], 400)} | {8: got[8]} or got == {k: v for k, v in stripped([*texts, texts[8]], 400).items() if k < len(texts)}
    assert suffix_dedup.run(empty).count() == 0


@pytest.mark.parametrize("segment", [suffix_dedup.SEGMENT, 50])
def test_short_strings_by_brute_force(spark, monkeypatch, segment):
    monkeypatch.setattr(suffix_dedup, "SEGMENT", segment)
    rng = random.Random(7)
    parts = ["".join(rng.choice("abc") for _ in range(rng.randint(20, 120))) for _ in range(12)]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 6))) + rng.choice(["", "é", "ab" * 60]) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for block in (suffix_dedup.BLOCK, 500):
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.run(df, length=40, gram=16, block=block).collect()}
        assert got == stripped(texts, 40)


def test_cover_sample_ranks_decide_all_ties():
    rng = np.random.default_rng(3)
    for length in (26, 40, 400):
        unit = rng.integers(0, 3, 700).astype(np.uint8)
        data = np.concatenate([unit, unit[: length + 60], np.tile(unit[:7], 120), rng.integers(0, 3, 200).astype(np.uint8), unit[100 : 160 + length]])
        start = np.arange(len(data) - length + 1)
        count = collections.Counter(data[i : i + length].tobytes() for i in start)
        want = [count[data[i : i + length].tobytes()] > 1 for i in start]
        assert suffix_dedup.repeated(data, start, length).tolist() == want


def test_suffix_order_is_the_lexicographic_one():
    """Places and weights of all suffixes, long ties included, are those of sorting the strings."""
    rng = np.random.default_rng(5)
    for length in (26, 40, 133):
        unit = rng.integers(0, 3, 300).astype(np.uint8)
        data = np.concatenate([unit, np.tile(unit[:5], 60), unit, rng.integers(0, 256, 90).astype(np.uint8), unit[: length + 9], np.full(length + 30, 255, np.uint8)])
        start = rng.permutation(len(data) - length + 1)[:500]
        weight = rng.integers(1, 4, len(start))
        less, equal = suffix_dedup.suffix_order(data, start, length, weight)
        text = [data[i : i + length].tobytes() for i in start]
        ordered = sorted(text)
        assert less.tolist() == [bisect.bisect_left(ordered, t) for t in text]
        total = collections.Counter()
        for t, w in zip(text, weight.tolist(), strict=True):
            total[t] += w
        assert equal.tolist() == [total[t] for t in text]


def test_every_distance_is_a_difference_of_the_cover():
    v, d = suffix_dedup.V, suffix_dedup.COVER
    assert sorted((a - b) % v for a in d for b in d if a != b) == list(range(1, v)), "each exactly once"
    assert prose(random.Random(0), 3)
