"""Quality classifier: Naive Bayes support vectors (component 1).

Features are n-gram indicators: hashed word uni- and bigrams, and uni- to trigrams of word
shapes (case pattern, end mark, whether the word repeats its predecessor), each with one
indicator per share of the text it reaches. Indicators are scaled by their class log-count ratio
and a linear L1-hinge model is fitted to them by dual coordinate descent.

The model is fitted in the driver on at most ``fit_rows`` labelled documents (a hash sample of
the learning fold), so its cost does not grow with the corpus; the ``BUCKETS`` weights are sent
to the executors and every whole text is scored by a map. Margins become probabilities by a
logistic fit on labelled rows left out of the descent.

Defined cases: null and empty texts get the intercept's score; texts of any length are read whole. A
document labelled more than once counts once per label row, repeated documents once per row; learning
rows are put in order of id, text and label first, so the layout of the files changes no score. Labels
other than 0 and 1, and those without an id or a document, are left out. Without labels of both
classes every score is the label share (0.5 if none). Scores that tie are all given; columns beside
doc_id and text are not read, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit
from .common import documents, fold, hashed_below, sample_fraction

BITS = 17
BUCKETS = 1 << BITS
FIT_ROWS = 4000
ALPHA = 1.0
C = 1.0
EPOCHS = 15
THRESHOLD = 0.7
#: a shape n-gram has one indicator more for each of these shares of the words it reaches
SHARES = (0.02, 0.10, 0.30)

_CLASS = np.zeros(256, np.uint64)
_CLASS[65:91] = 1
_CLASS[97:123] = 2
_CLASS[48:58] = 3
_CLASS[128:] = 4


def shapes(data: np.ndarray, s: np.ndarray, e: np.ndarray, h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """A code for each word's look: first and second character class, end mark, length, repetition."""
    first = _CLASS[data[s]]
    second = np.where(e - s > 1, _CLASS[data[np.minimum(s + 1, len(data) - 1)]], np.uint64(7))
    last = data[e - 1].astype(np.uint64)
    mark = np.where(_CLASS[data[e - 1]] == 0, last, np.uint64(0))
    mark2 = np.where((_CLASS[data[np.maximum(e - 2, s)]] == 0) & (e - s > 1), data[np.maximum(e - 2, s)].astype(np.uint64), np.uint64(0))
    repeat = np.zeros(len(s), np.uint64)
    repeat[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    return textkit.mix(first | (second << np.uint64(3)) | (mark << np.uint64(6)) | (mark2 << np.uint64(14)) | (repeat << np.uint64(22)) | ((e - s > 24).astype(np.uint64) << np.uint64(23)))


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets by document and the sorted distinct feature buckets of each document of a batch."""
    data, off = textkit.buffers(texts)
    docs = len(off) - 1
    s, e, doc = textkit.words(data, off)
    if not len(s):
        return np.zeros(docs + 1, np.int64), np.zeros(0, np.int64)
    h = textkit.word_hashes(textkit.LOWER[data], s, e)
    sh = shapes(data, s, e, h, doc)
    size = np.bincount(doc, minlength=docs)
    shift = np.uint64(64 - BITS)
    keys = []

    def add(hashes: np.ndarray, at: np.ndarray, tag: int) -> None:
        keys.append((at.astype(np.uint64) << np.uint64(BITS)) | (textkit.mix(hashes ^ np.uint64(tag)) >> shift))

    for n in (1, 2):
        g, ok = textkit.ngram_hashes(h, doc, n) if n > 1 else (h, np.ones(len(h), bool))
        add(g[ok], doc[: len(ok)][ok], n)
    for n in (1, 2, 3):
        g, ok = textkit.ngram_hashes(sh, doc, n) if n > 1 else (sh, np.ones(len(sh), bool))
        g, at = g[ok], doc[: len(ok)][ok]
        key = np.sort((at.astype(np.uint64) << np.uint64(40)) | (g >> np.uint64(24)))
        cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        count = np.diff(np.concatenate([cut, [len(key)]]))
        at, g = (key[cut] >> np.uint64(40)).astype(np.int64), key[cut] & np.uint64((1 << 40) - 1)
        for level, share in enumerate((0.0, *SHARES)):
            m = count >= share * size[at]
            add(g[m], at[m], 100 + 10 * n + level)
    key = textkit.distinct(np.concatenate(keys))
    at = (key >> np.uint64(BITS)).astype(np.int64)
    return np.searchsorted(at, np.arange(docs + 1)), (key & np.uint64(BUCKETS - 1)).astype(np.int64)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cut, feat = features(b.column("text"))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("key"), b.column("y"), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(feat, pa.int32()))], names=["doc_id", "key", "y", "f"])


def fit_svm(rows: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights by bucket (ratio folded in) and bias; y is -1 or 1."""
    p, q = np.full(BUCKETS, ALPHA), np.full(BUCKETS, ALPHA)
    for f, t in zip(rows, y, strict=True):
        (p if t > 0 else q)[f] += 1
    ratio = np.log((p / p.sum()) / (q / q.sum()))
    seen = (p + q) >= 2 * ALPHA + 2
    ratio[~seen] = 0.0  # an n-gram of one document tells nothing
    w, bias, alpha = np.zeros(BUCKETS), 0.0, np.zeros(len(rows))
    scaled = [(f[seen[f]], ratio[f[seen[f]]]) for f in rows]
    scaled = [(f, x / (np.sqrt((x * x).sum()) or 1.0)) for f, x in scaled]
    weight = {1: C * len(y) / (2 * max(1, (y > 0).sum())), -1: C * len(y) / (2 * max(1, (y < 0).sum()))}
    rng = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            f, x = scaled[i]
            q_ii = 2.0 if len(f) else 1.0  # unit vector and the bias feature
            g = y[i] * (w[f] @ x + bias) - 1
            new = min(max(alpha[i] - g / q_ii, 0.0), weight[int(y[i])])
            if new != alpha[i]:
                w[f] += (new - alpha[i]) * y[i] * x
                bias += (new - alpha[i]) * y[i]
                alpha[i] = new
    return np.stack([w, ratio]), bias


def margins(cut: np.ndarray, feat: np.ndarray, w: np.ndarray, bias: float) -> np.ndarray:
    docs = len(cut) - 1
    at = np.repeat(np.arange(docs), np.diff(cut))
    r = w[1][feat]
    dot = np.bincount(at, weights=w[0][feat] * r, minlength=docs)
    norm = np.sqrt(np.bincount(at, weights=r * r, minlength=docs))
    return dot / np.where(norm > 0, norm, 1.0) + bias


def logistic(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the probability of y = 1 by Newton steps, with smoothed targets."""
    n1, n0 = (y > 0).sum(), (y < 0).sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        v = np.maximum(p * (1 - p), 1e-6)
        g = np.array([((p - t) * m).sum() + 1e-3 * a, (p - t).sum()])
        hess = np.array([[(v * m * m).sum() + 1e-3, (v * m).sum()], [(v * m).sum(), v.sum() + 1e-9]])
        step = np.linalg.solve(hess, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(a), float(b)


def labelled(docs: DataFrame, labels: DataFrame, label: str, learnable: Column, bound: int) -> DataFrame:
    """Ids, texts, their hashes and 0/1 labels ``y`` of a hash sample of about ``bound`` labelled learning rows."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull()).where(learnable)
    picked = rows.where(hashed_below(F.col("doc_id"), sample_fraction(bound, rows.count())))
    return documents(docs).join(F.broadcast(picked), "doc_id").withColumn("key", F.xxhash64("text"))  # the bound holds for the broadcast side


#: the order of learning rows, whatever order they arrive in
ORDER = [("doc_id", "ascending"), ("key", "ascending"), ("y", "ascending")]


def learn(docs: DataFrame, labels: DataFrame, label: str, learnable: Column, fit_rows: int = FIT_ROWS) -> dict:
    got = labelled(docs, labels, label, learnable, fit_rows).select("doc_id", "key", "y", "text").mapInArrow(_features, "doc_id long, key long, y int, f array<int>").toArrow().sort_by(ORDER)
    y = np.where(got.column("y").to_numpy() == 1, 1.0, -1.0)
    if len(set(y)) < 2:
        return {"w": np.zeros((2, BUCKETS)), "bias": 0.0, "a": 0.0, "b": 0.0 if not len(y) else 4.0 * y[0]}
    f = got.column("f").combine_chunks()
    f = f.chunk(0) if isinstance(f, pa.ChunkedArray) else f
    cut, flat = f.offsets.to_numpy(), f.values.to_numpy()
    rows = [flat[cut[i] : cut[i + 1]] for i in range(len(y))]
    left = np.array([int(r.sum()) * 2654435761 % 997 < 200 for r in rows])
    if len(set(y[left])) < 2 or len(set(y[~left])) < 2:
        left[:] = True
        train = np.ones(len(y), bool)
    else:
        train = ~left
    w, bias = fit_svm([r for r, t in zip(rows, train, strict=True) if t], y[train])
    m = np.array([margins(np.array([0, len(r)]), r, w, bias)[0] for r in rows])
    a, b = logistic(m[left], y[left])
    return {"w": w, "bias": bias, "a": a, "b": b}


def probabilities(texts: pa.Array, model: dict) -> np.ndarray:
    cut, feat = features(texts)
    m = margins(cut, feat, model["w"], model["bias"])
    return 1 / (1 + np.exp(-np.clip(model["a"] * m + model["b"], -30, 30)))


def score(docs: DataFrame, model: dict) -> DataFrame:
    """``doc_id`` and ``score`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(probabilities(b.column("text"), shared.value))], names=["doc_id", "score"])

    return documents(docs).mapInArrow(go, "doc_id long, score double")


def run(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = learn(docs, labels, "quality", fold(4) != 2)
    return score(docs, model).select("doc_id", (fold(4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
