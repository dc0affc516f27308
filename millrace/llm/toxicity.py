"""Toxicity: subword-bag embeddings averaged into a linear softmax (component 5).

A word is the bag of its hashed character n-grams (3 to 5, with word borders) and itself; words of
a text are averaged and a two-class softmax reads the average. Embeddings and softmax are trained
jointly in numpy on random passages of ``PASSAGE`` words. A document's score joins the average of
its whole text with those of its worst short passages, so a lone insult in a long text counts;
how much each weighs is fitted on labelled rows left out of the training.

The model is fitted in the driver on at most ``fit_rows`` labelled documents (a hash sample of
the learning fold) and has ``BUCKETS * DIM`` numbers. As average and softmax are linear, scoring
needs one number per n-gram; whole texts are scored by a map, every passage of them.

Of a long text the executors send the driver ``EXCERPTS`` passages drawn at random, so what is
learned from is bounded in bytes (some 10 kB a row) as well as in rows; scoring reads whole texts.

Defined cases: null, empty and wordless texts get the score of an empty passage; texts of any length
are scored whole. Repeated rows are scored one by one, and a document labelled more than once counts
once per label row; learning rows are put in order of id, text and label first, so the layout of the
files changes no score. Without labels of both classes the score is constant. Scores that tie are all
given; columns beside doc_id and text are not read, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit
from .common import documents, fold
from .quality_classifier import ORDER, labelled

BUCKETS = 1 << 18
DIM = 4
#: words of a training passage
PASSAGE = 40
#: words of the passages whose worst average is read, beside the whole text's average
WINDOWS = (12, 40)
FIT_ROWS = 6000
#: passages of a long text that are learned from
EXCERPTS = 32
EPOCHS = 30
RATE = 1.0
#: descent steps an epoch has at least, so that few rows are learned as well as many
STEPS = 24
THRESHOLD = 0.7
#: how much more a toxic document weighs when the score is calibrated; they are the few
TOXIC_WEIGHT = 3.0
NGRAMS = (3, 4, 5)
#: distinct words whose n-grams are made at once
WORDS = 20_000


def subwords(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the words and the word each belongs to, word by word."""
    lens = e - s + 2
    first = np.cumsum(lens) - lens
    total = int(lens.sum())
    owner = np.repeat(np.arange(len(s)), lens)
    pos = np.arange(total) - first[owner]
    src = np.clip(s[owner] + pos - 1, 0, max(len(data) - 1, 0))
    b = np.where(pos == 0, 60, np.where(pos == lens[owner] - 1, 62, data[src])).astype(np.uint64)
    left = lens[owner] - pos
    keys, own = [], []
    acc = b
    for n in range(2, max(NGRAMS) + 1):
        acc = acc[:-1] * np.uint64(0x100000001B3) + b[n - 1 :]
        if n in NGRAMS:
            ok = left[: len(acc)] >= n
            keys.append(textkit.mix(acc[ok] + np.uint64(n)))
            own.append(owner[: len(acc)][ok])
    keys.append(textkit.mix(textkit.word_hashes(data, s, e)))
    own.append(np.arange(len(s)))
    k, o = np.concatenate(keys), np.concatenate(own)
    order = np.argsort(o, kind="stable")
    return (k[order] % np.uint64(BUCKETS)).astype(np.int32), o[order]


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers of a batch, word offsets by document, and the n-gram buckets of each distinct word with their offsets."""
    data, off = textkit.buffers(texts)
    low = textkit.LOWER[data]
    s, e, doc = textkit.words(low, off, textkit.NON_ALNUM)
    cut = np.searchsorted(doc, np.arange(len(off)))
    if not len(s):
        return np.zeros(0, np.int64), cut, np.zeros(0, np.int64), np.zeros(1, np.int64)
    _, at, word = np.unique(textkit.word_hashes(low, s, e), return_index=True, return_inverse=True)
    found = [subwords(low, s[at[k : k + WORDS]], e[at[k : k + WORDS]]) for k in range(0, len(at), WORDS)]
    size = np.concatenate([np.bincount(own, minlength=min(WORDS, len(at) - k * WORDS)) for k, (_, own) in enumerate(found)])
    return word, cut, np.concatenate([sub for sub, _ in found]), np.concatenate([[0], np.cumsum(size)])


def averages(score: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Per document: the whole text's average word score and the worst passage's at each width."""
    total = np.concatenate([[0.0], np.cumsum(score)])
    size = np.diff(cut)
    out = np.zeros((len(size), 1 + len(WINDOWS)))
    out[:, 0] = (total[cut[1:]] - total[cut[:-1]]) / np.maximum(size, 1)
    for j, width in enumerate(WINDOWS, 1):
        out[:, j] = out[:, 0]
        if len(score) >= width:
            mean = (total[width:] - total[:-width]) / width
            long = np.flatnonzero(size > width)
            if len(long):
                ends = np.stack([cut[long], cut[long + 1] - width + 1], 1).ravel()
                out[long, j] = np.maximum.reduceat(np.append(mean, -np.inf), ends)[::2]
    return out


class Net:
    """Embedding table and two-class softmax, trained together."""

    def __init__(self, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        self.emb = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float64)
        self.out = rng.normal(0, 0.1, (DIM, 2))
        self.bias = np.zeros(2)
        self.g_emb, self.g_out, self.g_bias = np.full((BUCKETS, DIM), 1e-6), np.full((DIM, 2), 1e-6), np.full(2, 1e-6)

    def direction(self) -> np.ndarray:
        """What each n-gram adds to the toxic log-odds."""
        return self.emb @ (self.out[:, 1] - self.out[:, 0])

    def step(self, word: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray, sub: np.ndarray, cut: np.ndarray) -> None:
        """One descent step on passages given as a matrix of words."""
        uniq = textkit.distinct(word[mask])
        inv = np.minimum(np.searchsorted(uniq, word), len(uniq) - 1)
        lens = cut[uniq + 1] - cut[uniq]
        first = np.cumsum(lens) - lens
        flat = sub[np.arange(int(lens.sum())) - np.repeat(first, lens) + np.repeat(cut[uniq], lens)]
        vec = np.add.reduceat(self.emb[flat], first, axis=0) / lens[:, None]
        n = np.maximum(mask.sum(1), 1)
        hid = (vec[inv] * mask[:, :, None]).sum(1) / n[:, None]
        z = hid @ self.out + self.bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        d = (p - np.eye(2)[y]) * (weight / weight.sum())[:, None]
        d_hid = d @ self.out.T / n[:, None]
        flat_d = np.broadcast_to(d_hid[:, None, :], (*word.shape, DIM))[mask]
        at = inv[mask]
        d_vec = np.stack([np.bincount(at, weights=flat_d[:, k], minlength=len(uniq)) for k in range(DIM)], 1) / lens[:, None]
        own = np.repeat(np.arange(len(uniq)), lens)
        d_emb = np.stack([np.bincount(flat, weights=d_vec[own, k], minlength=BUCKETS) for k in range(DIM)], 1)
        for v, g, acc in ((self.emb, d_emb, self.g_emb), (self.out, hid.T @ d, self.g_out), (self.bias, d.sum(0), self.g_bias)):
            acc += g * g
            v -= RATE * g / np.sqrt(acc)


def fit(texts: pa.Array, y: np.ndarray) -> dict:
    rng = np.random.default_rng(5)
    word, cut, sub, sub_cut = tokens(texts)
    docs = np.flatnonzero(np.diff(cut) > 0)
    if len(set(y[docs])) < 2:
        return {"t": np.zeros(BUCKETS), "bias": 0.0, "coef": np.zeros(1 + len(WINDOWS)), "b": 0.0 if not len(y) else (4.0 if y.mean() > 0.5 else -4.0)}
    left = rng.random(len(docs)) < 0.25
    if len(set(y[docs[left]])) < 2 or len(set(y[docs[~left]])) < 2:
        left[:] = False
    train, test = docs[~left], docs[left] if left.any() else docs
    size = np.diff(cut)
    net = Net()
    draws = np.where(y[train] == 1, max(1, round(2 * (y[train] == 0).sum() / max(1, (y[train] == 1).sum()) / 2)), 1)
    who = np.repeat(train, np.minimum(draws, 8))
    for _ in range(EPOCHS):
        st = cut[who] + rng.integers(0, np.maximum(1, size[who] - PASSAGE + 1))
        grid = st[:, None] + np.arange(PASSAGE)
        mask = grid < cut[who + 1][:, None]
        mat = word[np.minimum(grid, len(word) - 1)]
        for part in np.array_split(rng.permutation(len(st)), max(min(STEPS, len(st)), len(st) // 400)):
            net.step(mat[part], mask[part], y[who[part]], np.ones(len(part)), sub, sub_cut)
    t = net.direction()
    x = averages(word_scores(t, sub, sub_cut)[word], cut)
    bias = float(net.bias[1] - net.bias[0])
    coef, b = calibrate(x[test] + bias, np.where(y[test] == 1, 1.0, -1.0))
    return {"t": t, "bias": bias, "coef": coef, "b": b}


def calibrate(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic weights, none negative, of a document's averages: projected Newton with a ridge."""
    scale = x.std(0) + 1e-9
    z = np.concatenate([x / scale, np.ones((len(x), 1))], 1)
    n1, n0 = (y > 0).sum(), (y < 0).sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    w = np.zeros(z.shape[1])
    weight = np.where(y > 0, TOXIC_WEIGHT, 1.0)
    ridge = np.array([0.3] * x.shape[1] + [1e-6])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (weight * (p - t)) + ridge * w
        h = (z * (weight * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ z + np.diag(ridge)
        w = w - 0.7 * np.linalg.solve(h, g)
        w[:-1] = np.maximum(w[:-1], 0)
    return w[:-1] / scale, float(w[-1])


def word_scores(t: np.ndarray, sub: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Mean over a word's n-grams."""
    if len(cut) < 2:
        return np.zeros(0)
    return np.add.reduceat(t[sub], cut[:-1]) / np.diff(cut)


def probabilities(texts: pa.Array, model: dict) -> np.ndarray:
    word, cut, sub, sub_cut = tokens(texts)
    x = averages(word_scores(model["t"], sub, sub_cut)[word], cut)
    # sums run over a batch, so the last digits would tell where in it a text stood
    return np.round(1 / (1 + np.exp(-np.clip((x + model["bias"]) @ model["coef"] + model["b"], -30, 30))), 10)


def _excerpts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Long texts cut to passages drawn at random, by a draw that the text itself fixes."""
    for b in batches:
        texts = []
        for text, key in zip(b.column("text").to_pylist(), b.column("key").to_pylist(), strict=True):
            w = (text or "").split()
            if len(w) > EXCERPTS * PASSAGE:
                starts = np.sort(np.random.default_rng(key & 0x7FFFFFFF).integers(0, len(w) - PASSAGE, EXCERPTS))
                w = [x for a in starts for x in w[a : a + PASSAGE]]
            texts.append(" ".join(x[:256] for x in w))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("key"), b.column("y"), pa.array(texts, pa.string())], names=["doc_id", "key", "y", "text"])


def learn(docs: DataFrame, labels: DataFrame, label: str, learnable: Column, fit_rows: int = FIT_ROWS) -> dict:
    rows = labelled(docs, labels, label, learnable, fit_rows).select("doc_id", "key", "y", "text")
    got = rows.mapInArrow(_excerpts, "doc_id long, key long, y int, text string").toArrow().sort_by(ORDER)
    text = got.column("text").combine_chunks()
    text = text.chunk(0) if isinstance(text, pa.ChunkedArray) and text.num_chunks else text
    return fit(text if isinstance(text, pa.Array) else pa.array([], pa.string()), got.column("y").to_numpy().astype(int))


def score(docs: DataFrame, model: dict) -> DataFrame:
    """``doc_id`` and ``score`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(probabilities(b.column("text"), shared.value))], names=["doc_id", "score"])

    return documents(docs).mapInArrow(go, "doc_id long, score double")


def run(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = learn(docs, labels, "toxic", fold(3) != 1)
    return score(docs, model).select("doc_id", (fold(3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
