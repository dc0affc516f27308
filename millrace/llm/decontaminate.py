"""Benchmark decontamination by a BM25 index of the test items (component 6).

Every document is cut into overlapping passages of words, and every passage queries an inverted index
of the benchmark items. A posting's impact is its BM25 weight over the item's own full score, so one
threshold serves items of any length; word frequencies and the mean length are those of the whole
benchmark. Items are indexed by length class, the powers of two, and queried by passages of that
many words, so one long item widens no other's passages.

Block-max WAND, over all passages of a batch at once: items are numbered in blocks and each list is
cut at the blocks' borders, every cut with its greatest impact. Lists of words that most items share
only add a bound per block. A (passage, block) whose greatest impacts and bound do not reach the
threshold is skipped before any posting is read; in the others the rarer lists are summed, and items
that the shared words could still lift are scored exactly. All items above the threshold are
verified: the share of the three-word sequences of the item's question (all but its last sentence)
and of its answer (the last one) that stand in the text around the passage.

The index is built in the driver from at most ``SHARD`` items and ``SHARD_BYTES`` of text at a time;
a larger benchmark is split into shards and the corpus read once per shard, so what is broadcast is
bounded. Scores do not depend on the shards.

Defined cases: null, empty or wordless texts and items match nothing; repeated items are reported
under each of their ids (a null id as null), repeated documents once per row, equal scores by item;
texts of any length are read whole; of a document's columns only ``doc_id`` and ``text`` are used,
whatever others are called; an empty table on either side gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit
from .common import arrow_batches, documents, materialize

K1, BM_B = 1.2, 0.75
#: share of an item's own score that retrieves it
THRESHOLD = 0.4
#: shares of question and answer that confirm a leak
QUESTION, ANSWER = 0.6, 0.5
SHARD = 20_000
SHARD_BYTES = 32 << 20
ITEMS_PER_BLOCK = 8
MIN_PASSAGE = 64
SEQUENCE = 3
#: words that this share of the items holds are scored by bound first
COMMON = 0.05
#: (passage, term) rows that are scored at once, a passage never cut
PART = 100_000

FOUND = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def question_answer(text: str) -> tuple[str, str]:
    """All but the last sentence, and the last; a single sentence is halved by words."""
    parts = [p for p in _SENTENCE.split(text) if p.strip()]
    if len(parts) > 1:
        return " ".join(parts[:-1]), parts[-1]
    w = text.split()
    return " ".join(w[: len(w) - len(w) // 2]), " ".join(w[len(w) - len(w) // 2 :])


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each lower-cased word of a batch and word offsets by text."""
    data, off = textkit.buffers(texts)
    low = textkit.LOWER[data]
    s, e, doc = textkit.words(low, off, textkit.NON_ALNUM)
    return textkit.word_hashes(low, s, e), np.searchsorted(doc, np.arange(len(off)))


def sequences(h: np.ndarray) -> np.ndarray:
    """Distinct hashes of SEQUENCE consecutive words; of the words themselves if they are fewer."""
    if len(h) < SEQUENCE:
        return textkit.distinct(h)
    return textkit.distinct(textkit.ngram_hashes(h, np.zeros(len(h), np.int64), SEQUENCE)[0])


class Statistics:
    """What BM25 knows of a whole benchmark: items, their mean length, and the frequency of each word of a shard."""

    def __init__(self, items: int, mean: float, words: np.ndarray, df: np.ndarray) -> None:
        self.items, self.mean, self.words, self.df = items, mean, words, df

    @classmethod
    def of(cls, texts: list[str]) -> Statistics:
        size, words, df = counted(pa.array(texts, pa.string()))
        n = int((size > 0).sum())
        return cls(n, float(size.sum() / max(1, n)), words, df)


def counted(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text; the distinct words and in how many texts each stands."""
    h, cut = hashed_words(texts)
    own = np.repeat(np.arange(len(texts)), np.diff(cut))
    order = np.lexsort((own, h))
    h, own = h[order], own[order]
    once = np.ones(len(h), bool)
    once[1:] = (h[1:] != h[:-1]) | (own[1:] != own[:-1])
    words, df = np.unique(h[once], return_counts=True)
    return np.diff(cut), words, df


class Index:
    """Block-max lists over the items of one length class."""

    def __init__(self, ids: list[int | None], texts: list[str], known: Statistics | None = None, width: int | None = None) -> None:
        known = known or Statistics.of(texts)
        h, cut = hashed_words(pa.array(texts, pa.string()))
        size = np.diff(cut)
        keep = np.flatnonzero(size > 0)
        self.ids = [ids[i] for i in keep]
        n = len(keep)
        parts = [question_answer(texts[i]) for i in keep]
        self.question = self._parts([p[0] for p in parts])
        self.answer = self._parts([p[1] for p in parts])
        self.width = width or length_class(int(size.max(initial=0)))
        item, word, tf = [], [], []
        for k, i in enumerate(keep):
            u, c = np.unique(h[cut[i] : cut[i + 1]], return_counts=True)
            item.append(np.full(len(u), k))
            word.append(u)
            tf.append(c)
        if not n:
            self.vocab = np.zeros(0, np.uint64)
            return
        item, word, tf = np.concatenate(item), np.concatenate(word), np.concatenate(tf)
        self.vocab, term = np.unique(word, return_inverse=True)
        df = known.df[np.searchsorted(known.words, self.vocab)]
        idf = np.log(1 + (known.items - df + 0.5) / (df + 0.5))
        w = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - BM_B + BM_B * size[keep][item] / known.mean))
        own = np.bincount(item, weights=w, minlength=n)
        w = w / own[item]
        order = np.lexsort((item, term))
        self.item, self.impact, term = item[order], w[order], term[order]
        self.start = np.searchsorted(term, np.arange(len(self.vocab) + 1))
        self.common = df > max(1, COMMON * known.items)
        # a list is cut at the blocks' borders: cut k holds the postings cut_at[k] to cut_at[k + 1]
        block = self.item // ITEMS_PER_BLOCK
        self.blocks = int(block.max()) + 1
        key = term * self.blocks + block
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        self.cut_at = np.append(first, len(key))
        self.cut_block = block[first]
        self.cut_max = np.maximum.reduceat(self.impact, first)
        self.cuts = np.searchsorted(term[first], np.arange(len(self.vocab) + 1))
        # what the common lists can add to any item, and to the best one of a block
        rare = ~self.common[term]
        self.shared = np.bincount(self.item[~rare], weights=self.impact[~rare], minlength=n)
        self.bound = np.maximum.reduceat(self.shared, np.arange(0, n, ITEMS_PER_BLOCK))
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.vocab >> np.uint64(44)).astype(np.int64)] = True

    @staticmethod
    def _parts(texts: list[str]) -> list[tuple[bool, np.ndarray]]:
        """Per text whether it is too short for a sequence, and its sequences or else its words."""
        h, cut = hashed_words(pa.array(texts, pa.string()))
        return [(bool(cut[i + 1] - cut[i] < SEQUENCE), sequences(h[cut[i] : cut[i + 1]])) for i in range(len(texts))]

    def passages(self, h: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(passage, term) of every indexed word, distinct and sorted, and each document's first passage."""
        step = self.width // 2
        size = np.diff(cut)
        base = np.concatenate([[0], np.cumsum((size + step - 1) // step)])
        at = np.flatnonzero(self.filter[(h >> np.uint64(44)).astype(np.int64)])
        term = np.minimum(np.searchsorted(self.vocab, h[at]), len(self.vocab) - 1)
        ok = self.vocab[term] == h[at]
        at, term = at[ok], term[ok]
        doc = np.searchsorted(cut, at, side="right") - 1
        k = (at - cut[doc]) // step
        passage = base[doc] + k
        before = k > 0
        key = textkit.distinct(np.concatenate([passage * len(self.vocab) + term, (passage[before] - 1) * len(self.vocab) + term[before]]))
        return key // len(self.vocab), key % len(self.vocab), base

    def retrieve(self, passage: np.ndarray, term: np.ndarray) -> list[tuple[int, int, float]]:
        """(passage, item, score) of all pairs that reach the threshold."""
        # parts are cut between passages only, so that every sum is over the whole passage
        cuts = np.unique(np.concatenate([[0], np.searchsorted(passage, passage[PART::PART]), [len(passage)]]))
        return [x for a, z in zip(cuts[:-1], cuts[1:], strict=True) for x in self._part(passage[a:z], term[a:z])]

    def _part(self, passage: np.ndarray, term: np.ndarray) -> list[tuple[int, int, float]]:
        n, least = len(self.ids), THRESHOLD - 1e-9
        rare = ~self.common[term]
        key, cut = self._cuts(passage[rare], term[rare])
        live = np.zeros(0, np.int64)
        if len(key):
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            live = key[first][np.add.reduceat(self.cut_max[cut], first) + self.bound[key[first] % self.blocks] >= least]
        near, summed = self._scores(key, cut, live)
        near = near[summed + self.shared[near % n] >= least]
        lifted = np.flatnonzero(self.shared >= least)  # items that common words alone may lift
        if len(lifted):
            near = np.concatenate([near, (textkit.distinct(passage)[:, None] * n + lifted).ravel()])
        if not len(near):
            return []
        near = textkit.distinct(near)
        # exact: all lists of the passage, in the blocks of what is left
        rows = np.isin(passage, textkit.distinct(near // n))
        key, cut = self._cuts(passage[rows], term[rows])
        full, score = self._scores(key, cut, textkit.distinct(near // n * self.blocks + near % n // ITEMS_PER_BLOCK))
        at = np.minimum(np.searchsorted(full, near), max(len(full) - 1, 0))
        ok = (full[at] == near) & (score[at] >= least) if len(full) else np.zeros(len(near), bool)
        return [(int(k // n), int(k % n), float(x)) for k, x in zip(near[ok], score[at[ok]], strict=True)]

    def _cuts(self, passage: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys passage * blocks + block, sorted, and the list cut behind each."""
        size = (self.cuts[1:] - self.cuts[:-1])[term]
        flat = np.repeat(self.cuts[:-1][term] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        key = np.repeat(passage, size) * self.blocks + self.cut_block[flat]
        order = np.argsort(key, kind="stable")
        return key[order], flat[order]

    def _scores(self, key: np.ndarray, cut: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys passage * items + item and their summed impact, from the cuts of the live keys only."""
        at = np.minimum(np.searchsorted(live, key), max(len(live) - 1, 0))
        ok = live[at] == key if len(live) else np.zeros(len(key), bool)
        key, cut = key[ok], cut[ok]
        size = self.cut_at[cut + 1] - self.cut_at[cut]
        flat = np.repeat(self.cut_at[cut] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        pair = np.repeat(key // self.blocks, size) * len(self.ids) + self.item[flat]
        order = np.argsort(pair, kind="stable")
        pair = pair[order]
        if not len(pair):
            return pair, np.zeros(0)
        first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
        return pair[first], np.add.reduceat(self.impact[flat][order], first)

    def search(self, h: np.ndarray, cut: np.ndarray) -> dict[tuple[int, int], tuple[float, float, float]]:
        """By (row, item): score, question and answer overlap of the confirmed leaks, best passage each."""
        if not len(self.vocab):
            return {}
        passage, term, base = self.passages(h, cut)
        best: dict[tuple[int, int], tuple[float, float, float]] = {}
        step = self.width // 2
        for p, item, score in self.retrieve(passage, term):
            row = int(np.searchsorted(base, p, side="right")) - 1
            a = cut[row] + (p - base[row]) * step
            near = h[max(cut[row], a - self.width) : min(cut[row + 1], a + 2 * self.width)]
            seq, single = sequences(near), textkit.distinct(near)
            q, r = (float(np.isin(x, single if short else seq).mean()) if len(x) else 1.0 for short, x in (self.question[item], self.answer[item]))
            if q >= QUESTION and r >= ANSWER:
                k = (row, item)
                best[k] = max(best.get(k, (0.0, 0.0, 0.0)), (score, q, r))
        return best


def length_class(words: int) -> int:
    """Words of the passages that query items of so many words: the next power of two."""
    return max(MIN_PASSAGE, 1 << max(0, words - 1).bit_length())


class Shard:
    """The indexes of a bounded run of items, one for each length class."""

    def __init__(self, ids: list[int | None], texts: list[str], known: Statistics | None = None) -> None:
        size, words, _ = counted(pa.array(texts, pa.string()))
        self.words, known = words, known or Statistics.of(texts)
        widths = np.array([length_class(int(n)) for n in size], np.int64)
        self.classes = [Index([ids[i] for i in own], [texts[i] for i in own], known, int(w)) for w in np.unique(widths) for own in [np.flatnonzero((widths == w) & (size > 0))] if len(own)]

    def search(self, texts: pa.Array) -> list[tuple[int, int | None, float, float, float]]:
        """(row, item id, score, question and answer overlap) of the confirmed leaks."""
        h, cut = hashed_words(texts)
        found = [(row, index.ids[item], *v) for index in self.classes for (row, item), v in index.search(h, cut).items()]
        return sorted(found, key=lambda x: (x[0], x[1] is None, x[1] or 0, x[2:]))


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The number and words of a batch's items (word null), and in how many of them each word stands."""
    for b in batches:
        size, words, df = counted(b.column("text"))
        yield pa.RecordBatch.from_arrays([pa.array([None, *words.view(np.int64).tolist()], pa.int64()), pa.array([int((size > 0).sum()), *df.tolist()], pa.int64()), pa.array([int(size.sum()), *[0] * len(words)], pa.int64())], names=["word", "items", "words"])


def shards(items: DataFrame) -> Iterator[Shard]:
    """Indexes over bounded runs of items in order of their ids; a benchmark of one run needs no statistics beside it."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    spark, counts = items.sparkSession, None

    def statistics(texts: list[str]) -> Statistics:
        nonlocal counts
        if counts is None:
            counts = materialize(rows.select("text").mapInArrow(_item_words, "word long, items long, words long").groupBy("word").agg(F.sum("items").alias("items"), F.sum("words").alias("words")), "bench-words")
        total = counts.where("word IS NULL").first()
        own = pa.table({"word": counted(pa.array(texts, pa.string()))[1].view(np.int64)})
        got = counts.join(spark.createDataFrame(own), "word").select("word", "items").toArrow()  # a shard's words
        words, df = got.column("word").to_numpy().view(np.uint64), got.column("items").to_numpy()
        order = np.argsort(words)
        return Statistics(total["items"], total["words"] / max(1, total["items"]), words[order], df[order])

    ids, texts, held, whole = [], [], 0, True
    for r in rows.orderBy("item_id", "text").toLocalIterator():
        if ids and (len(ids) >= SHARD or held + len(r["text"]) > SHARD_BYTES):
            yield Shard(ids, texts, statistics(texts))
            ids, texts, held, whole = [], [], 0, False
        ids.append(r["item_id"])
        texts.append(r["text"])
        held += len(r["text"])
    if ids:
        yield Shard(ids, texts, None if whole else statistics(texts))


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row per document and leaked item."""
    docs = documents(docs)
    spark = docs.sparkSession
    out = spark.createDataFrame([], FOUND)
    for shard in shards(items):
        shared = spark.sparkContext.broadcast(shard)

        def go(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids = b.column("doc_id").to_pylist()
                rows = [(ids[row], *rest) for row, *rest in shared.value.search(b.column("text"))]
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()), strict=True)], names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        out = out.unionByName(docs.mapInArrow(go, FOUND))
    return out


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` without a leak, all columns kept."""
    arrow_batches(docs.sparkSession)
    for shard in shards(items):
        shared = docs.sparkSession.sparkContext.broadcast(shard)

        def go(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ok = np.ones(b.num_rows, bool)
                ok[[x[0] for x in shared.value.search(b.column("text").cast(pa.string()))]] = False
                yield b.filter(pa.array(ok))

        docs = docs.mapInArrow(go, docs.schema)
    return docs


def run(docs: DataFrame, items: DataFrame) -> DataFrame:
    return leaks(docs, items)


