"""Language identification by rank-order profiles (component 10).

A language's profile is its most frequent character n-grams (1 to 4 code points, letters lowered,
every run of other characters taken as one space) in rank order. A document is given the language
whose profile its own most frequent n-grams are least out of place with.

Profiles are learned from about ``per_language`` documents of each language (a hash sample of the
learning rows) and hold ``TOP`` n-grams each, so what is broadcast is bounded by
``MAX_LANGUAGES * TOP`` entries; a column with more values than that is no column of languages and
raises an error. Scoring is a map over whole texts.

Defined cases: a null text, or one without any letter, is ``und`` with score 0; distances that tie go
to the alphabetically first language, counts that tie to the n-gram of the smaller key; with no
learning rows everything is ``und``; texts of any length are read whole; repeated rows are scored one
by one and learned from as often; of the columns beside doc_id, text and lang none is read, whatever
their names, and the filter keeps all of them; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit
from .common import arrow_batches, documents, fold, hashed_below, materialize

TOP = 400
ORDERS = (1, 2, 3, 4)
PER_LANGUAGE = 3000
MAX_LANGUAGES = 10_000
#: below this score a document's n-grams resemble no profile and the filter rejects it
REJECT_BELOW = 0.05

_SPACE = np.uint32(32)
_STEP = np.uint64(0x9E3779B97F4A7C15)


@functools.cache
def letters() -> np.ndarray:
    """Which code points are letters."""
    return np.array([chr(c).isalpha() for c in range(0x110000)], bool)


def code_points(text: str) -> np.ndarray:
    """The lowered letters of a text, each run of other characters as one space, a space at either end."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.concatenate([[_SPACE], np.where(letters()[c], c, _SPACE), [_SPACE]]).astype(np.uint32)
    return c[~((c == _SPACE) & np.concatenate([[False], c[:-1] == _SPACE]))]


def grams(text: str) -> np.ndarray:
    """A 32-bit key of every n-gram of one text."""
    c = code_points(text)
    parts = []
    acc = c.astype(np.uint64)
    for n in ORDERS:
        if n > 1:
            if len(c) < n:
                break
            acc = acc[:-1] * _STEP + c[n - 1 :]
        keys = (textkit.mix(acc + np.uint64(n)) >> np.uint64(32)).astype(np.uint32)
        parts.append(keys[c != _SPACE] if n == 1 else keys)
    return np.concatenate(parts)


def ranked(keys: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``top`` most frequent keys, most frequent first, ties by key; and all-key counts."""
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    k = np.sort(keys)
    cut = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    count = np.diff(np.concatenate([cut, [len(k)]]))
    uniq = k[cut]
    order = (count.astype(np.uint64) << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - uniq.astype(np.uint64))
    if len(order) > top:
        order = np.partition(order, len(order) - top)[-top:]
    order = np.sort(order)[::-1]
    return (np.uint64(0xFFFFFFFF) - (order & np.uint64(0xFFFFFFFF))).astype(np.uint32), (order >> np.uint64(32)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial n-gram counts by language, summed within the task; a task keeps its languages' counts only."""
    total: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for b in batches:
        by: dict[str, list[np.ndarray]] = {}
        for text, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist(), strict=True):
            by.setdefault(lang, []).append(grams(text))
        for lang, parts in by.items():
            keys, n = np.unique(np.concatenate(parts), return_counts=True)
            if lang in total:
                keys = np.concatenate([total[lang][0], keys])
                n = np.concatenate([total[lang][1], n])
                keys, inv = np.unique(keys, return_inverse=True)
                n = np.bincount(inv, weights=n).astype(np.int64)
            total[lang] = (keys, n)
    for lang, (keys, n) in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])


def learn(docs: DataFrame, learnable: Column, per_language: int = PER_LANGUAGE) -> dict[str, np.ndarray]:
    """Profiles from the rows where ``learnable`` holds, lang is given and the text is not null."""
    rows = documents(docs.withColumn("__learn", learnable), "lang", "__learn").where("__learn AND lang IS NOT NULL")
    sizes = materialize(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("lang", "of"), "lang-sizes")
    if (languages := sizes.count()) > MAX_LANGUAGES:
        raise ValueError(f"{languages} values of lang are more than {MAX_LANGUAGES}")
    share = F.least(F.lit(1.0), F.lit(float(per_language)) / F.col("n"))
    picked = rows.where(F.col("text").isNotNull()).join(F.broadcast(sizes), F.col("lang") == F.col("of")).where(hashed_below(F.col("doc_id"), share))
    counts = picked.select("lang", "text").mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = counts.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("r") <= TOP)
    out: dict[str, np.ndarray] = {}
    for lang, gram, _, _ in sorted(top.collect(), key=lambda r: (r["lang"], r["r"])):
        out.setdefault(lang, []).append(gram)
    return {k: np.array(v, np.uint32) for k, v in out.items()}


def profile_table(profiles: dict[str, np.ndarray]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, sorted n-grams of any profile, and each one's rank by language (TOP: absent)."""
    langs = sorted(profiles)
    keys = textkit.distinct(np.concatenate([profiles[x] for x in langs])) if langs else np.zeros(0, np.uint32)
    ranks = np.full((len(keys) + 1, len(langs)), TOP, np.int32)
    for j, x in enumerate(langs):
        ranks[np.searchsorted(keys, profiles[x]), j] = np.arange(len(profiles[x]))
    return langs, keys, ranks


def classify(text: str | None, table: tuple[list[str], np.ndarray, np.ndarray]) -> tuple[str, float]:
    langs, keys, ranks = table
    if not langs or not text or not letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].any():
        return "und", 0.0
    own, _ = ranked(grams(text), TOP)
    if not len(own):
        return "und", 0.0
    at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
    at[keys[at] != own] = len(keys)
    r = ranks[at]
    away = np.abs(r - np.arange(len(own), dtype=np.int32)[:, None])
    away[r == TOP] = TOP
    d = away.sum(0)
    best = int(d.argmin())
    return langs[best], float(1.0 - d[best] / (TOP * len(own)))


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], *keep: str) -> DataFrame:
    """``lang_pred`` and ``lang_score`` beside ``doc_id`` and the columns ``keep`` of every row."""
    table = profile_table(profiles)
    slim = documents(docs, *[c for c in keep if c not in ("doc_id", "text")])
    names = ["doc_id", *[c for c in slim.columns if c in keep and c != "doc_id"]]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [classify(t, table) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=[*names, "lang_pred", "lang_score"])

    schema = T.StructType([slim.schema[c] for c in names] + [T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())])
    return slim.mapInArrow(score, schema)


def keep_identified(docs: DataFrame, profiles: dict[str, np.ndarray], least: float = REJECT_BELOW) -> DataFrame:
    """The rows of ``docs`` in a recognised language: neither ``und`` nor scored below ``least``."""
    table = profile_table(profiles)
    arrow_batches(docs.sparkSession)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [classify(t, table) for t in b.column("text").to_pylist()]
            yield b.filter(pa.array([lang != "und" and score >= least for lang, score in got], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def run(docs: DataFrame) -> DataFrame:
    """The query's digest: held-out flag, predicted language and score of every document."""
    profiles = learn(docs, fold(4) != 2)
    return identify(docs, profiles).select("doc_id", (fold(4) == 2).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
