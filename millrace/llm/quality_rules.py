"""Quality rules with adaptive thresholds (component 3).

Text measures are computed per document, quantile sketches of them per (language, source) are
merged by addition, and documents are filtered against the thresholds joined back to them.

The sketch is a log-bucket histogram: a measure x falls in bucket
``ceil(ln(1 + 1000 x) / ln GAMMA)``, a mergeable summary with bounded relative error whose size
depends on GAMMA and the range, not on the rows. It is built and merged by ordinary partial
aggregation, so a source that holds a third of the rows is summed before any shuffle.

Every (language, source) cell has its own thresholds. Its sketch is joined by those of its language
and of the corpus, scaled to weigh ``PRIOR`` documents each, so a cell of a few documents follows its
language, one of many follows itself, and nothing switches at a size. Thresholds come from the summed
sketch alone: a document fails when the bucket of a measure lies beyond the fence of its cell. The
fence of a share is ``q3 + FENCE * (q3 - q1)``; where the quartiles share a bucket it is
``t + FENCE * (t - q3)`` with the tail quantile t = q90, so where nine documents in ten hold no symbol,
any symbol is an outlier. Word length and length have a fence on either side, taken in the same way
from the logarithms (the buckets).

Defined cases: with no words (null or empty text included) a document fails the base rules; texts of
any length are read whole; rows repeated in the input are scored and returned one by one and count as
often; equal measures share a bucket and so a verdict; null lang or source is a cell of its own;
columns beside doc_id, text, lang and source are not read, whatever their names; an empty table gives
an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit
from .common import arrow_batches, materialize

GAMMA = 1.01
SCALE = 1000.0
FENCE = 3.0
#: documents that the language's sketch weighs in a cell's, and the corpus's in a language's
PRIOR = 20
#: the quantile that stands for the spread where the quartiles share a bucket
TAIL = 0.90
SHARES = ("symbol_share", "dup_line_share", "repeat_share")
MEASURES = (*SHARES, "word_length", "length")
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
BLANK = " \t\n\x0b\x0c\r"

STATS_SCHEMA = T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")] + [T.StructField("lang", T.StringType()), T.StructField("source", T.StringType())])


def text_stats(texts: pa.Array) -> dict[str, np.ndarray]:
    """The base measures of each text of a batch."""
    data, off = textkit.buffers(texts)
    docs = len(off) - 1
    s, e, doc = textkit.words(data, off)
    counts = np.bincount(doc, minlength=docs).astype(np.int64)

    def share(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return total[off[1:]] - total[off[:-1]]

    chars = share(~textkit.SPACE[data] & ((data & 0xC0) != 0x80))
    h = textkit.word_hashes(data, s, e)
    sh, ok = textkit.ngram_hashes(h, doc, 3)
    covered = np.zeros(len(h) + 1, np.int64)
    if ok.any():
        at = np.flatnonzero(ok)
        key = textkit.mix(sh[at] + doc[at].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        order = np.argsort(key, kind="stable")
        k = key[order]
        same = k[1:] == k[:-1]
        twice = np.zeros(len(k), bool)
        twice[1:] |= same
        twice[:-1] |= same
        hit = at[order[twice]]
        np.add.at(covered, hit, 1)
        np.add.at(covered, np.minimum(hit + 3, len(h)), -1)
    rep = textkit.per_doc((np.cumsum(covered[:-1]) > 0).astype(np.int64), doc, docs)
    dup = np.zeros(docs, np.int64)
    lines = np.zeros(docs, np.int64)
    for i, t in enumerate(texts.to_pylist()):
        if not t:
            continue
        seen: set[str] = set()
        for line in t.split("\n"):
            if line.strip(BLANK):
                lines[i] += 1
                if line in seen:
                    dup[i] += 1
                else:
                    seen.add(line)
    return {"n_words": counts, "word_chars": chars, "n_symbols": share(SYMBOLS[data]), "n_dup_lines": dup, "n_repeat_words": rep, "n_lines": lines}


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = text_stats(b.column("text"))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(out[n], pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")], b.column("lang"), b.column("source")], names=[f.name for f in STATS_SCHEMA])


def measure_documents(docs: DataFrame) -> DataFrame:
    arrow_batches(docs.sparkSession)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))
    s = narrow.mapInArrow(_stats, STATS_SCHEMA)
    words = F.greatest(F.col("n_words"), F.lit(1))
    return s.withColumns({"symbol_share": F.col("n_symbols") / words, "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)), "repeat_share": F.col("n_repeat_words") / words, "word_length": F.col("word_chars") / words, "length": F.col("n_words").cast("double")})


def bucket(x):
    return F.ceil(F.log(F.lit(1.0) + x * SCALE) / F.lit(math.log(GAMMA))).cast("int")


def sketches(stats: DataFrame, cell: list[str]) -> DataFrame:
    """Mergeable sketches: one count per cell, measure and bucket."""
    long = stats.select(*cell, F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), bucket(F.col(m)).alias("bucket")) for m in MEASURES])).alias("x"))
    return long.groupBy(*cell, "x.measure", "x.bucket").agg(F.count(F.lit(1)).alias("n"))


def merged(sketch: DataFrame, cell: list[str]) -> DataFrame:
    return sketch.groupBy(*cell, "measure", "bucket").agg(F.sum("n").alias("n"))


def joined(sketch: DataFrame, prior: DataFrame, cell: list[str], shared: list[str]) -> DataFrame:
    """Each cell's sketch plus its prior's, scaled to ``PRIOR`` documents; the prior's cells are ``shared``."""
    total = Window.partitionBy(*shared, "measure")
    scaled = prior.select(*[F.col(c).alias(f"p_{c}") for c in shared], "measure", "bucket", (F.col("n") * PRIOR / F.sum("n").over(total)).alias("n"))
    cells = sketch.select(*cell).distinct()
    same = [F.col(c).eqNullSafe(F.col(f"p_{c}")) for c in shared]
    spread = cells.join(scaled, same).select(*cell, "measure", "bucket", "n")
    return merged(sketch.withColumn("n", F.col("n").cast("double")).unionByName(spread), cell)


def thresholds(cells: DataFrame) -> DataFrame:
    """Fences of every (lang, source) cell and measure, from the cells' sketches."""
    corpus = merged(cells.withColumn("every", F.lit(1)), ["every"])
    by_lang = merged(cells, ["lang"]).withColumn("every", F.lit(1))
    by_lang = joined(by_lang, corpus, ["lang", "every"], ["every"])
    return fences(joined(cells, by_lang.drop("every"), ["lang", "source"], ["lang"]), ["lang", "source"])


def fences(sketch: DataFrame, cell: list[str]) -> DataFrame:
    """Least and greatest bucket of each cell and measure that pass, from the quantile buckets of its sketch."""
    w = Window.partitionBy(*cell, "measure").orderBy("bucket")
    whole = Window.partitionBy(*cell, "measure")
    run = sketch.withColumns({"upto": F.sum("n").over(w), "total": F.sum("n").over(whole)})
    quantiles = (("t1", 1 - TAIL), ("q1", 0.25), ("q3", 0.75), ("t3", TAIL))
    # the hair's breadth keeps a sum of weights that rounds below its own share from moving a quantile
    q = run.groupBy(*cell, "measure").agg(*[F.min(F.when(F.col("upto") >= F.col("total") * (p - 1e-9), F.col("bucket"))).alias(a) for a, p in quantiles])

    def beyond(near, far, tail):
        return F.when(F.col("q3") > F.col("q1"), near + FENCE * (near - far)).otherwise(tail + FENCE * (tail - near))

    value = lambda c: (F.pow(F.lit(GAMMA), F.col(c)) - 1) / SCALE
    # the least bucket that covers the fence; a fence on a bucket's border is that bucket, whatever the rounding
    share = F.ceil(F.log(1 + SCALE * beyond(value("q3"), value("q1"), value("t3"))) / math.log(GAMMA) - 1e-6)
    is_share = F.col("measure").isin(list(SHARES))
    low = F.when(~is_share, beyond(F.col("q1"), F.col("q3"), F.col("t1")))
    high = F.when(is_share, share).otherwise(beyond(F.col("q3"), F.col("q1"), F.col("t3")))
    return q.select(*cell, "measure", F.struct(low.cast("double").alias("low"), high.cast("double").alias("high")).alias("fence"))


def apply_rules(docs: DataFrame) -> DataFrame:
    """Measures and verdict of every document; ``failed`` names the measures over their fence."""
    stats = materialize(measure_documents(docs), "rules-stats")
    cells = materialize(sketches(stats, ["lang", "source"]), "rules-sketch")  # a few hundred rows a cell, whatever the documents
    t = thresholds(cells).groupBy(F.col("lang").alias("lang_t"), F.col("source").alias("source_t")).agg(*[F.max(F.when(F.col("measure") == m, F.col("fence"))).alias(f"{m}_fence") for m in MEASURES])
    out = stats.join(t, F.col("lang").eqNullSafe(F.col("lang_t")) & F.col("source").eqNullSafe(F.col("source_t")), "left")
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    failed = F.filter(F.array(*[F.when((bucket(F.col(m)) > F.col(f"{m}_fence.high")) | (bucket(F.col(m)) < F.col(f"{m}_fence.low")), F.lit(m)) for m in MEASURES]), lambda x: x.isNotNull())
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), failed.alias("failed"), (~base & (F.size(failed) == 0)).alias("kept"))
