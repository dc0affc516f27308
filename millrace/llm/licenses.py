"""License scan by exact set-similarity join (component 9). DataFrame functions only.

A text block is any window of ``BLOCK`` words; a template is the set of word pairs (two consecutive
words) of a notice. A block carries the template's label when it holds at least ``THETA`` of its
pairs, and all of its *marks*: the pairs that tell it from the notices of other labels that share at
least half of its pairs, so a GPL notice is not an LGPL one. Every block counts: one that reaches the
threshold still does when it starts at the first pair it shares, so blocks start where a word pair
of some template stands.

Pairs are ordered by how many documents of the corpus hold them, rarest first (counted over all
documents); then

* *length filter*: a document, and a block, with fewer template pairs than the threshold needs is out;
* *prefix filter*: a block must hold one of the first |T| - ceil(THETA |T|) + 1 pairs of the order;
* *positional filter*: if the first of these that it holds stands at place i, at most |T| - i can be shared.

What passes is compared exactly. Templates are a constant of this module, so the join needs no
shuffle: they ride along as literals. The counts are one partial aggregation with a row per template
pair. Fixed phrases are found beside it and always reported.

Defined cases: null counts as empty; without phrases the word positions are null, without labels the
strings are empty; labels of equal score are all given, each once; repeated rows, also of one id, are
scanned one by one; texts of any length are read whole; columns beside ``doc_id`` and ``text`` are not
read, whatever their names; an empty table gives no rows. Only A-Z are lowered.
"""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

# Separators, the phrases of the base scan, and the notices whose words templates hold.
SEPARATORS = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
TEMPLATES = (
    ("agpl-3", "licensed under the gnu affero general public license version 3"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl-3", "licensed under the gnu lesser general public license version 3"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)
THETA = 0.85
BLOCK = 64

_WORD = f"[^{SEPARATORS}]+"


def pairs(notice: str) -> list[str]:
    """The distinct word pairs of a notice."""
    w = notice.split()
    return sorted({f"{x} {y}" for x, y in zip(w, w[1:], strict=False)})


VOCABULARY = sorted({p for _, t in TEMPLATES for p in pairs(t)})


def required(n: int) -> int:
    """Pairs a block must share with a template of n."""
    return -(-round(THETA * 100) * n // 100)


def marks(label: str, notice: str) -> list[str]:
    """The pairs that tell a notice from like ones of other labels; none if there are no such."""
    own = set(pairs(notice))
    like = [set(pairs(t)) for other, t in TEMPLATES if other != label and 2 * len(own & set(pairs(t))) >= len(own)]
    return sorted(p for p in own if not any(p in x for x in like)) if like else []


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(_WORD))


def phrase_pattern(phrase: str) -> str:
    gap = f"[{SEPARATORS}]+"
    return f"(?i)(?<![^{SEPARATORS}])" + gap.join(phrase.split()) + f"(?![^{SEPARATORS}])"


def _phrase(text: Column, words: Column, phrase: str) -> Column:
    """Places of a phrase in a text: their number, the first and the last starting word."""
    gaps = F.split(text, phrase_pattern(phrase), -1)
    found = F.struct((F.size(gaps) - 1).cast("long").alias("n"), word_count(gaps[0]).cast("long").alias("first"), (words - word_count(F.element_at(gaps, -1)) - len(phrase.split())).cast("long").alias("last"))
    return F.when(text.rlike(phrase_pattern(phrase)), found)


def strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def survey(docs: DataFrame) -> DataFrame:
    """Per row: word count, phrase places, template words held, and the text where a template may be met."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("words", F.regexp_extract_all("text", F.lit(_WORD), F.lit(0))).withColumn("n_words", F.size("words").cast("long"))
    # lower() may lower more than A-Z, which can only add candidates
    low = rows.select("doc_id", "text", "n_words", F.transform("words", F.lower).alias("low"))
    both = F.transform("low", lambda x, i: F.concat_ws(" ", x, F.get("low", i + 1)))
    rows = low.select("doc_id", "text", "n_words", F.array_intersect(strings(VOCABULARY), both).alias("held"))
    may = F.lit(False)
    for _, t in TEMPLATES:
        may = may | (F.size(F.array_intersect("held", strings(pairs(t)))) >= required(len(pairs(t))))
    places = [F.when(F.lower("text").contains(p.split()[0]), _phrase(F.col("text"), F.col("n_words"), p)).alias(f"p{i}") for i, p in enumerate(PHRASES)]
    return rows.select("doc_id", "n_words", "held", *places, F.when((F.size("held") > 0) & may, F.col("text")).alias("candidate"))


def _numbers(tokens: list[str]) -> Column:
    return F.array(*[F.lit(VOCABULARY.index(t) + 1) for t in tokens])


def _share(ranked: list[str], needed: list[str]) -> Callable[[Column], Column]:
    """Containment of a template (rarest pair first) in a block of pair numbers, 0 below the threshold or without its marks."""
    n, need = len(ranked), required(len(ranked))
    head = _numbers(ranked[: n - need + 1])

    def share(block: Column) -> Column:
        first = F.array_position(_numbers(ranked), F.get(F.array_intersect(head, block), F.lit(0)))
        passes = (F.size(block) >= need) & F.arrays_overlap(block, head) & (n - first + 1 >= need)
        if needed:
            passes = passes & (F.size(F.array_intersect(block, _numbers(needed))) == len(needed))
        shared = F.size(F.array_intersect(block, _numbers(ranked)))
        return F.when(passes & (shared >= need), shared / n).otherwise(0.0)

    return share


def scan(docs: DataFrame) -> DataFrame:
    """Counts, phrase places, labels and best containment of every row."""
    rows = materialize(survey(docs), "lic-survey")
    seen = {r["w"]: r["n"] for r in rows.select(F.explode("held").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per template pair at most
    order = sorted(VOCABULARY, key=lambda w: (seen.get(w, 0), w))
    words = F.regexp_extract_all(F.translate("candidate", string.ascii_uppercase, string.ascii_lowercase), F.lit(_WORD), F.lit(0))
    rows = rows.withColumn("w", words)
    # where pairs of templates stand, and the numbers of those in the block from each on
    hits = F.filter(F.transform("w", lambda x, i: F.struct(i.alias("at"), F.array_position(strings(VOCABULARY), F.concat_ws(" ", x, F.get("w", i + 1))).cast("int").alias("pair"))), lambda x: x["pair"] > 0)
    rows = rows.withColumn("hits", hits)
    inside = lambda h, i: F.filter(F.slice("hits", i + 1, BLOCK - 1), lambda x: x["at"] <= h["at"] + (BLOCK - 2))
    blocks = F.array_distinct(F.transform("hits", lambda h, i: F.array_distinct(F.transform(inside(h, i), lambda x: x["pair"]))))
    rows = rows.withColumn("blocks", blocks)
    best: dict[str, list[Column]] = {}
    for label, t in TEMPLATES:
        ranked = sorted(pairs(t), key=order.index)
        best.setdefault(label, []).append(F.coalesce(F.array_max(F.transform("blocks", _share(ranked, marks(label, t)))), F.lit(0.0)))
    scores = [F.struct(F.lit(label).alias("label"), (F.greatest(*c) if len(c) > 1 else c[0]).alias("score")) for label, c in best.items()]
    place = [F.col(f"p{i}") for i in range(len(PHRASES))]
    base = F.array_sort(F.array_distinct(F.filter(F.array(*[F.when(p.isNotNull(), F.lit(v)) for p, v in zip(place, PHRASES.values(), strict=True)]), lambda x: x.isNotNull())))
    rows = rows.withColumns({"scores": F.when(F.size("blocks") > 0, F.array(*scores)), "base": base})
    met = F.coalesce(F.filter("scores", lambda s: s["score"] > 0), F.array().cast("array<struct<label:string,score:double>>"))
    labels = F.array_sort(F.array_distinct(F.concat("base", F.transform(met, lambda s: s["label"]))))
    return rows.select(
        "doc_id",
        "n_words",
        sum((F.coalesce(p["n"], F.lit(0)) for p in place), F.lit(0)).cast("long").alias("n_base"),
        F.least(*[p["first"] for p in place]).alias("first_word"),
        F.greatest(*[p["last"] for p in place]).alias("last_word"),
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.greatest(F.when(F.size("base") > 0, 1.0).otherwise(0.0), F.coalesce(F.array_max(F.transform(met, lambda s: s["score"])), F.lit(0.0))).alias("score"),
    )


def run(docs: DataFrame) -> DataFrame:
    return scan(docs)


def duckdb_sql() -> str:
    """The same rows by brute force: every place of a template's pair against all that follow within a block."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    tokens = ", ".join(f"({k}, {q(label)}, {q(p)}, {str(p in marks(label, t)).lower()})" for k, (label, t) in enumerate(TEMPLATES) for p in pairs(t))
    need = ", ".join(f"({k}, {len(pairs(t))}, {required(len(pairs(t)))}, {len(marks(label, t))})" for k, (label, t) in enumerate(TEMPLATES))
    phrases = ", ".join(f"({q(p)}, {q(v)}, {len(p.split())})" for p, v in PHRASES.items())
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{_WORD}') AS w FROM documents),
t(k, label, pair, mark) AS (VALUES {tokens}),
need(k, n, least, marks) AS (VALUES {need}),
ph(phrase, label, n) AS (VALUES {phrases}),
place AS (SELECT doc_id, label, i - 1 AS pos FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d), ph WHERE array_to_string(list_slice(w, i, i + n - 1), ' ') = phrase),
base AS (SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list_sort(list_distinct(list(label))) AS l FROM place GROUP BY doc_id),
pair AS (SELECT doc_id, i AS pos, w[i] || ' ' || w[i + 1] AS pair FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM d)),
hit AS (SELECT doc_id, k, label, pos, pair, mark FROM pair JOIN t USING (pair)),
win AS (SELECT a.doc_id, a.k, a.label, a.pos, count(DISTINCT b.pair) AS c, count(DISTINCT b.pair) FILTER (b.mark) AS m FROM hit a JOIN hit b ON a.doc_id = b.doc_id AND a.k = b.k AND b.pos BETWEEN a.pos AND a.pos + {BLOCK - 2} GROUP BY a.doc_id, a.k, a.label, a.pos),
met AS (SELECT doc_id, label, max(c / n) AS score FROM win JOIN need USING (k) WHERE c >= least AND m = marks GROUP BY doc_id, label),
best AS (SELECT doc_id, list(label) AS l, max(score) AS score FROM met GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
coalesce(array_to_string(base.l, ','), '') AS base_labels,
coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.l, []), coalesce(best.l, [])))), ','), '') AS labels,
CAST(greatest(CASE WHEN n_base > 0 THEN 1.0 ELSE 0.0 END, coalesce(best.score, 0.0)) AS DOUBLE) AS score
FROM d LEFT JOIN base ON d.doc_id = base.doc_id LEFT JOIN best ON d.doc_id = best.doc_id
"""
