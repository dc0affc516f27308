"""Operators that map over documents: language, quality, toxicity, rules, packing, decontamination."""

import json
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm import decontaminate, language, packing, quality_classifier, quality_rules, textkit, toxicity
from millrace.llm.tokens import WordBpe
from tests.llm.conftest import prose

public_tokenizers = pytest.importorskip("public_tokenizers")
WORD = re.compile("[^\x20\x09-\x0d]+")


@given(st.lists(st.one_of(st.none(), st.text(max_size=60)), max_size=8))
@settings(max_examples=150, deadline=None)
def test_words_match_the_pattern(texts):
    data, off = textkit.buffers(pa.array(texts, pa.string()))
    s, e, doc = textkit.words(data, off)
    got = [(int(d), data[a:b].tobytes().decode()) for a, b, d in zip(s, e, doc, strict=True)]
    assert got == [(i, w) for i, t in enumerate(texts) for w in WORD.findall(t or "")]
    h = textkit.word_hashes(data, s, e)
    assert len(set(h.tolist())) == len({w for _, w in got})


def rules_by_hand(t):
    t = t or ""
    w = WORD.findall(t)
    tri = Counter(zip(w, w[1:], w[2:], strict=False))
    hit = {i + k for i in range(len(w) - 2) if tri[w[i], w[i + 1], w[i + 2]] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit)


def test_rules_base_measures_and_verdict(docs, texts, empty):
    got = {r.doc_id: r for r in quality_rules.apply_rules(docs).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == rules_by_hand(t)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert all(got[i].kept for i in range(60)), "clean prose stays"
    assert quality_rules.apply_rules(docs).count() == len(texts) + 1
    assert quality_rules.apply_rules(empty).count() == 0


def test_rules_thresholds_adapt_and_merge(spark):
    rng = random.Random(2)
    rows = []
    for i in range(500):  # a source whose texts hold many symbols, and one whose texts hold none
        t = prose(rng, 80)
        rows.append((i, " # ".join(t.split(" ")), "en", "code") if i % 2 else (i, t, "en", "prose"))
    rows += [(1000, "% ".join(prose(rng, 80).split(" ")), "en", "prose"), (1001, "#% ".join(" # ".join(prose(rng, 80).split(" ")).split(" ")) + " #" * 900, "en", "code")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in quality_rules.apply_rules(df).collect()}
    assert all(got[i].kept for i in range(500)) and got[1000].failed == ["symbol_share"] and not got[1001].kept
    stats = quality_rules.measure_documents(df)
    whole = quality_rules.sketches(stats, ["lang"])
    merged = quality_rules.merged(quality_rules.sketches(stats, ["lang", "source"]), ["lang"])
    assert {tuple(r) for r in whole.collect()} == {tuple(r) for r in merged.collect()}
    exact = np.quantile([r.symbol_share for r in stats.collect()], 0.75)
    buckets = sorted((r.bucket, r.n) for r in whole.where("measure = 'symbol_share'").collect())
    total, run = sum(n for _, n in buckets), 0
    for b, n in buckets:
        run += n
        if run >= 0.75 * total:
            assert abs((quality_rules.GAMMA**b - 1) / quality_rules.SCALE - exact) < 0.06 * exact + 1e-3
            break


def test_rules_fences_follow_each_source(spark):
    """Outliers of their own source below any fixed cutoff fail; the same values are usual elsewhere."""
    rng = random.Random(6)
    rows = []
    for i in range(300):
        t = prose(rng, rng.randint(90, 180))
        rows += [(i, t, "en", "plain"), (1000 + i, t.replace(" ", " # ", 3), "en", "marked"), (2000 + i, t.replace(" ", "zz "), "en", "long words")]
    rows += [(500, rows[0][1].replace(" ", " # ", 3), "en", "plain"), (501, rows[0][1] + " a" * 3, "en", "plain"), (502, rows[0][1].replace(" ", "zzzz "), "en", "plain"), (503, prose(rng, 50_000), "en", "plain")]
    got = {r.doc_id: r.failed for r in quality_rules.apply_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert got[500] == ["symbol_share"] and got[501] == [] and got[502] == ["word_length"] and "length" in got[503]
    assert sum(bool(got[i + k]) for i in range(300) for k in (0, 1000, 2000)) <= 9


def test_rules_every_cutoff_follows_its_cell(spark):
    """Two sources of other habits differ in the cutoff of every measure; a third of one document has its language's."""
    rng = random.Random(8)

    def text(loud):
        lines = [prose(rng, rng.randint(6, 14)) for _ in range(rng.randint(30, 60) if loud else rng.randint(8, 16))]
        if loud:
            lines = [x.replace(" ", "zz ") + " #" * rng.randint(1, 4) for x in lines]
            lines += rng.sample(lines, rng.randint(2, 8)) + ["so it goes on and so it goes on"] * rng.randint(1, 3)
        return "\n".join(lines)

    rows = [(i, text(i % 2), "en", ["calm", "loud"][i % 2]) for i in range(400)] + [(900, text(1), "en", "lone")]
    stats = quality_rules.measure_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    cells = quality_rules.sketches(stats, ["lang", "source"])
    got = {(r.source, r.measure): r.fence for r in quality_rules.thresholds(cells).collect()}
    fixed = {v for v in vars(quality_rules).values() if isinstance(v, (int, float))}
    for m in quality_rules.MEASURES:
        assert got["calm", m] != got["loud", m] and got["lone", m] is not None
        assert not {got[x, m][k] for x in ("calm", "loud") for k in ("low", "high") if got[x, m][k]} & fixed
    by_lang = {r.measure: r.fence for r in quality_rules.fences(quality_rules.sketches(stats, ["lang"]), ["lang"]).collect()}
    assert all(abs(got["lone", m].high - by_lang[m].high) <= 0.06 * by_lang[m].high + 2 for m in ("word_length", "length"))


def test_language_accuracy_und_and_ties(spark, docs, texts, empty):
    rng = random.Random(1)
    alphabets = {"aa": "the an er on re".split(), "bb": "schl ung keit der ach".split(), "cc": "ción os ar lla ñ".split()}
    rows = []
    for i in range(300):
        lang = ["aa", "bb", "cc"][i % 3]
        rows.append((i, " ".join("".join(rng.choice(alphabets[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(4, 60))), lang if i % 7 else None, "s", 1))
    odd = [None, "", "123 !?", "ü", "x" * 200_000, "éé" * 50_000]
    rows += [(1000 + i, t, None, "s", 1) for i, t in enumerate(odd)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, lang_pred int")
    got = {r.doc_id: r for r in language.run(df).collect()}
    truth = {i: ["aa", "bb", "cc"][i % 3] for i in range(300)}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out == (i in held) for i in truth)
    assert sum(got[i].lang_pred == truth[i] for i in held) >= 0.97 * len(held)
    assert [got[1000 + i].lang_pred for i in range(3)] == ["und"] * 3 and got[1003].lang_pred != "und"
    assert all(0 <= r.score <= 1 for r in got.values())
    kept = language.keep_identified(df, language.learn(df, F.lit(True)))
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} >= set(truth) and 1000 not in {r.doc_id for r in kept.collect()}
    assert language.run(empty).count() == 0
    assert language.run(docs).count() == len(texts) + 1
    assert {r.lang_pred for r in language.run(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def junk(rng, i):
    t = prose(rng, rng.randint(20, 150))
    return [t.upper().replace(" ", "!! "), " ".join(w + rng.choice(["%%%", "$$$", "***"]) for w in t.split()), "\n".join([t[:40]] * 30), " ".join(w for w in t.split()[:12] for _ in range(15))][i % 4]


def labelled(spark, make, seed):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        rows.append((i, make(rng, i // 4) if bad else prose(rng, rng.randint(20, 200)), "en", "s", 0.5))
        labels.append((i, int(not bad), int(bad)))
    rows += [(900, None, None, None, None), (901, "", None, None, None), (902, "x " * 100_000, None, None, None)]
    labels += [(5, None, None), (None, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("op", ["quality", "toxic"])
def test_classifiers_on_held_out_rows(spark, docs, empty, op):
    def insult(rng, i):
        w = prose(rng, rng.randint(20, 120)).split()
        for _ in range(max(1, len(w) // 40)):
            w.insert(rng.randrange(len(w)), rng.choice(["idiot", "moron", "worthless", "idiots", "pathetic"]))
        return " ".join(w)

    df, labels = labelled(spark, junk if op == "quality" else insult, 3)
    module, mod, rest = (quality_classifier, 4, 2) if op == "quality" else (toxicity, 3, 1)
    got = {r.doc_id: r for r in module.run(df, labels).collect()}
    assert len(got) == 603 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % mod == rest]
    assert all(got[i].held_out == (i in held) for i in range(600))
    positive = {i: (i % 4 != 0) if op == "quality" else (i % 4 == 0) for i in held}
    s = np.array([got[i].score for i in held])
    y = np.array([positive[i] for i in held])
    order = np.argsort(np.argsort(s))
    auc = (order[y].mean() - (y.sum() - 1) / 2) / (~y).sum()
    assert auc > 0.95, auc
    assert module.run(df, labels.limit(0)).count() == 603
    assert module.run(empty, labels).count() == 0


def test_toxicity_shares_subwords_with_misspellings():
    rng = random.Random(8)
    texts, y = [], []
    for i in range(400):
        w = prose(rng, 40).split()
        if i % 3 == 0:
            w.insert(rng.randrange(40), rng.choice(["worthless", "pathetic", "disgusting"]))
        texts.append(" ".join(w))
        y.append(int(i % 3 == 0))
    model = toxicity.fit(pa.array(texts), np.array(y))
    clean = prose(rng, 40)

    def odds(word):
        p = toxicity.probabilities(pa.array([f"{clean[:100]} {word} {clean[100:]}"]), model)[0]
        return p / (1 - p)

    plain = odds("erenand")
    for w in ("worthles", "pathetlc", "disgustingly"):
        assert odds(w) > 5 * plain


@pytest.fixture(scope="module")
def bpe():
    return WordBpe(public_tokenizers.path("word_bpe_49k.json"))


@given(st.lists(st.text(alphabet=st.one_of(st.characters(max_codepoint=0x2FF), st.sampled_from("'st'reΣİſ中😀́")), max_size=40), max_size=6))
@settings(max_examples=200, deadline=None)
def test_ids_equal_the_library(bpe, texts):
    want = [np.array(e.ids, "<u4").tobytes() for e in bpe.slow.encode_batch(texts, add_special_tokens=False)]
    assert bpe.encode(texts) == want


def test_ids_of_special_strings_and_prose(bpe):
    rng = random.Random(0)
    texts = [prose(rng, 50) for _ in range(200)] + ["a<|endoftext|>b", "I'LL've 12³½ ÀÉß", "", None, "\x00 \x1c"]
    want = [np.array(e.ids, "<u4").tobytes() for e in bpe.slow.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert bpe.fast is not None and bpe.encode(texts) == want


@given(st.lists(st.integers(1, 100), min_size=1, max_size=120))
def test_best_fit_bins(sizes):
    b, off, fill = packing.best_fit(np.array(sizes), 100)
    used = np.zeros(len(fill), int)
    for i in np.argsort(off, kind="stable"):
        assert off[i] == used[b[i]]
        used[b[i]] += sizes[i]
    assert (used == fill).all() and fill.max() <= 100 and len(fill) <= 11 / 9 * -(-sum(sizes) // 100) + sum(s > 50 for s in sizes) + 1


@pytest.mark.parametrize("run", [packing.RUN, 7])
def test_packing_round_trip(spark, docs, texts, empty, bpe, monkeypatch, run):
    monkeypatch.setattr(packing, "RUN", run)
    path = public_tokenizers.path("word_bpe_49k.json")
    cut = packing.pieces(docs, path, with_ids=True).collect()
    rows = packing.run(docs.repartition(3), path).collect()
    assert len(rows) == len(cut)
    ids = {}
    for r in sorted(cut, key=lambda r: (r.doc_id, r.piece)):
        assert r.start == r.piece * 2048 and r.length == len(r.ids) <= 2048
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        if r.doc_id != 8:  # the repeated row
            ids.setdefault(r.doc_id, []).extend(r.ids)
    for i, t in enumerate(texts):
        if i != 8:
            assert ids[i] == [*bpe.slow.encode(t or "", add_special_tokens=False).ids, 0]
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for off, n in sorted(parts):
            assert off == at
            at += n
        assert at <= 2048
    assert len(by) <= sum(r.length for r in rows) / 2048 * 1.1 + 2
    assert packing.run(empty, path).count() == 0


def leaks_by_hand(texts, items):
    norm = lambda t: " ".join(re.findall(r"[a-z0-9]+", (t or "").lower()))
    return {(i, k) for i, t in enumerate(texts) for k, x in items if norm(x) and f" {norm(x)} " in f" {norm(t)} "}


def test_decontamination(spark, empty):
    rng = random.Random(6)
    items = [(i, prose(rng, rng.randint(15, 60)) + ".") for i in range(60)]
    texts = [prose(rng, rng.randint(20, 400)) for _ in range(150)]
    for i in range(0, 150, 5):
        k = rng.randrange(60)
        at = rng.randrange(len(texts[i]))
        texts[i] = f"{texts[i][:at]} {items[k][1].upper() if i % 2 else items[k][1]} {texts[i][at:]}"
    texts += [None, "", "the", " ".join(texts[:60])]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([*items, (98, None), (99, ""), (3, items[3][1])], "item_id long, text string")
    want = leaks_by_hand(texts, items)
    got = {(r.doc_id, r.item_id) for r in decontaminate.run(df, bench).collect()}
    assert got == want and len(want) >= 30
    kept = decontaminate.clean(df, bench)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == set(range(len(texts))) - {d for d, _ in want}
    assert decontaminate.run(df, bench.limit(0)).count() == 0 and decontaminate.run(empty, bench).count() == 0


@pytest.mark.parametrize("part", [1, 50, decontaminate.PART])
def test_retrieval_equals_scoring_every_item(monkeypatch, part):
    """Block-max search gives exactly the pairs and scores that brute force puts over the threshold."""
    monkeypatch.setattr(decontaminate, "PART", part)
    rng = random.Random(9)
    items = [prose(rng, rng.randint(3, 40)) for _ in range(80)]
    texts = [prose(rng, 90) for _ in range(40)] + [f"{prose(rng, 20)} {x} {prose(rng, 20)}" for x in items[:30]]
    texts += [" ".join(x.split()[: len(x.split()) * 6 // 10]) for x in items]  # about the threshold
    index = decontaminate.Index(list(range(80)), items)
    h, cut = decontaminate.hashed_words(pa.array(texts))
    passage, term, _ = index.passages(h, cut)
    got = {(p, i): s for p, i, s in index.retrieve(passage, term)}
    want = {}
    for p in set(passage.tolist()):
        score = np.zeros(len(index.ids))
        for t in term[passage == p]:
            a, b = index.start[t], index.start[t + 1]
            score[index.item[a:b]] += index.impact[a:b]
        want |= {(p, i): s for i, s in enumerate(score) if s >= decontaminate.THRESHOLD - 1e-9}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_dead_blocks_are_skipped_before_their_postings(monkeypatch):
    rng = random.Random(2)
    items = [" ".join(f"w{rng.randrange(3000)}" for _ in range(30)) for _ in range(400)]
    index = decontaminate.Index(list(range(400)), items)
    h, cut = decontaminate.hashed_words(pa.array([items[7]]))
    passage, term, _ = index.passages(h, cut)
    read = []
    scores = index._scores

    def spy(key, cut, live):
        read.append((len(live), index.blocks))
        return scores(key, cut, live)

    monkeypatch.setattr(index, "_scores", spy)
    assert [i for _, i, s in index.retrieve(passage, term) if s > 0.99] == [7]
    assert all(n < blocks / 2 for n, blocks in read)


def test_a_long_item_widens_no_others_passages():
    rng = random.Random(1)
    texts = [prose(rng, 20), prose(rng, 900), prose(rng, 70)]
    shard = decontaminate.Shard([0, 1, 2], texts)
    assert [(i.width, i.ids) for i in shard.classes] == [(64, [0]), (128, [2]), (1024, [1])]
    assert [x[:2] for x in shard.search(pa.array([f"{prose(rng, 300)} {t} {prose(rng, 300)}" for t in texts]))] == [(0, 0), (1, 1), (2, 2)]


@pytest.mark.parametrize("limit", [("SHARD", 7), ("SHARD_BYTES", 2000)])
def test_shards_agree_with_one_index(spark, monkeypatch, limit):
    """The same pairs and the same scores, whole and partial leaks, with a null id and a repeated item."""
    rng = random.Random(3)
    items = [(i, prose(rng, rng.randint(12, 80))) for i in range(25)] + [(None, prose(rng, 30))]
    items.append((77, items[3][1]))
    texts = [f"{prose(rng, 50)} {t}" for _, t in items] + [" ".join(t.split()[: len(t.split()) * 8 // 10]) for _, t in items]
    df = spark.createDataFrame([*enumerate(texts), (0, texts[0])], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = lambda: sorted((tuple(r) for r in decontaminate.run(df, bench).collect()), key=str)
    once = found()
    assert {(d, i) for d, i, *_ in once} >= {(k, i) for k, (i, _) in enumerate(items)} and sum(d == 0 for d, *_ in once) == 2
    monkeypatch.setattr(decontaminate, *limit)
    assert found() == once
