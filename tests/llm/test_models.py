"""The learned operators against plain versions of what they learn."""

import collections
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import language, quality_classifier, quality_rules, textkit, toxicity
from tests.llm.conftest import prose

STEP, WORD64 = 0x9E3779B97F4A7C15, (1 << 64) - 1


def key(gram):
    """The 32-bit key of an n-gram, one code point after the other."""
    acc = ord(gram[0])
    for c in gram[1:]:
        acc = (acc * STEP + ord(c)) & WORD64
    return int(textkit.mix(np.array([(acc + len(gram)) & WORD64], np.uint64))[0]) >> 32


def grams(text):
    t = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
    t = "".join(c for i, c in enumerate(t) if not (c == " " and i and t[i - 1] == " "))
    return collections.Counter(t[i : i + n] for n in (1, 2, 3, 4) for i in range(len(t) - n + 1) if t[i : i + n] != " ")


def ranking(counts):
    by = collections.Counter()
    for g, n in counts.items():
        by[key(g)] += n
    return {k: r for r, (k, _) in enumerate(sorted(by.items(), key=lambda x: (-x[1], x[0]))[: language.TOP])}


def test_out_of_place_distance_by_brute_force(spark):
    rng = random.Random(3)
    sounds = {"aa": "the an er on re", "bb": "schl ung keit der ß", "cc": "ción os ar lla ñ", "dd": "при вет мир ый", "ee": "日 本 語 中"}
    rows = []
    for i in range(120):
        lang = list(sounds)[i % 5]
        rows.append((i, " ".join("".join(rng.choice(sounds[lang].split()) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(1, 40))) + rng.choice(["!", " 42.", "É"]), lang if i % 7 else None))
    rows += [(200, None, "aa"), (201, "9 -", "bb"), (202, "q", None), (203, "the an" * 3000, None), (7, rows[7][1], "bb")]
    counts = collections.defaultdict(collections.Counter)
    for i, t, lang in rows:
        if lang and t is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            counts[lang] += grams(t)
    profiles = {lang: ranking(c) for lang, c in counts.items()}
    want = []
    for i, t, _ in rows:
        if not t or not any(c.isalpha() for c in t):
            want.append((i, "und", 0.0))
            continue
        own = ranking(grams(t))
        away = {lang: sum(abs(p[k] - r) if k in p else language.TOP for k, r in own.items()) for lang, p in profiles.items()}
        best = min(sorted(away), key=away.get)
        want.append((i, best, 1 - away[best] / (language.TOP * len(own))))
    got = [(r.doc_id, r.lang_pred, r.score) for r in language.run(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)).collect()]
    assert [(a, b, round(c, 12)) for a, b, c in sorted(got)] == [(a, b, round(c, 12)) for a, b, c in sorted(want)]


def test_too_many_languages_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(language, "MAX_LANGUAGES", 3)
    df = spark.createDataFrame([(i, "some words", f"l{i}") for i in range(40)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="values of lang"):
        language.run(df)


def test_dual_descent_by_a_dense_version():
    """The same steps over a dense matrix give the same weights, and they leave a small duality gap."""
    rng = np.random.default_rng(4)
    y = np.where(rng.random(120) < 0.4, 1.0, -1.0)
    rows = [np.unique(np.concatenate([rng.integers(0, 60, 12), rng.integers(0, 8, 3) + (100 if t > 0 else 110)])) for t in y]
    w, bias = quality_classifier.fit_svm(rows, y)
    b = quality_classifier.BUCKETS
    x = np.zeros((len(y), 200))
    for i, r in enumerate(rows):
        x[i, r] = 1
    # totals count the buckets no row has, each with the prior
    p, q = (quality_classifier.ALPHA + x[y == s].sum(0) for s in (1, -1))
    more = (b - 200) * quality_classifier.ALPHA
    ratio = np.log((p / (p.sum() + more)) / (q / (q.sum() + more)))
    ratio[x.sum(0) < 2] = 0
    assert np.allclose(w[1][:200], ratio)
    z = x * ratio
    z /= np.sqrt((z * z).sum(1, keepdims=True))
    cap = np.where(y > 0, len(y) / (2 * (y > 0).sum()), len(y) / (2 * (y < 0).sum())) * quality_classifier.C
    full = np.hstack([z, np.ones((len(y), 1))])
    alpha, v = np.zeros(len(y)), np.zeros(201)
    draw = np.random.default_rng(7)
    for _ in range(quality_classifier.EPOCHS):
        for i in draw.permutation(len(y)):
            new = np.clip(alpha[i] - (y[i] * (v @ full[i]) - 1) / 2.0, 0, cap[i])
            v += (new - alpha[i]) * y[i] * full[i]
            alpha[i] = new
    assert np.allclose(w[0][:200], v[:200]) and abs(bias - v[200]) < 1e-9 and not w[0][200:].any()
    primal = 0.5 * v @ v + (cap * np.maximum(0, 1 - y * (full @ v))).sum()
    dual = alpha.sum() - 0.5 * v @ v
    assert 0 <= primal - dual < 0.05 * primal


def test_softmax_and_embeddings_follow_the_gradient():
    """Steps of all three parameter tables against differences of the loss."""
    rng = random.Random(2)
    word, cut, sub, sub_cut = toxicity.tokens(pa.array([prose(rng, 9) for _ in range(6)]))
    net = toxicity.Net()
    before = net.emb.copy(), net.out.copy(), net.bias.copy()
    grid = cut[:6, None] + np.arange(12)
    mask = grid < cut[1:7][:, None]
    mat, y = word[np.minimum(grid, len(word) - 1)], np.array([0, 1, 0, 1, 1, 0])

    def loss(emb, out, bias):
        total = 0.0
        for i in range(6):
            vec = np.mean([np.mean([emb[b] for b in sub[sub_cut[k] : sub_cut[k + 1]]], axis=0) for k in mat[i][mask[i]]], axis=0)
            z = vec @ out + bias
            total -= z[y[i]] - math.log(np.exp(z).sum())
        return total / 6

    net.step(mat, mask, y, np.ones(6), sub, sub_cut)
    seen = int(sub[sub_cut[mat[0][0]]])
    for table, acc, at in ((0, net.g_emb, (seen, 1)), (0, net.g_emb, (seen, 3)), (1, net.g_out, (2, 0)), (1, net.g_out, (0, 1)), (2, net.g_bias, (1,))):
        up, down = [x.copy() for x in before], [x.copy() for x in before]
        up[table][at] += 1e-5
        down[table][at] -= 1e-5
        slope = (loss(*up) - loss(*down)) / 2e-5
        assert math.sqrt(acc[at] - 1e-6) == pytest.approx(abs(slope), rel=1e-3, abs=1e-6)
        now = (net.emb, net.out, net.bias)[table][at]
        assert (now - before[table][at]) * slope <= 0 and abs(now - before[table][at]) == pytest.approx(abs(slope) / math.sqrt(acc[at]), rel=1e-2, abs=1e-4)


def corpus(rng):
    rows, labels = [], []
    for i in range(240):
        bad = i % 3 == 0
        t = prose(rng, rng.randint(15, 80))
        rows.append((i, t.replace(" ", " $$ ", 9) + " idiot moron" if bad else t, "en", i, 0.1, 1))
        labels.append((i, int(not bad), int(bad)))
    return rows, labels


@pytest.mark.parametrize("op", ["quality", "toxic"])
def test_scores_do_not_depend_on_layout(spark, op):
    """Repeated documents and labels, clashing columns, a long text: the same scores from any partitions."""
    rng = random.Random(5)
    rows, labels = corpus(rng)
    rows += [rows[3], rows[4], (900, prose(rng, 3000) + " idiot", None, None, None, None), (901, None, None, None, None, None), (4, "another text of one id", None, None, None, None)]
    labels += [labels[3], (4, 1 - labels[4][1], 1 - labels[4][2]), (900, 0, 1), (7777, 1, 0), (8, 5, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string, y long, score double, held_out int")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    module = quality_classifier if op == "quality" else toxicity
    found = lambda n, m: sorted(((r.doc_id, r.score, r.predicted, r.held_out) for r in module.run(df.repartition(n), lab.repartition(m)).collect()), key=str)
    once = found(1, 1)
    assert len(once) == len(rows) and found(7, 3) == once and all(0 <= s <= 1 for _, s, _, _ in once)
    one = {r.score for r in module.run(df, lab.where(f"{op} = 1")).collect()}
    assert len(one) == 1, "labels of one class say nothing"
    assert module.run(df.limit(0), lab).count() == 0 and module.run(df, lab.limit(0)).count() == len(rows)


def test_excerpts_bound_what_the_driver_reads():
    rng = random.Random(1)
    long = " ".join(f"w{rng.randrange(99)}" for _ in range(50_000))
    b = pa.RecordBatch.from_pydict({"doc_id": [1, 2, 3], "key": [5, -6, 7], "y": [1, 0, 1], "text": [long, "short text", "z" * 10**6]})
    out = next(toxicity._excerpts(iter([b]))).column("text").to_pylist()
    assert [len(t.split()) for t in out] == [toxicity.EXCERPTS * toxicity.PASSAGE, 2, 1] and len(out[2]) == 256


def verdicts_by_hand(stats):
    """Fences and verdicts of op3 by plain loops over whole lists of buckets."""
    measures, gamma, scale = quality_rules.MEASURES, quality_rules.GAMMA, quality_rules.SCALE
    bucket = lambda x: math.ceil(math.log(1 + x * scale) / math.log(gamma))
    value = lambda b: (gamma**b - 1) / scale
    cells, langs, every = (collections.defaultdict(lambda: collections.defaultdict(collections.Counter)) for _ in range(3))
    for r in stats:
        for m in measures:
            for table, k in ((cells, (r.lang, r.source)), (langs, r.lang), (every, 0)):
                table[k][m][bucket(r[m])] += 1

    def blend(own, prior):
        total, out = sum(prior.values()), collections.Counter(own)
        for b, n in prior.items():
            out[b] += n * quality_rules.PRIOR / total
        return out

    out = []
    for r in stats:
        failed = []
        for m in measures:
            lang = blend(langs[r.lang][m], every[0][m])
            sketch = sorted(blend(cells[r.lang, r.source][m], lang).items())
            total, q = sum(n for _, n in sketch), {}
            for p in (0.1, 0.25, 0.75, 0.9):
                run = 0
                for b, n in sketch:
                    run += n
                    if run >= total * (p - 1e-9):
                        q[p] = b
                        break
            if m in quality_rules.SHARES:
                lo, hi, tail = value(q[0.25]), value(q[0.75]), value(q[0.9])
                edge = hi + 3 * (hi - lo) if q[0.75] > q[0.25] else tail + 3 * (tail - hi)
                low, high = None, math.ceil(math.log(1 + scale * edge) / math.log(gamma) - 1e-6)
            elif q[0.75] > q[0.25]:
                low, high = q[0.25] + 3 * (q[0.25] - q[0.75]), q[0.75] + 3 * (q[0.75] - q[0.25])
            else:
                low, high = q[0.1] + 3 * (q[0.1] - q[0.25]), q[0.9] + 3 * (q[0.9] - q[0.75])
            if bucket(r[m]) > high or (low is not None and bucket(r[m]) < low):
                failed.append(m)
        base = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        out.append((r.doc_id, failed, not base and not failed))
    return out


def test_rules_by_brute_force(spark, docs):
    """Thresholds, names of failed measures and verdicts of every document, end to end."""
    rng = random.Random(9)
    rows = []
    for i in range(400):
        t = prose(rng, rng.randint(40, 160))
        rows.append((10_000 + i, t.replace(" ", rng.choice([" # ", "\n", " a ", "zz "]), rng.randint(0, 25)), rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None])))
    df = docs.select("doc_id", "text", "lang", "source").unionByName(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    want = verdicts_by_hand(quality_rules.measure_documents(df).collect())
    got = [(r.doc_id, list(r.failed), r.kept) for r in quality_rules.apply_rules(df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert 5 < sum(bool(f) for _, f, _ in want) < len(want) / 2
