"""Personal data and licences: DataFrame functions against plain Python and SQL."""

import hashlib
import math
import random
import re

import duckdb
import pytest

from millrace.llm import licenses, pii


def luhn(d):
    return sum((x * 2 - 9 if x > 4 else x * 2) if i % 2 else x for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def base_spans(t):
    t, out = t or "", []
    n = lambda m: re.sub("[^0-9]", "", m.group())
    out += [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(n(m)) <= 19 and luhn(n(m))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(n(m)) <= 15]
    return sorted(out)


def pieces(rng):
    num = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    return rng.choice([num(rng.randint(1, 22)), ".", " ", "-", "+" + num(3), f"({num(3)}) ", f"{num(3)}-{num(4)}", "a.b@c.d", "@", "x%y", ".com", "é😀", ".".join(str(rng.randint(0, 300)) for _ in range(rng.randint(3, 6))), "4111 1111 1111 1111", "call 555-123-4567 now", 'token = "' + "ab1" * 13 + '"'])


@pytest.fixture(scope="module")
def odd_texts(texts):
    rng = random.Random(3)
    made = ["".join(pieces(rng) for _ in range(rng.randint(0, 30))) for _ in range(600)]
    return [*texts, "a@b.c@d.e", "a@b.c.d%x@y.z", "1.2.3.4.5.6.7.8", "5--12", "1" * 30000, "a" * 20000 + "@b.cc", "0000001.0000255.3.4", "1 " * 20000, *made]


def test_pii_base_is_exact_and_kept(spark, odd_texts, empty):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(odd_texts)], "doc_id long, text string, spans string")
    got = {r.doc_id: r for r in pii.run(df).collect()}
    for i, t in enumerate(odd_texts):
        want = base_spans(t)
        names = [f"{pii.BASE[k]}:{a}:{b}" for a, k, b in want]
        r = got[i]
        assert r.base_sha256 == hashlib.sha256(",".join(names).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == j for _, k, _ in want) for j in range(4)]
        assert set(names) <= set(r.spans.split(","))
    assert pii.run(empty).count() == 0
    assert any("secret" in r.spans for r in got.values())


def test_redaction_keeps_columns_and_other_text(spark):
    rows = [(1, "mail a@b.example now", 7), (2, None, 7), (3, "nothing here", None), (4, 'é token = "' + "0a1b2" * 8 + '" +1 (555) 123-4567.', 7), (1, "mail a@b.example now", 7)]
    out = pii.redact(spark.createDataFrame(rows, "doc_id long, text string, base int")).collect()
    texts = {r.doc_id: r.text for r in out}
    assert len(out) == 5 and texts[1] == "mail [EMAIL] now" and texts[2] is None and texts[3] == "nothing here"
    assert texts[4] == 'é token = "[SECRET]" [PHONE].'


def simulated(rng, labelers, n=4000):
    """Candidates whose truth is known: each labeler votes with some accuracy, and on some of them only."""
    counts = {}
    for _ in range(n):
        y = rng.random() < 0.4
        v = tuple((1 if y == (rng.random() < a) else -1) if rng.random() < c else 0 for a, c in labelers)
        counts[0, v] = counts.get((0, v), 0) + 1
    return [(k, v, n) for (k, v), n in counts.items()]


def test_votes_recover_reliabilities():
    patterns = simulated(random.Random(0), ((0.95, 1.0), (0.85, 0.5), (0.7, 0.8), (0.6, 0.6)))
    _, fit = pii.aggregate_votes(patterns)
    assert fit["accuracy"][0] > fit["accuracy"][2] > fit["accuracy"][3]
    assert abs(fit["accuracy"][1] - 0.85) < 0.08 and abs(fit["accuracy"][2] - 0.7) < 0.08
    w = pii.train([(k, v, (1, 1, 1), n) for k, v, n in patterns])
    assert sum(w[x] for x in pii.inputs(0, (1, 1, 1, 1), (1, 1, 1))) > 1 > -1 > sum(w[x] for x in pii.inputs(0, (-1, -1, -1, -1), (1, 1, 1)))
    assert pii.train([]) == {}


def votes_by_hand(kind, text, a, z, last):
    """Votes and features of a match by ``re``; ``last`` is where the text before the match before begins."""
    m, left, right = text[a:z], text[max(0, a - pii.NEAR, last) : a], text[z : z + pii.NEAR // 2]
    d, has = re.sub("[^0-9]", "", m), lambda p, x: bool(re.search(p, x))
    both = lambda yes, no: -1 if no else 1 if yes else 0
    good = {"email": True, "ip": has(rf"^{pii.OCTET}(?:\.{pii.OCTET}){{3}}$", m), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}.get(kind, False)
    tld = has(r"\.[A-Za-z]{2,}$", m)
    form = {"email": both(tld, not tld), "ip": both(False, not good), "card": both(good, not good), "phone": both(good, not good), "national": both(False, has(r"^\(?[01]", m) or has(r"^\(?[0-9]{3}[^0-9]+[01]", m)), "ssn": both(False, has(r"^(?:000|666|9..)|-00-|-0000$", m)), "secret": both(False, not has("[0-9]", m) or not has("[A-Za-z]", m) or len(d) < 5)}[kind]
    gaz = {"email": both(has(rf"(?i)@(?:[a-z0-9-]+\.)*(?:{pii.PROVIDERS})\.[a-z.]{{2,}}$", m), has(rf"(?i)^(?:{pii.ROLES})@", m)), "ip": both(has("^0*[1-9]", m), has(pii.RESERVED, m)), "card": both(has(pii.ISSUERS, m), not has(pii.ISSUERS, m)), "phone": both(has(pii.CALLING, d), not has(pii.CALLING, d)), "national": both(False, has(pii.TOLL_FREE, m)), "ssn": both(False, m in ("078-05-1120", "219-09-9999")), "secret": both(has(pii.KEY_PREFIXES, m), False)}[kind]
    names = rf"(?ai)\b(?:{pii.CUES[kind]})\b"
    cue = 1 if has(names, left) else -1 if has("(?a)" + pii.OTHERS, left) else 1 if has(names, right) else 0
    letter = r"[^\W\d_]"
    frame = 1 if has(r"[=:]\s*[\"'(<\[]?$", left) else -1 if has(rf"(?:{letter}|[0-9/\\#_%-])$", left) or has(rf"^(?:{letter}|[0-9/\\_%])", right) else 0
    n = len(m)
    feats = (0 if n <= 14 else 1 if n <= 24 else 2, 0 if len(d) * 10 < n * 3 else 1 if len(d) * 10 < n * 8 else 2, int(len(set(m[:64])) >= 10))
    return good and kind in pii.BASE, (form, gaz, cue, frame), feats


def spans_by_hand(texts):
    """All spans of every text: candidates by ``re``, the fits of the module, and the choice by plain loops."""
    rows = []
    for t in texts:
        t, found = t or "", []
        for k, kind in enumerate(pii.PATTERNS):
            pattern = r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++" if kind == "email" else pii.PATTERNS[kind]
            before, end = 0, 0
            for m in re.finditer(pattern, t):
                base, votes, feats = votes_by_hand(kind, t, m.start(), m.end(), before)
                found.append((m.start(), k, m.end(), base, votes, feats))
                before, end = end, m.end()
        rows.append(sorted(x for x in found if x[3] or not any(b[3] and x[0] < b[2] and b[0] < x[2] for b in found)))
    table = {}
    for _, k, _, _, v, f in (x for r in rows for x in r):
        table[k, v, f] = table.get((k, v, f), 0) + 1
    w = pii.train([(*key, n) for key, n in sorted(table.items())])
    out = []
    for r in rows:
        keep, at = [x for x in r if x[3]], 0
        for x in r:
            p = 1 / (1 + math.exp(-sum(w[i] for i in pii.inputs(x[1], x[4], x[5]))))
            if not x[3] and p >= pii.ACCEPT and x[0] >= at:
                keep.append(x)
                at = x[2]
        out.append(",".join(f"{list(pii.PATTERNS)[k]}:{a}:{z}" for a, k, z, *_ in sorted(keep)))
    return out


PRIVATE = ["call 312-555-0147 now", "fax (212) 736 5000.", "version 10.20.30.40", "token = \"" + "a7f1" * 10 + "\"", "commit " + "0c9d" * 10, "isbn 123-45-6789", "ssn: 123-45-6789", "order 212-555-0101", "from 8.8.4.4 logged in", "visa 4012888888881881", "serial 4012888888881880", "mail bob@gmail.com", "noreply@x.org", "+44 20 7946 0958", "phone +0 000 000 0000", "key: AKIA" + "Q1W2" * 8, "sha1 " + "12ab" * 10, "nonce=\"" + "9e8d" * 10 + "\"", "a/b/" + "77aa" * 10, "x=9.9.9.9", "/4.4.4.4/", "AKIA" + "Z9Y8" * 8, "call 800-555-0102 now"]


def private_texts(seed, n=260):
    rng = random.Random(seed)
    return [" ".join(rng.choice(PRIVATE) if rng.random() < 0.3 else rng.choice(["and", "the;", "über", "so."]) for _ in range(rng.randint(0, 25))) for _ in range(n)] + [None, "", *PRIVATE]


def test_added_spans_by_brute_force(spark):
    texts = private_texts(4)
    got = {r.doc_id: r.spans for r in pii.run(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    want = spans_by_hand(texts)
    assert [got[i] for i in range(len(texts))] == want
    first = dict(zip(PRIVATE, want[-len(PRIVATE) :], strict=True))
    assert first["token = \"" + "a7f1" * 10 + "\""].startswith("secret") and first["ssn: 123-45-6789"].startswith("ssn") and first["call 312-555-0147 now"].startswith("national")
    assert first["commit " + "0c9d" * 10] == first["isbn 123-45-6789"] == first["serial 4012888888881880"] == first["order 212-555-0101"] == ""


@pytest.mark.parametrize("labeler", ["gazetteer", "cue", "frame"])
def test_every_labeler_matters(spark, monkeypatch, labeler):
    """Turning one labeler's votes round changes its reliability and the spans that are added."""
    texts = private_texts(5)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = pii.candidates(df, "doc_id")
    patterns = pii.count_patterns(rows)
    at = pii.LABELERS.index(labeler)
    turned = [(k, tuple(-x if i == at else x for i, x in enumerate(v)), f, n) for k, v, f, n in patterns]
    accuracy = lambda p: pii.aggregate_votes([(k, v, n) for k, v, _, n in p])[1]["accuracy"]
    assert accuracy(patterns)[at] > accuracy(turned)[at] + 0.05
    assert len({round(a, 3) for a in accuracy(patterns)}) == 4 and all(0.5 < a < 0.995 for a in accuracy(patterns))
    before = [r.spans for r in pii.find(df).orderBy("doc_id").collect()]
    form = pii.count_patterns
    monkeypatch.setattr(pii, "count_patterns", lambda rows: [(k, tuple(-x if i == at else x for i, x in enumerate(v)), f, n) for k, v, f, n in form(rows)])
    assert [r.spans for r in pii.find(df).orderBy("doc_id").collect()] != before


def test_licenses_against_sql(spark, texts, empty):
    rng = random.Random(2)
    rows = list(texts)
    for i in range(90):
        t = rng.choice(licenses.TEMPLATES)[1].split()
        for _ in range(rng.randint(0, 3)):
            t[rng.randrange(len(t))] = "other"
        rows.append(f"{rng.choice(texts[:60])}\n{rng.choice([' ', ', ', '-']).join(t)}. {rng.choice(texts[:60])}")
    rows += ["Under the MIT license under-the-MIT/LICENSE.", "Apache License, Version 2.0", "CC BY-NC 4.0 ccc by nc", "Kapache", "under the mit licenses"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(rows)], "doc_id long, text string, labels string")
    got = licenses.run(df)
    con = duckdb.connect()
    con.register("documents", df.select("doc_id", "text").toPandas())
    want = con.sql(licenses.duckdb_sql())
    cols = got.columns
    assert sorted(cols) == sorted(want.columns)
    a = sorted((tuple(r) for r in got.collect()), key=str)
    b = sorted(want.select(*cols).fetchall(), key=str)
    assert [tuple(map(str, r)) for r in a] == [tuple(map(str, r)) for r in b]
    assert sum(bool(r[6]) for r in a) > 30
    first = next(r for r in got.collect() if r.doc_id == len(rows) - 5)
    assert (first.n_base, first.first_word, first.last_word, first.base_labels) == (2, 0, 4, "mit")
    assert licenses.run(empty).count() == 0


def test_no_notice_carries_a_sibling_label(spark):
    """Every template, at any place of a text and with a title or a year put in, has its own label and no other."""
    rng = random.Random(6)
    rows, want = [], {}
    for label, notice in licenses.TEMPLATES:
        w = notice.split()
        spread = w[: len(w) // 2] + [f"title{i}" for i in range(30)] + w[len(w) // 2 :]
        for k, t in enumerate((w, spread if len(w) > 13 else w)):
            for before in (0, 7, 45, 63, 100):
                want[len(rows)] = {label}
                rows.append((len(rows), " ".join([f"p{rng.randrange(99)}x" for _ in range(before)] + t + [f"q{rng.randrange(99)}x" for _ in range(k * 90)])))
    both = " ".join(t for label, t in licenses.TEMPLATES if label in ("mit", "apache-2"))
    want[len(rows)] = {"mit", "apache-2"}
    rows.append((len(rows), both))
    got = {r.doc_id: set(r.labels.split(",")) for r in licenses.run(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k: v for k, v in got.items() if not v - {"cc-by-nc"} <= want[k] or not want[k] <= v} == {}
    assert all(v == want[k] for k, v in got.items())


def test_native_queries_with_repeated_ids_long_texts_and_clashing_columns(spark):
    """Rows of one id are scanned one by one; a long text is read to its end."""
    long = "word " * 60_000 + "mail a@b.cc under the MIT license."
    rows = [(1, "Under the MIT license.", "x", 1, "y"), (1, "Under the MIT license.", "x", 1, "y"), (1, "a@b.cc", None, None, None), (2, long, "x", 1, "y"), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string, n_words int, hits string")
    found = sorted(((r.doc_id, r.n_base, r.first_word) for r in licenses.run(df).collect()), key=str)
    assert found == sorted([(1, 1, 0), (1, 1, 0), (1, 0, None), (2, 1, 60_004), (None, 0, None)], key=str)
    spans = sorted(((r.doc_id, r.spans) for r in pii.run(df).collect()), key=str)
    assert spans == sorted([(1, ""), (1, ""), (1, "email:0:6"), (2, f"email:{5 * 60_000 + 5}:{5 * 60_000 + 11}"), (None, "")], key=str)
