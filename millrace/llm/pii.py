"""Personal data by weak-supervision aggregation (component 8). DataFrame functions only.

Regular expressions propose candidate spans: everything shaped like an e-mail, address, card, phone,
national phone, social-security number or secret key, good or bad. Four labelers vote on each
candidate (1, -1, or 0 where they know nothing):

* *form*: what the match itself proves or rules out (ranges, checksum, digit counts); a shape that
  many other things have, such as a hexadecimal string or a dotted number, proves nothing;
* *gazetteer*: the value against lists (mail providers, reserved networks, card issuers, calling and
  toll-free codes, key prefixes);
* *cue*: words around it that name such data, or other things (context);
* *frame*: the characters that touch it: an assignment, or a longer token it is cut from (context).

Candidates are counted by votes and features over the whole corpus. Expectation-maximisation estimates
how reliable each labeler is and how common each kind, and a logistic span classifier is trained on
its posteriors, with features of its own beside the votes: length, share of digits, variety of
characters and the kind's cues. Both fits see only the table of patterns, at most kinds x 81 x 18
rows, never a document. The classifier alone decides what is added.

Spans of the base rules are always reported; the classifier adds others that overlap neither these
nor an earlier added one. Positions are code points. Matches and their places come from one split of
the text by the pattern; the patterns are written with possessive groups, so long texts neither
overflow the stack nor backtrack without bound.

Defined cases: null counts as empty and has no spans; repeated rows, also of one id, are scanned one
by one and count as often; spans of one start are ordered by kind; texts of any length are read whole;
``find`` reads no column beside ``doc_id`` and ``text``, whatever their names, and ``redact`` keeps all
others as they are; an empty table gives no rows; with no candidates nothing is added.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

# The kinds in their order, their patterns, and the words of the gazetteers.
LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "national": r"(?<![0-9+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "secret": r"(?<![A-Za-z0-9_])[A-Za-z0-9_]{32,64}(?![A-Za-z0-9_])",
}
#: what must be in a text for a pattern to be tried
GATES = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}", "phone": r"\+[0-9]", "national": r"[0-9]{3}[\x20.-][0-9]{4}", "ssn": r"[0-9]-[0-9]{2}-[0-9]", "secret": r"[A-Za-z0-9_]{32}"}
BASE = ("email", "ip", "card", "phone")
PHONE_CUES = "phone|tel|telephone|mobile|call|fax|cell|sms|whatsapp|dial"
CUES = {
    "email": "e-?mail|mail|contact|write|reply",
    "ip": "ip|address|host|client|login|logged",
    "card": "card|visa|mastercard|amex|credit|debit|payment|paid",
    "phone": PHONE_CUES,
    "national": PHONE_CUES,
    "ssn": "ssn|social security|taxpayer",
    "secret": "token|secret|api[_ -]?key|password|passwd|key|auth|bearer|credentials?",
}
OTHERS = r"(?i)\b(?:version|release|build|isbn|issn|doi|order|invoice|page|pages|chapter|figure|section|sha1|sha256|md5|commit|revision|checksum|digest|hash|uuid|serial)\b"
PROVIDERS = "gmail|googlemail|outlook|hotmail|live|msn|yahoo|icloud|me|aol|proton|protonmail|gmx|web|mail|yandex|qq|163|126|orange|free|libero|t-online"
ROLES = "no-?reply|do-?not-?reply|mailer-daemon|postmaster|webmaster|hostmaster|abuse|info|support|sales|admin"
RESERVED = r"^0*(?:0|10|127|22[4-9]|23[0-9]|24[0-9]|25[0-5])\.|^192\.168\.|^172\.(?:1[6-9]|2[0-9]|3[01])\.|^169\.254\."
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[0-9]|6[0245])"
CALLING = r"^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|2[1-69][0-9]|3[578][0-9]|42[0-9]|5[09][0-9]|6[789][0-9]|8[0578][0-9]|9[679][0-9])"
TOLL_FREE = r"^\(?(?:800|822|833|844|855|866|877|888|900)"
KEY_PREFIXES = r"^(?:gh[pousr]_|github_pat_|glpat|sk_live_|sk_test_|pk_live_|AKIA|ASIA|xox[abp]|AIza)"
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
NEAR = 48
LABELERS = ("form", "gazetteer", "cue", "frame")
#: features of a span beside its kind and votes, and how many values each has
FEATURES = {"size": 3, "digits": 3, "variety": 2}
ACCEPT = 0.6
EM_STEPS = 60
#: how reliable the labelers are taken to be at first (a checksum more than a list), and how many votes that counts as
TRUST = (0.9, 0.75, 0.85, 0.75)
STRENGTH = 10
#: matches whose places are summed together
RUN = 64

_RANK = {k: i for i, k in enumerate(PATTERNS)}


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(number: Column) -> Column:
    d = F.transform(F.split(F.reverse(number), ""), lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise(F.when(x.cast("int") > 4, x.cast("int") * 2 - 9).otherwise(x.cast("int") * 2)))
    return F.aggregate(d, F.lit(0), lambda a, x: a + x) % 10 == 0


def vote(yes: Column | None, no: Column | None) -> Column:
    out = F.when(no, -1) if no is not None else F.when(yes, 1)
    if no is not None and yes is not None:
        out = out.when(yes, 1)
    return out.otherwise(0)


def base_form(kind: str, m: Column) -> Column:
    """Whether a match passes the base rules' check of its kind."""
    n = F.length(digits(m))
    checks = {"email": F.lit(True), "ip": m.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"), "card": n.between(14, 19) & luhn(digits(m)), "phone": n.between(10, 15)}
    return checks.get(kind, F.lit(False))


def form(kind: str, m: Column, good: Column) -> Column:
    """What the match proves by itself; ``good`` says whether it passes the base check."""
    votes = {
        "email": lambda: vote(m.rlike(r"\.[A-Za-z]{2,}$"), ~m.rlike(r"\.[A-Za-z]{2,}$")),
        "ip": lambda: vote(None, ~good),
        "card": lambda: vote(good, ~good),
        "phone": lambda: vote(good, ~good),
        "national": lambda: vote(None, m.rlike(r"^\(?[01]") | m.rlike(r"^\(?[0-9]{3}[^0-9]+[01]")),
        "ssn": lambda: vote(None, m.rlike(r"^(?:000|666|9..)|-00-|-0000$")),
        "secret": lambda: vote(None, ~m.rlike("[0-9]") | ~m.rlike("[A-Za-z]") | (F.length(digits(m)) < 5)),
    }
    return votes[kind]()


def gazetteer(kind: str, m: Column) -> Column:
    """What the lists know of the value."""
    votes = {
        "email": lambda: vote(m.rlike(rf"(?i)@(?:[a-z0-9-]+\.)*(?:{PROVIDERS})\.[a-z.]{{2,}}$"), m.rlike(rf"(?i)^(?:{ROLES})@")),
        "ip": lambda: vote(m.rlike(r"^0*[1-9]"), m.rlike(RESERVED)),
        "card": lambda: vote(m.rlike(ISSUERS), ~m.rlike(ISSUERS)),
        "phone": lambda: vote(digits(m).rlike(CALLING), ~digits(m).rlike(CALLING)),
        "national": lambda: vote(None, m.rlike(TOLL_FREE)),
        "ssn": lambda: vote(None, m.isin("078-05-1120", "219-09-9999")),
        "secret": lambda: vote(m.rlike(KEY_PREFIXES), None),
    }
    return votes[kind]()


def cue(kind: str, left: Column, right: Column) -> Column:
    names = rf"(?i)\b(?:{CUES[kind]})\b"
    return F.when(left.rlike(names), 1).when(left.rlike(OTHERS), -1).when(right.rlike(names), 1).otherwise(0)


def frame(left: Column, right: Column) -> Column:
    return F.when(left.rlike(r"[=:]\s*[\"'(<\[]?$"), 1).when(left.rlike(r"[\p{L}0-9/\\#_%-]$") | right.rlike(r"^[\p{L}0-9/\\_%]"), -1).otherwise(0)


def features(m: Column) -> dict[str, Column]:
    """Length, share of digits and variety of characters of a match, in steps."""
    n, d = F.length(m), F.length(digits(m))
    kinds = F.size(F.array_distinct(F.split(F.substring(m, 1, 64), "")))
    return {"size": F.when(n <= 14, 0).when(n <= 24, 1).otherwise(2), "digits": F.when(d * 10 < n * 3, 0).when(d * 10 < n * 8, 1).otherwise(2), "variety": (kinds >= 10).cast("int")}


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ends(sizes: Column) -> Column:
    """Sum of all sizes before each run of ``RUN``."""
    runs = F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / RUN).cast("int"))
    total = lambda k: F.aggregate(F.slice(sizes, k * RUN + 1, RUN), F.lit(0), lambda a, x: a + x)
    nothing = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("before"))
    return F.aggregate(F.transform(runs, total), nothing, lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["before"], F.array(a["at"])).alias("before")))["before"]


FIELDS = ("form", "gazetteer", "cue", "frame", *FEATURES)


def matches(text: Column, kind: str) -> Column:
    """All matches of a kind in order: start, end, whether the base rules take it, votes and features."""
    pattern = PATTERNS[kind]
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    both = F.arrays_zip(found.alias("m"), gaps.alias("g"), F.slice(gaps, 2, F.size(gaps)).alias("h"))
    both = F.slice(both, 1, F.size(found))
    empty = F.array().cast(f"array<struct<start:int,end:int,ok:boolean,{','.join(f'{x}:int' for x in FIELDS)}>>")

    def rows(x: Column) -> Column:
        return bind(F.transform(x, lambda y: F.length(y["g"]) + F.length(y["m"])), lambda sizes: bind(ends(sizes), lambda before: F.transform(x, lambda y, i: row(x, sizes, before, y, i))))

    def row(x: Column, sizes: Column, before: Column, y: Column, i: Column) -> Column:
        m, last = y["m"], F.get(x, i - 1)
        run = F.floor(i / RUN).cast("int")
        start = F.get(before, run) + F.aggregate(F.slice(sizes, run * RUN + 1, i - run * RUN), F.lit(0), lambda a, z: a + z) + F.length(y["g"])
        # what stands before reaches over the match before, so neighbours do not hide a cue
        left = F.right(F.concat(F.coalesce(F.right(last["g"], F.lit(NEAR)), F.lit("")), F.coalesce(last["m"], F.lit("")), F.right(y["g"], F.lit(NEAR))), F.lit(NEAR))
        right = F.left(y["h"], F.lit(NEAR // 2))
        good = base_form(kind, m)
        votes = {"form": form(kind, m, good), "gazetteer": gazetteer(kind, m), "cue": cue(kind, left, right), "frame": frame(left, right)} | features(m)
        return F.struct(start.alias("start"), (start + F.length(m)).alias("end"), good.alias("ok"), *[votes[f].alias(f) for f in FIELDS])

    gate = text.contains(GATES[kind]) if kind == "email" else text.rlike(GATES[kind])
    return F.when(gate & (F.size(found) > 0), bind(both, rows)).otherwise(empty)


def candidates(docs: DataFrame, *keep: str) -> DataFrame:
    """``spans``: every candidate of a row with its kind's rank and votes, in order of start and kind. What overlaps
    a base span is part of that, such as the national number in an international one, and no candidate."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    slim = docs.select(*[F.col(c) for c in keep], text.alias("__text"))
    some = F.col("__text").rlike("[0-9@]|[A-Za-z0-9_]{32}")
    for kind in PATTERNS:
        slim = slim.withColumn(f"__{kind}", F.when(some, matches(F.col("__text"), kind)))
    tagged = [F.transform(F.coalesce(F.col(f"__{kind}"), F.array().cast(slim.schema[f"__{kind}"].dataType)), _tag(kind)) for kind in PATTERNS]
    rows = slim.select(*keep, F.array_sort(F.concat(*tagged)).alias("spans")).withColumn("__base", F.filter("spans", lambda s: s["base"]))
    apart = F.filter("spans", lambda s: s["base"] | ~F.exists("__base", lambda b: (s["start"] < b["end"]) & (b["start"] < s["end"])))
    return rows.select(*keep, F.when(F.size("__base") > 0, apart).otherwise(F.col("spans")).alias("spans"))


def _tag(kind: str):
    return lambda x: F.struct(x["start"].alias("start"), F.lit(_RANK[kind]).alias("kind"), x["end"].alias("end"), (F.lit(kind in BASE) & x["ok"]).alias("base"), *[x[f].alias(f) for f in FIELDS])


def aggregate_votes(patterns: list[tuple[int, tuple[int, ...], int]]) -> tuple[dict, dict[str, list[float]]]:
    """Posterior of each (kind, votes) pattern, and each labeler's accuracy when it votes.

    Two-class EM with a prior per kind and, per kind and labeler, how often its vote on a true and on a false
    candidate is 1. They start from ``TRUST``, which counts as ``STRENGTH`` votes.
    """
    kinds = sorted({k for k, _, _ in patterns})
    rate = {(j, k): (t, 1 - t) for j, t in enumerate(TRUST) for k in kinds}
    prior = dict.fromkeys(kinds, 0.5)
    post: dict = {}
    for _ in range(EM_STEPS):
        for k, v, _ in patterns:
            a = math.log(prior[k] / (1 - prior[k]))
            for j, x in enumerate(v):
                if x:
                    p, q = rate[j, k]
                    a += math.log(p / q) if x > 0 else math.log((1 - p) / (1 - q))
            post[k, v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, a))))
        for k in kinds:
            mine = [(v, post[k, v], n) for k2, v, n in patterns if k2 == k]
            prior[k] = min(0.95, max(0.05, (sum(p * n for _, p, n in mine) + 1) / (sum(n for _, _, n in mine) + 2)))
            for j, t in enumerate(TRUST):
                voted = [(v[j] > 0, p, n) for v, p, n in mine if v[j]]
                true, false = sum(p * n for _, p, n in voted), sum((1 - p) * n for _, p, n in voted)
                rate[j, k] = ((sum(p * n for up, p, n in voted if up) + STRENGTH * t) / (true + STRENGTH), (sum((1 - p) * n for up, p, n in voted if up) + STRENGTH * (1 - t)) / (false + STRENGTH))
    right = []
    for j, t in enumerate(TRUST):
        good = sum(n * (post[k, v] if v[j] > 0 else 1 - post[k, v]) for k, v, n in patterns if v[j])
        right.append((good + STRENGTH * t) / (sum(n for _, v, n in patterns if v[j]) + STRENGTH))
    return post, {"accuracy": right}


Pattern = tuple[int, tuple[int, ...], tuple[int, ...], int]


def inputs(kind: int, votes: tuple[int, ...], feats: tuple[int, ...]) -> list[tuple[str, int]]:
    """The indicators of a span: its kind, each vote, its kind's cue and frame, and each feature by kind."""
    out = [("kind", kind), *[(x, v) for x, v in zip(LABELERS, votes, strict=True)]]
    out += [(f"kind:{x}", kind * 8 + v) for x, v in zip(LABELERS, votes, strict=True) if x in ("cue", "frame")]
    return out + [(f"kind:{f}", kind * 8 + v) for f, v in zip(FEATURES, feats, strict=True)]


def train(patterns: list[Pattern]) -> dict[tuple[str, int], float]:
    """Weights of the span classifier: logistic regression of the posteriors on its indicators, by gradient steps."""
    tally: dict[tuple[int, tuple[int, ...]], int] = {}
    for k, v, _, n in patterns:
        tally[k, v] = tally.get((k, v), 0) + n
    post, _ = aggregate_votes([(k, v, n) for (k, v), n in sorted(tally.items())])
    rows = [(inputs(k, v, f), post[k, v], n) for k, v, f, n in patterns]
    names = sorted({x for r, _, _ in rows for x in r})
    w = dict.fromkeys(names, 0.0)
    # every kind weighs alike, so a rare one is learned as well as a common one
    mass: dict[int, int] = {}
    for k, _, _, n in patterns:
        mass[k] = mass.get(k, 0) + n
    share = [n / mass[k] for (k, _, _, n) in patterns]
    for _ in range(600):
        g = {x: 1e-3 * a for x, a in w.items()}
        for (r, target, _), n in zip(rows, share, strict=True):
            p = 1 / (1 + math.exp(-sum(w[x] for x in r)))
            for x in r:
                g[x] += (p - target) * n
        for x in names:
            w[x] -= 0.25 * g[x]
    return w


def probability(w: dict[tuple[str, int], float], s: Column) -> Column:
    """The classifier over a span column; indicators never seen weigh nothing."""

    def weight(name: str, value: Column, values: range) -> Column:
        return F.get(F.array(*[F.lit(w.get((name, v), 0.0)) for v in values]), value - values.start)

    kinds, votes = range(len(PATTERNS)), range(-1, 2)
    total = weight("kind", s["kind"], kinds)
    for x in LABELERS:
        total = total + weight(x, s[x], votes)
    wide = range(-1, 8 * len(PATTERNS) + 8)
    for x in ("cue", "frame", *FEATURES):
        total = total + weight(f"kind:{x}", s["kind"] * 8 + s[x], wide)
    return 1 / (1 + F.exp(-total))


def count_patterns(rows: DataFrame) -> list[Pattern]:
    """Candidates by kind, votes and features; a bounded table."""
    by = ["kind", *FIELDS]
    got = rows.select(F.explode("spans").alias("s")).groupBy(*[f"s.{x}" for x in by]).agg(F.count(F.lit(1)).alias("n")).orderBy(*by).collect()
    return [(r["kind"], tuple(r[x] for x in LABELERS), tuple(r[x] for x in FEATURES), r["n"]) for r in got]


def decide(rows: DataFrame) -> DataFrame:
    """Candidates that stay: the base spans, and accepted ones that overlap neither them nor each other."""
    w = train(count_patterns(rows))
    base = F.filter("spans", lambda s: s["base"])
    more = F.filter("spans", lambda s: ~s["base"] & (probability(w, s) >= ACCEPT))
    rows = rows.withColumn("base", base).withColumn("more", more)
    nothing = F.struct(F.lit(0).alias("at"), F.filter("more", lambda s: F.lit(False)).alias("kept"))
    apart = F.aggregate("more", nothing, lambda a, s: F.when(s["start"] >= a["at"], F.struct(s["end"].alias("at"), F.concat(a["kept"], F.array(s)).alias("kept"))).otherwise(a))["kept"]
    rows = rows.withColumn("more", F.when(F.size("more") > 1, apart).otherwise(F.col("more")))
    return rows.withColumn("all", F.array_sort(F.concat("base", "more"))).drop("more", "spans")


def named(spans: str) -> Column:
    kinds = F.array(*[F.lit(k) for k in PATTERNS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame) -> DataFrame:
    """Counts, base digest and all spans of every row."""
    rows = materialize(candidates(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id"), "pii-spans")
    rows = decide(rows)
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == _RANK[kind])).cast("long").alias(f"n_{kind}")
    return rows.select("doc_id", *[count(k) for k in BASE], F.sha2(named("base"), 256).alias("base_sha256"), named("all").alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind in brackets; null texts stay null."""
    cols = docs.columns
    rows = decide(materialize(candidates(docs, *cols), "pii-spans"))
    kinds = F.array(*[F.lit(k.upper()) for k in PATTERNS])

    def step(acc: Column, s: Column) -> Column:
        between = F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"])
        return F.when(s["start"] >= acc["at"], F.struct(s["end"].alias("at"), F.concat(acc["out"], between, F.lit("["), F.get(kinds, s["kind"]), F.lit("]")).alias("out"))).otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out")))

    done = F.aggregate("all", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda a: F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, F.length("text"))))
    return rows.withColumn("text", F.when(F.size("all") > 0, done).otherwise(F.col("text"))).select(*cols)


def run(docs: DataFrame) -> DataFrame:
    return find(docs)
