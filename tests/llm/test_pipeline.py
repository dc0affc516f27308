"""The corpus pipeline: every stage on what the one before kept."""

import zlib
from collections import defaultdict

import corpus_pipeline
import numpy as np
import pytest

from millrace.llm import common, language, pii, queries
from tests.llm.test_dedup_operators import components
from tests.llm.test_models import grams, ranking
from tests.llm.test_native_operators import spans_by_hand
from tests.llm.test_text_operators import leaks_by_hand


@pytest.fixture(scope="module")
def sf(spark, docs, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    docs.write.parquet(str(path / "documents.parquet"))
    leak = docs.where("doc_id = 30").first().text
    spark.createDataFrame([(0, leak[:250]), (1, None)], "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    return str(path)


def test_stages_keep_columns_and_take_effect(spark, docs, texts, sf, tmp_path):
    at, seen = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, sf)
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        at = spark.read.parquet(str(tmp_path / name))
        seen[name] = sorted(r.doc_id for r in at.select("doc_id").collect())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "decontamination", "personal_data", "packing"]
    # without a letter, or of a single letter that no profile ranks
    foreign = {i for i, t in enumerate(texts) if t == "x" or not any(c.isalpha() for c in t or "")}
    assert set(seen["language_id"]) == set(range(len(texts))) - foreign
    assert len(seen["near_duplicates"]) == len(set(seen["near_duplicates"])) < len(seen["language_id"])
    assert 30 not in seen["decontamination"] and set(seen["decontamination"]) >= set(seen["near_duplicates"]) - {30, len(texts) - 1}
    assert seen["personal_data"] == seen["decontamination"] and set(seen["packing"]) == set(seen["personal_data"])
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, sf).select("doc_id").collect()) == seen["packing"]


def test_all_ten_are_registered():
    assert sorted(int(q[2:].split("_")[0]) for q in queries.queries()) == list(range(1, 11))
    assert corpus_pipeline.ORACLE_SQL is None and set(queries.oracle_sql()) <= set(queries.queries())


def run_by_hand(rows, items):
    """The whole pipeline in plain Python: (doc_id, piece, start, length, ids_crc32) of every piece left."""
    from tokenizers import Tokenizer

    counts = defaultdict(lambda: defaultdict(int))
    for i, t, lang in rows:
        if lang and t is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            for g, n in grams(t).items():
                counts[lang][g] += n
    profiles = [ranking(c) for c in counts.values()]

    def known(t):
        if not t or not any(c.isalpha() for c in t):
            return False
        own = ranking(grams(t))
        away = min(sum(abs(p[k] - r) if k in p else language.TOP for k, r in own.items()) for p in profiles)
        return 1 - away / (language.TOP * len(own)) >= language.REJECT_BELOW

    rows = [(i, t) for i, t, _ in rows if known(t)]
    first = components([t for _, t in rows])
    best = {}
    for k, (i, t) in enumerate(rows):
        best.setdefault(first[k][1], []).append((i, t))
    rows = [min(group) for group in best.values()]
    leaked = {d for d, _ in leaks_by_hand([t for _, t in rows], items)}
    rows = [r for k, r in enumerate(rows) if k not in leaked]
    out, tokenizer = [], Tokenizer.from_file(queries.tokenizer_path())
    for (i, t), spans in zip(rows, spans_by_hand([t for _, t in rows]), strict=True):
        done, at = "", 0
        for kind, a, z in (x.split(":") for x in spans.split(",") if x):
            if int(a) >= at:
                done += t[at : int(a)] + f"[{kind.upper()}]"
                at = int(z)
            at = max(at, int(z))
        ids = [*tokenizer.encode(done + t[at:], add_special_tokens=False).ids, 0]
        for k, a in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[a : a + 2048], "<u4")
            out.append((i, k, a, len(part), zlib.crc32(part.tobytes())))
    return sorted(out)


def test_run_by_brute_force(spark, docs, texts, tmp_path):
    """Every piece of ``run`` against the stages in plain Python, with personal data, leaks, copies, odd and repeated rows."""
    private = [f"{texts[k]} mail x{k}@y.example or +1 (212) 555-01{k} token = \"{'0f9e' * 10}\"" for k in range(20, 29)]
    more = spark.createDataFrame([(500 + k, t, "en", "p", None, None, None, None) for k, t in enumerate([*private, private[0], private[1] + " tail"])], docs.schema)
    rows = docs.unionByName(more)
    rows.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    items = [(0, " ".join(texts[30].split()[:40])), (1, " ".join(texts[40].split()[-45:]))]
    spark.createDataFrame([*items, (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    want = run_by_hand([(r.doc_id, r.text, r.lang) for r in rows.collect()], items)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want and len(want) > 60
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    assert all(sum(n for _, n in sorted(p)[:k]) == a for p in by.values() for k, (a, _) in enumerate(sorted(p)))
    assert max(sum(n for _, n in p) for p in by.values()) <= 2048


def test_an_empty_table_passes_through(spark, docs, tmp_path):
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, "some words to look for in it")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_leave_little_behind(spark, sf, tmp_path):
    """What a stage keeps in the shared folder once its result is written: at most what that result read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(common.scratch(spark))
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = lambda: {s.getPath().getName() for s in system.listStatus(path)} if system.exists(path) else set()
    at = spark.read.parquet(f"{sf}/documents.parquet")
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        before = names()
        stage(spark, at, sf).write.parquet(str(tmp_path / name))
        at = spark.read.parquet(str(tmp_path / name))
        left[name] = sorted(x.rsplit("-", 1)[0] for x in names() - before)
    assert left["near_duplicates"] == ["nd-gone", "nd-named", "nd-sets", "nd-twice"], left
    assert left["personal_data"] == ["pii-spans"] and len(left["packing"]) <= 6 and not left["decontamination"]
    assert pii.BASE == ("email", "ip", "card", "phone")
