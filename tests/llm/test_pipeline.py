import re

import pytest

import corpus_pipeline as cp
from playmetrics.llm import quality_rff
from test_pack_harmonic import check
from test_simhash_pivots import brute_components, brute_fp

D = "/root/testdata/sf0.01"
SECRETS = [(re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
            2, 8), (re.compile("AKIA[A-Z0-9]+"), 0, 16), (re.compile("[0-9a-f]+"), 0, 32)]


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def contaminated(text, windows):
    w, hit = words(text), set()
    for n in {len(g) for g in windows}:
        for k in range(len(w) - n + 1):
            if tuple(w[k:k + n]) in windows:
                hit.update(range(k, k + n))
    return len(hit) > 0 and 20 * len(hit) >= len(w)


def redacted(text):
    spans = sorted({m.span() for p, g, n in SECRETS for m in p.finditer(text) if len(m[g]) >= n})
    out, at = [], 0
    for a, b in spans:
        if a >= at:
            out.append(text[at:a] + "[SECRET]")
        at = max(at, b)
    return "".join(out) + text[at:]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    out = [spark.read.parquet(f"{D}/documents.parquet")]
    for name, stage in cp.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "t")
        stage(spark, out[-1], D).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_columns_stay(stages):
    for df in stages[1:-1]:
        assert df.dtypes == stages[0].dtypes


def test_quality_stage(spark, stages):
    labels = spark.read.parquet(f"{D}/labels.parquet")
    scores = quality_rff.score_documents(stages[0], labels).where("score >= 0.7").collect()
    assert {r["doc_id"] for r in scores} == set(texts(stages[1]))
    marked = {r["doc_id"]: r["quality"] for r in labels.collect()}
    lost = [q for i, q in marked.items() if i not in texts(stages[1])]
    assert lost.count(1) <= 0.02 * len(marked) and lost.count(0) >= 0.9 * list(marked.values()).count(0)


def test_near_duplicate_stage(stages):
    docs = sorted(texts(stages[1]).items())
    groups = brute_components([brute_fp(t) for _, t in docs])
    assert set(texts(stages[2])) == {docs[g][0] for g in groups}


def test_benchmark_stage(spark, stages):
    windows = set()
    for r in spark.read.parquet(f"{D}/benchmark.parquet").collect():
        w = words(r["text"])
        windows.update(tuple(w[k:k + 13]) for k in range(max(1, len(w) - 12)) if w)
    before = texts(stages[2])
    assert texts(stages[3]) == {i: t for i, t in before.items() if not contaminated(t, windows)}
    assert len(texts(stages[3])) < len(before)


def test_secrets_stage(stages):
    before, after = texts(stages[3]), texts(stages[4])
    assert {i: redacted(t) for i, t in before.items()} == after
    assert before != after


def test_packing_stage(stages):
    check(texts(stages[4]), stages[5].collect())


def test_odd_rows(spark, tmp_path):
    """Nulls, empty tables, repeated rows and extra columns pass through all stages."""
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, "token: abcdefgh12", None, "s", 17),
            (2, "token: abcdefgh12", None, "s", 17), (3, "w " * 9000, "en", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.selectExpr("*", "1 AS n", "2 AS c0", "3 AS blob")
    for table in (docs, docs.where("false")):
        for name, stage in cp.STAGES[:-1]:
            out = stage(spark, table, "/root/testdata/sf0.001")
            assert out.dtypes == table.dtypes
            out.collect()
        assert cp.packing(spark, table, "").count() >= table.count()

def test_scratch_is_dropped_on_request(spark):
    from playmetrics.llm.common import drop_scratch, own_dir, write_table
    table = write_table(spark.range(3), "kept")
    assert table.count() == 3 and spark.sparkContext.applicationId in own_dir(spark)
    assert drop_scratch(spark) and not drop_scratch(spark)
