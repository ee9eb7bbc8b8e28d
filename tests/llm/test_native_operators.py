"""Secret ledger and benchmark decontamination on small odd tables."""

import pytest

from playmetrics.llm import decontaminate as dc, secret_ledger as sl

SECRET = "é token: abcdefgh12 x"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, SECRET), (2, SECRET), (2, SECRET), (None, SECRET), (3, None), (4, ""), (5, "password=short"),
            (6, "a" * 40 + " AKIA" + "B" * 12 + " secret=" + "f" * 32)]
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS blob", "2 AS spans")


def test_spans_and_redaction(docs):
    ledger = sl.update_ledger(docs, "doc_id", "text")
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]]
           for r in sl.findings(docs, "doc_id", "text", ledger).collect()}
    assert got[1] == got[2] == got[None] == [("assign", 2, 19)]
    assert got[3] == got[4] == got[5] == []
    assert got[6] == [("hex", 0, 40), ("access", 41, 57), ("assign", 58, 97), ("hex", 65, 97)]
    out = sl.redact_secrets(docs, "doc_id", "text")
    texts = sorted((str(r["doc_id"]), r["text"]) for r in out.collect())
    assert out.columns == docs.columns and len(texts) == 8
    assert texts[0] == ("1", "é [SECRET] x") and ("3", None) in texts
    assert ("6", "[SECRET] [SECRET] [SECRET]") in texts
    assert sl.redact_secrets(docs.where("false"), "doc_id", "text").count() == 0


def test_only_unseen_pairs_are_scanned(spark, docs):
    ledger = sl.update_ledger(docs, "doc_id", "text", sl.BASE_RULES)
    rows = lambda: spark.read.schema(sl.LEDGER_SCHEMA).parquet(ledger)
    n = rows().count()
    assert n == docs.selectExpr("coalesce(text, '') AS t").distinct().count()
    sl.update_ledger(docs, "doc_id", "text", sl.BASE_RULES, ledger)
    assert rows().count() == n  # nothing new
    sl.update_ledger(spark.createDataFrame([(9, SECRET), (9, "new")], "doc_id long, text string"),
                     "doc_id", "text", sl.BASE_RULES, ledger)
    assert rows().count() == n + 1  # a new blob; the old one under a new path is known
    newer = (sl.Rule("hex", 2, "[0-9a-f]{40,}"),)
    sl.update_ledger(docs, "doc_id", "text", newer, ledger)
    fresh = [r for r in rows().collect() if [s["version"] for s in r["scans"]] == [2]]
    assert len(fresh) == n  # the new version alone, once for each blob
    found = sl.findings(docs, "doc_id", "text", ledger, newer).where("doc_id = 6").first()
    assert [(s["start"], s["end"]) for s in found["spans"]] == [(0, 40)]


def test_benchmark_hits(spark):
    item = " ".join(f"w{i}" for i in range(20))
    bench = spark.createDataFrame([(1, item), (1, item), (2, "Short One"), (3, None), (None, "only null")],
                                  "item_id long, text string")
    rows = [(1, f"Before {item.upper()}, after"), (2, "a short-one."), (2, "a short-one."), (3, None), (4, "one short"),
            (None, "x " * 50 + "only null"), (5, " ".join(f"w{i}" for i in range(12)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS row", "2 AS hit")
    want = {1: (20, ["1"], True), 2: (2, ["2"], True), 3: (0, [], False), 4: (0, [], False),
            None: (2, [], False), 5: (0, [], False)}
    for max_set, bloom in ((200_000, 1), (1, 1), (1, 1 << 10)):  # the set, and the filter beyond its bound
        found = dc.verdict(dc.find_contamination(docs, bench, max_set=max_set, bloom=bloom)).collect()
        assert len(found) == 7
        assert {r["doc_id"]: (r["n_hit"], sorted(r["items"]), r["contaminated"]) for r in found} == want
    left = dc.decontaminate(docs, bench)
    assert left.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in left.collect()) == ["3", "4", "5", "None"]
    cut = {r["doc_id"]: r["text"] for r in dc.decontaminate(docs, bench, remove="spans").collect()}
    assert cut[2] == "a -." and cut[3] is None and cut[4] == "one short"
    assert dc.decontaminate(docs.where("false"), bench).count() == 0
    assert dc.decontaminate(docs, bench.where("false")).count() == 7


def test_both_sides_of_the_bound_agree(spark):
    d = "/root/testdata/sf0.01"
    docs, bench = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "benchmark"))
    copies = bench.unionByName(bench.selectExpr("item_id + 1000 AS item_id", "text"))  # other ids
    for b in (bench, copies):
        one, two = (sorted((r["doc_id"], r["n_words"], sorted(r["hit"]), sorted(r["items"])) for r in
                    dc.find_contamination(docs, b, max_set=m).collect()) for m in (200_000, 1))
        assert one == two and any(hit for _, _, hit, _ in one)


def test_runs_at_a_time_count_a_scan_once(spark, docs):
    ledger = sl.update_ledger(docs, "doc_id", "text")
    want = sorted(str(r["spans"]) for r in sl.findings(docs, "doc_id", "text", ledger).collect())
    spark.read.schema(sl.LEDGER_SCHEMA).parquet(ledger).write.mode("append").parquet(f"{ledger}-again")
    spark.read.schema(sl.LEDGER_SCHEMA).parquet(f"{ledger}-again").write.mode("append").parquet(ledger)
    again = sorted(str(r["spans"]) for r in sl.findings(docs, "doc_id", "text", ledger).collect())
    assert again == want


def test_very_long_text(spark):
    text = "word " * 200_000 + "password=abcdefgh1 " + " ".join(f"b{i}" for i in range(13)) + " x" * 50_000
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(f"b{i}" for i in range(13)))], "item_id long, text string")
    for max_set in (200_000, 0):
        (r,) = dc.find_contamination(docs, bench, max_set=max_set).collect()
        assert sorted(r["hit"]) == list(range(200_002, 200_015)) and r["items"] == ["7"]
    (r,) = sl.findings(docs, "doc_id", "text", sl.update_ledger(docs, "doc_id", "text")).collect()
    assert [(s["kind"], s["start"], s["end"]) for s in r["spans"]] == [("assign", 1_000_000, 1_000_018)]
