import itertools
import random
import zlib

from pyspark.sql import functions as F

from playmetrics.llm import reshard_flow as rf
from playmetrics.llm.queries import op6_flow_resharding


def cost(flow, price):
    return sum(price(i, j) * n for (i, j), n in flow.items())


def test_flow_is_least_by_brute_force():
    rng = random.Random(3)
    for _ in range(40):
        n, m = rng.randint(1, 3), rng.randint(1, 3)
        supply = {i: rng.randint(0, 4) for i in range(n)}
        total = sum(supply.values())
        cuts = sorted(rng.randint(0, total) for _ in range(m - 1))
        capacity = {j: b - a for j, (a, b) in enumerate(zip([0, *cuts], [*cuts, total]))}
        table = {(i, j): rng.randint(0, 5) for i in supply for j in capacity}
        flow = rf.min_cost_flow(supply, capacity, lambda i, j: table[i, j])
        units = [i for i, k in supply.items() for _ in range(k)]
        places = [j for j, k in capacity.items() for _ in range(k)]
        best = min((sum(table[i, j] for i, j in zip(units, p)) for p in itertools.permutations(places)),
                   default=0) if total <= 7 else None
        for i, k in supply.items():
            assert sum(v for (a, _), v in flow.items() if a == i) == k
        for j, k in capacity.items():
            assert sum(v for (_, b), v in flow.items() if b == j) == k
        if best is not None:
            assert cost(flow, lambda i, j: table[i, j]) == best


def test_query_law(spark):
    d = "/root/testdata/sf0.01"
    rows = op6_flow_resharding(spark, d).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    assert {r["doc_id"] for r in rows} == set(docs) and len(rows) == len(docs)
    sizes, slots, old = {}, {}, {}
    for r in rows:
        assert r["size"] == len(docs[r["doc_id"]].encode()) + 1
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
        old[r["old_shard"]] = old.get(r["old_shard"], 0) + r["size"]
    assert set(sizes) == set(range(16))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    total = sum(sizes.values())
    assert max(abs(s - total / 16) for s in sizes.values()) < 0.05 * total / 16
    # as few bytes move as must: what each old shard has beyond its capacity
    moved = sum(r["size"] for r in rows if r["shard"] != r["old_shard"])
    must = sum(max(0, b - total / 16) for b in old.values())
    assert abs(moved - must) < 0.05 * must


def written(spark, folder, files, schema="doc_id long, text string, shard string"):
    """A layout of one file for each list of rows: {shard: [[rows], ...]}."""
    layout = {}
    for j, lists in files.items():
        for k, rows in enumerate(lists):
            path = str(folder / f"old{j}-{k}")
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
            layout.setdefault(j, []).extend(rf._named(f) for f in spark.read.parquet(path).inputFiles())
    return layout


def contents(spark, layout, schema="doc_id long, text string, shard string"):
    """{shard: [(slot, row)]} as read back."""
    out = {}
    for r in rf.read_layout(spark, layout, schema).collect():
        out.setdefault(r["shard"], []).append((r["slot"], tuple(r["doc"])))
    assert all(sorted(s for s, _ in rows) == list(range(len(rows))) for rows in out.values())
    return out


def rows(start, n):
    return [(start + k, "x" * 9, "s") for k in range(n)]


def test_whole_files_move_in_the_manifest_only(spark, tmp_path):
    old = written(spark, tmp_path, {0: [rows(0, 10), rows(10, 10), rows(20, 10), rows(30, 10)],
                                    1: [rows(100, 20)], 2: [rows(200, 20)]})
    new = rf.rewrite_affected(spark, old, "text", str(tmp_path / "new"), shards=4)
    assert new.flow == {(0, 0): 200, (0, 3): 200, (1, 1): 200, (2, 2): 200}
    assert new.rewritten == [] and not (tmp_path / "new").exists()  # every cut falls between files
    assert new.layout == {0: old[0][:2], 1: old[1], 2: old[2], 3: old[0][2:]}


def test_only_cut_files_are_written(spark, tmp_path):
    old = written(spark, tmp_path, {0: [rows(0, 8), rows(8, 9), rows(17, 30)], 3: [rows(100, 1)]})
    new = rf.rewrite_affected(spark, old, "text", str(tmp_path / "new"), shards=4)
    assert new.rewritten == old[0][1:]  # the cuts at 12, 24 and 36 of 48 rows
    kept = {f for fs in new.layout.values() for f in fs}
    assert old[0][0] in kept and old[3][0] in kept and not kept & set(new.rewritten)
    again = spark.read.parquet(str(tmp_path / "new"))
    assert again.count() == 39  # the rows of the cut files, no more
    got = contents(spark, new.layout)
    assert {j: len(r) for j, r in got.items()} == {0: 12, 1: 12, 2: 12, 3: 12}
    assert sorted(r for rs in got.values() for _, r in rs) == sorted(rows(0, 47) + rows(100, 1))
    assert sum(n for (i, j), n in new.flow.items() if i != j) == 350


def test_one_file_holds_most_rows_and_one_row_most_bytes(spark, tmp_path):
    big = [(k, "y" * (3_000_000 if k == 5 else 20), None) for k in range(60)]
    old = written(spark, tmp_path, {-1: [big], 7: [rows(100, 3)]})
    new = rf.rewrite_affected(spark, old, "text", str(tmp_path / "new"), shards=3)
    got = contents(spark, new.layout)
    assert sorted((r for rs in got.values() for _, r in rs), key=str) == sorted(big + rows(100, 3), key=str)
    assert set(got) <= {0, 1, 2}


def test_clashing_columns_nulls_and_repeats(spark, tmp_path):
    names = "doc_id long, text string, shard int, old_shard int, block string, row long, file string, doc long, shard_ int"
    docs = [(k if k % 5 else None, None if k % 7 == 0 else "" if k % 7 == 1 else "é" * (k % 40),
             k, -k, "b", k, "f", 1, None) for k in range(90)]
    docs += docs[3:20]
    df = spark.createDataFrame(docs, names)
    layout = rf.write_layout(df.repartition(3), F.pmod(F.col("row"), F.lit(4)))
    assert set(layout) == {0, 1, 2, 3}
    new = rf.rewrite_affected(spark, layout, "text", str(tmp_path / "new"), shards=6)
    got = contents(spark, new.layout, df.schema)
    assert sorted((r for rs in got.values() for _, r in rs), key=str) == sorted(docs, key=str)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    query = op6_flow_resharding(spark, str(tmp_path)).collect()
    assert len(query) == len(docs)
    want = sorted((str(d[0]), len((d[1] or "").encode()) + 1, zlib.crc32((d[1] or "").encode())) for d in docs)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in query) == want


def test_nothing_to_reshard(spark, tmp_path):
    assert rf.rewrite_affected(spark, {}, "text", str(tmp_path / "new")) == ({}, {}, [])
    assert rf.read_layout(spark, {}, "doc_id long, text string").collect() == []
    none = spark.createDataFrame([], "doc_id long, text string")
    assert rf.write_layout(none, F.lit(0)) == {}


def test_query_reads_what_it_wrote(spark, monkeypatch):
    d, calls, write = "/root/testdata/sf0.01", [], rf.rewrite_affected

    def spy(*args, **how):
        calls.append((args[1], write(*args, **how)))
        return calls[-1][1]

    monkeypatch.setattr(rf, "rewrite_affected", spy)
    got = op6_flow_resharding(spark, d).collect()
    (before, after), = calls
    old = {f: j for j, fs in before.items() for f in fs}
    assert any(i != j for i, j in after.flow) and 0 < len(after.rewritten) <= len(old)
    docs = {r["doc_id"]: r.asDict() for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    for j, paths in after.layout.items():
        files = {r["doc_id"]: r.asDict() for r in spark.read.schema(
            "doc_id long, text string, lang string, source string, n_chars long").parquet(*paths).collect()}
        assert all(files[i] == docs[i] for i in files)  # whole rows, texts included
        mine = [r for r in got if r["shard"] == j]
        assert {r["doc_id"] for r in mine} == set(files)
        assert sorted(r["slot"] for r in mine) == list(range(len(files)))
        for r in mine:
            raw = (files[r["doc_id"]]["text"] or "").encode()
            assert (r["size"], r["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))


def test_query_on_few_and_no_rows(spark, tmp_path):
    for n in (0, 3):
        spark.createDataFrame([(i, "x" * 50) for i in range(n)], "doc_id long, text string").write.parquet(
            str(tmp_path / f"{n}" / "documents.parquet"))
        got = op6_flow_resharding(spark, str(tmp_path / f"{n}")).collect()
        assert sorted(r["doc_id"] for r in got) == list(range(n))
