import re

import numpy as np
import pytest
import xxhash

from playmetrics.llm import simhash_pivots as sp
from playmetrics.llm.queries import op9_simhash_pivots


def brute_fp(text, width=3):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps, limit=2):
    label = list(range(len(fps)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= limit:
                label[max(root(i), root(j))] = min(root(i), root(j))
    return [root(x) for x in range(len(fps))]


def test_query_against_brute_force(spark):
    d = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in op9_simhash_pivots(spark, d).collect()}
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").collect())
    fps = [brute_fp(t) for _, t in docs]
    assert len(got) == len(docs)
    for (doc, _), fp, c in zip(docs, fps, brute_components(fps)):
        assert got[doc]["fingerprint"] == f"{fp:016x}"
        assert got[doc]["component_id"] == docs[c][0]


@pytest.mark.parametrize("small, max_bucket", [(1, 4), (16, 1), (16, 2), (16, 20_000)])
def test_links_of_dense_fingerprints(spark, monkeypatch, small, max_bucket):
    """A ball of near fingerprints and random ones; small buckets force dealing again."""
    monkeypatch.setattr(sp, "SMALL", small)
    rng = np.random.default_rng(1)
    fps = {int(x) for x in rng.integers(0, 1 << 63, 40)}
    centre = 0x0123456789abcdef
    for _ in range(150):
        x = centre
        for b in rng.integers(0, 64, rng.integers(0, 9)):
            x ^= 1 << int(b)
        fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(sp.signed(x),) for x in fps], "fp long")
    edges = sp.links(df, 2, max_bucket)
    for r in edges.collect():
        assert ((r["a"] ^ r["b"]) & (2 ** 64 - 1)).bit_count() <= 2
    label = {r["node"]: r["label"] for r in sp.connected(edges).collect()}
    groups = {}
    for x in fps:
        groups.setdefault(label.get(sp.signed(x), sp.signed(x)), set()).add(x)
    want = {}
    for x, c in zip(fps, brute_components(fps)):
        want.setdefault(c, set()).add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_connected_long_path(spark):
    nodes = np.random.default_rng(5).permutation(60).tolist()
    edges = spark.createDataFrame([(a, b) for a, b in zip(nodes, nodes[1:])], "a long, b long")
    assert {r["label"] for r in sp.connected(edges).collect()} == {0}


def test_odd_rows(spark):
    rows = [(5, None), (4, ""), (None, " \n"), (3, "one two"), (3, "one two"), (None, "x y z w v"), (None, "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "7 AS fp", "8 AS n")
    got = sp.components(df).collect()
    assert sorted(r["component"] or -1 for r in got) == [-1, -1, 3, 3, 4, 4, 4]
    kept = sp.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["3", "4", "None", "None"]
    assert sp.components(df.where("false")).count() == 0
    assert sp.drop_near_duplicates(df.where("false")).count() == 0


def test_finished_buckets_keep_their_links(spark, monkeypatch):
    """Buckets that are too large but have no bits left to deal by stay where they are."""
    monkeypatch.setattr(sp, "SMALL", 1)
    far = 1 << 62 | 1 << 50 | 1 << 40
    fps = [0b0, 0b1, 0b10, 0b11, far, far | 1 << 30]
    df = spark.createDataFrame([(sp.signed(x),) for x in fps], "fp long")
    edges = sp.links(df, 1, 1)
    label = {r["node"]: r["label"] for r in sp.connected(edges).collect()}
    assert len({label[sp.signed(x)] for x in fps[:4]}) == 1 and label[0] != label[far] == label[far | 1 << 30]
