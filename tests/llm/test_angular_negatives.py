import numpy as np
import pytest
from pyspark.sql import functions as F

from playmetrics.llm import angular_negatives as an
from playmetrics.llm.queries import op11_angular_negatives

RNG = np.random.default_rng(11)
COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def brute(rows, anchor, scale=256, low=50, high=95, positives=5, negatives=3):
    """The contract over all pairs, in Python integers."""
    x = [(i, label, [int(np.floor(scale * float(c))) for c in v]) for i, v, label in rows]
    out = []
    for i, label, v in x:
        if not anchor(i):
            continue
        scores = [(-sum(a * b for a, b in zip(v, w)), j, own) for j, own, w in x if j != i]
        near = sorted((s, j) for s, j, own in scores if own == label)[:positives]
        for s, p in near:
            fits = sorted((t, j) for t, j, own in scores
                          if own != label and low * -s <= 100 * -t <= high * -s)[:negatives]
            out += [(i, p, k + 1, j, -s, -t) for k, (t, j) in enumerate(fits)]
    return sorted(out)


def frame(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int").selectExpr(
        "*", "1 AS id", "'k' AS key", "2 AS score", "3 AS pos", "4 AS n", "5 AS vector")


def mined(df, anchor=None, **how):
    anchor = F.col("vec_id") % 5 == 0 if anchor is None else anchor
    return sorted(tuple(r[c] for c in COLUMNS) for r in an.mine(df, anchor, **how).collect())


def clustered(n, dims, centres, spread, labels):
    at = RNG.normal(size=(centres, dims))
    return [(i, (at[i % centres] + spread * RNG.normal(size=dims)).astype(np.float32).tolist(),
             int(RNG.integers(labels))) for i in range(n)]


def test_query_against_brute_force(spark):
    d = "/root/testdata/sf0.01"
    rows = [(r["vec_id"], r["embedding"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"])
            for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    got = sorted(tuple(r[c] for c in COLUMNS) for r in op11_angular_negatives(spark, d).collect())
    assert got == brute(rows, lambda i: i % 50 == 0)


@pytest.mark.parametrize("block, chunk, cell", [(2, 7, 1), (64, 2048, 64 << 20)])
def test_clustered_rows_in_any_grid(spark, monkeypatch, block, chunk, cell):
    monkeypatch.setattr(an, "BLOCK", block)
    monkeypatch.setattr(an, "CHUNK", chunk)
    monkeypatch.setattr(an, "CELL", cell)  # 1: a cell for each block and chunk
    rows = clustered(120, 6, 3, 0.4, 3)
    assert mined(frame(spark, rows).repartition(3)) == brute(rows, lambda i: i % 5 == 0)


def test_ties_copies_nulls_and_zeros(spark):
    rows = clustered(40, 3, 2, 0.5, 2)
    rows += [(100 + i, [0.5, 0.25, 0.0], i % 2) for i in range(30)]  # one vector, both labels
    rows += [(200, [0.0, 0.0, 0.0], 0), (205, [0.0, 0.0, 0.0], 1), (210, [-0.5, -0.25, 0.0], 1), rows[3]]
    bad = [(300, None, 1), (305, [1.0, None, 2.0], 1), (310, [1.0, float("nan"), 2.0], 1),
           (315, [float("inf"), 0.0, 0.0], 1), (320, [1.0, 1.0, 1.0], None), (None, [0.5, 0.25, 0.0], 0)]
    short = [(400, [0.5], 0), (405, [], 1)]
    padded = [(i, [*v, 0.0, 0.0, 0.0][:3], label) for i, v, label in rows + short]
    assert mined(frame(spark, rows + bad + short)) == brute(padded, lambda i: i % 5 == 0)


def test_no_result(spark):
    rows = clustered(10, 3, 2, 0.5, 1)
    assert mined(frame(spark, [])) == []
    assert mined(frame(spark, rows), F.lit(False)) == []
    assert mined(frame(spark, rows)) == []  # one label
    assert mined(frame(spark, [(5, [], 1), (6, [], 2)])) == []
    assert an.mine(frame(spark, []), F.lit(True)).columns == COLUMNS


@pytest.mark.parametrize("size", [1.0, 3000.0, 2.0 ** 22])
def test_large_components_stay_exact(spark, size):
    rows = [(i, (size * RNG.normal(size=4)).tolist(), i % 3) for i in range(50)]
    assert mined(frame(spark, rows, "double")) == brute(rows, lambda i: i % 5 == 0)


def test_bounds_hold_and_skip_far_pairs():
    """On clustered rows most pairs are never scored; no score leaves its bounds."""
    rows = clustered(1200, 16, 6, 0.02, 2)
    x = np.array([[int(np.floor(256 * c)) for c in v] for _, v, _ in rows])
    x[7], x[8], x[9], x[10] = x[6], -x[6], 3 * x[6], 0
    references = x[[0, 1, 2, 3]] / np.linalg.norm(x[[0, 1, 2, 3]], axis=1)[:, None]
    ids, labels = np.arange(1200), np.array([r[2] for r in rows])
    everything = an.Rows(ids, labels, x, references)
    low, high = an.score_bounds(everything, everything, 16)
    scores = x @ x.T
    assert (low <= scores).all() and (scores <= high).all()
    anchors, tally = everything.part(ids[::50]), [0, 0]
    chunks = [everything.part(slice(k, k + 200)) for k in range(0, 1200, 200)]
    an._positives(anchors, chunks, 16, 5, tally)
    assert tally[1] < 0.25 * tally[0]


def test_scores_one_by_one_equal_a_product():
    x = RNG.integers(-300, 300, (50, 8))
    rows = an.Rows(np.arange(50), np.zeros(50, np.int64), x, np.eye(8))
    for share in (0.01, 0.9):
        left = RNG.random((50, 50)) < share
        i, j, s = an.scored(rows, rows, left)
        assert (s == (x @ x.T)[left]).all() and (np.stack([i, j]) == np.stack(np.nonzero(left))).all()
    with pytest.raises(OverflowError):
        an.exact_scores(np.array([[2 ** 40]]), np.array([[2 ** 40]]), 2.0 ** 80)
