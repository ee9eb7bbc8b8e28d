import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from playmetrics.llm import embedding_whitening as ew, symmetric_eigen as se, vectors as vec
from playmetrics.llm.queries import op12_whitening

RNG = np.random.default_rng(5)


def spectrum(*values):
    q, _ = np.linalg.qr(RNG.normal(size=(len(values), len(values))))
    return q @ np.diag(values) @ q.T


WILKINSON = np.diag(abs(np.arange(21) - 10.0)) + np.diag(np.ones(20), 1) + np.diag(np.ones(20), -1)
MATRICES = {
    "one": np.array([[3.0]]), "two": np.array([[2.0, 1], [1, 2]]),
    "covariance": np.cov(RNG.normal(size=(64, 400))), "repeated": spectrum(*[3] * 5, *[2] * 10, *[1] * 9),
    "identity": np.eye(20), "zero": np.zeros((5, 5)), "diagonal": np.diag([5, 5, 3, 3, 1.0]),
    "blocks": np.kron(np.eye(4), np.array([[2, 1], [1, 2.0]])), "graded": spectrum(*10.0 ** -np.arange(30)),
    "close": WILKINSON, "small": 1e-200 * WILKINSON, "large": 1e150 * WILKINSON,
    "rank one": np.outer(np.arange(9.0), np.arange(9.0)),
}


@pytest.mark.parametrize("name", MATRICES)
def test_leading_pairs(name):
    a = MATRICES[name]
    values, rows = se.leading(a, 16)
    want = np.linalg.eigvalsh(a)[::-1][:16]
    norm = max(abs(want).max(), 1e-300)
    assert len(values) == min(16, len(a))
    assert abs(values - want).max() <= 1e-14 * norm
    assert abs(a @ rows.T - rows.T * values).max() <= 1e-13 * norm
    assert abs(rows @ rows.T - np.eye(len(rows))).max() <= 1e-13


def test_tridiagonal_keeps_the_spectrum_and_counts_are_right():
    a = MATRICES["covariance"]
    d, e, reflectors = se.tridiagonal(a)
    t = np.diag(d) + np.diag(e, 1) + np.diag(e, -1)
    w = np.linalg.eigvalsh(a)
    assert np.allclose(np.linalg.eigvalsh(t), w)
    z = RNG.normal(size=64)
    assert np.allclose(a @ se.back(reflectors, z), se.back(reflectors, t @ z))
    at = np.concatenate([w[:-1] + np.diff(w) / 2, [w[0] - 1, w[-1] + 1]])
    assert se.counts_below(d, e, at).tolist() == [*range(1, 64), 0, 64]


def brute(rows, scale=64, keep=16):
    """Contract word by word: exact sums in fractions, numpy's own eigenvalues."""
    x = {k: tuple(math.floor(scale * float(c)) + 1_000_000 for c in v) for k, v in rows}
    fit = sorted(set(x.values()))
    n, s = len(fit), [sum(c) for c in zip(*fit)]
    mean = [Fraction(v, n) for v in s]
    centred = [[c - m for c, m in zip(v, mean)] for v in fit]
    cov = np.array([[float(sum(v[i] * v[j] for v in centred) / n) for j in range(len(s))]
                    for i in range(len(s))])
    values, q = np.linalg.eigh(cov)
    values, q = values[::-1][:keep], q[:, ::-1][:, :keep]
    return {k: (n, sum((n * c - t) ** 2 for c, t in zip(v, s)),
                np.array([float(c - m) for c, m in zip(v, mean)]) @ q / np.sqrt(values),
                values / np.trace(cov)) for k, v in x.items()}


def test_query_against_brute_force(spark):
    d = "/root/testdata/sf0.01"
    rows = op12_whitening(spark, d).collect()
    table = spark.read.parquet(f"{d}/embeddings.parquet").collect()
    want = brute([(r["vec_id"], r["embedding"]) for r in table])
    got = {}
    for r in rows:
        got.setdefault(r["vec_id"], {})[r["component"]] = r
    assert got.keys() == want.keys() and all(sorted(g) == list(range(1, 17)) for g in got.values())
    flip = {}
    for k, (n, deviation, whitened, explained) in want.items():
        for c in range(16):
            r = got[k][c + 1]
            assert (r["n"], r["deviation"]) == (n, deviation)
            assert math.isclose(r["explained"], explained[c], rel_tol=1e-10)
            if abs(whitened[c]) > 1e-6:
                assert flip.setdefault(c, r["whitened"] * whitened[c] > 0) == (r["whitened"] * whitened[c] > 0)
            assert math.isclose(abs(r["whitened"]), abs(whitened[c]), rel_tol=1e-8, abs_tol=1e-9)
    assert {r["identity_error"] for r in rows} == {rows[0]["identity_error"]}
    assert rows[0]["identity_error"] < 1e-10


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr(
        "*", "1 AS n", "2 AS x", "'c' AS component", "3 AS id", "4 AS deviation")


def test_odd_rows_and_a_common_vector(spark):
    rows = [(i, [float(v) for v in RNG.normal(size=3)], 1) for i in range(40)]
    rows += [(100 + i, [0.25, -0.5, 1.0], 0) for i in range(30)] + [rows[0], (None, [0.5, 0.25, 0.125], None)]
    bad = [(900, None, 1), (901, [1.0, None, 2.0], 1), (902, [1.0, float("nan"), 2.0], 1),
           (903, [1.0, float("inf"), 2.0], 1)]
    short = [(950, [0.75], 1), (951, [], 1)]
    got = ew.whiten(frame(spark, rows + bad + short).repartition(5)).collect()
    padded = [(k, [*np.float32(v).tolist(), 0.0, 0.0, 0.0][:3]) for k, v, _ in rows + short]
    want = brute(padded)
    assert len(got) == 3 * len(padded)
    assert {r["vec_id"] for r in got} == {k for k, _ in padded}
    for r in got:
        n, deviation, whitened, _ = want[r["vec_id"]]
        assert (r["n"], r["deviation"]) == (n, deviation)
        assert math.isclose(abs(r["whitened"]), abs(whitened[r["component"] - 1]), rel_tol=1e-7, abs_tol=1e-9)


def test_no_rows_and_no_variance(spark):
    assert ew.whiten(frame(spark, [])).collect() == []
    assert ew.whiten(frame(spark, [(1, None, 1)])).collect() == []
    assert ew.whiten(frame(spark, [(1, [], 1)])).collect() == []
    assert ew.whiten(frame(spark, [(1, [1.0, 2.0], 1)] * 3)).collect() == []
    flat = ew.whiten(frame(spark, [(1, [1.0, 2.0], 1), (2, [3.0, 2.0], 1)])).collect()
    assert {(r["component"], r["explained"], abs(r["whitened"])) for r in flat} == {(1, 1.0, 1.0)}


def test_large_numbers_stay_exact(spark):
    rows = [(i, [float(2 ** 28 + 3 * i), float(i * i)], 1) for i in range(12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    want = brute([(k, v) for k, v, _ in rows])
    for r in ew.whiten(df).collect():
        assert r["deviation"] == want[r["vec_id"]][1]
    model = ew.fit(df, "embedding", 2)
    centre = np.array([2 ** 34, 700])
    assert model.sums.tolist() == [sum(int(64 * v[c]) for _, v, _ in rows) for c in (0, 1)]
    x = np.array([[2 ** 40, -5], [2 ** 34, 7]], np.int64)
    (batch,) = [b for b in ew._products(centre)(iter([
        pa.RecordBatch.from_arrays([pa.array(vec.packed(x))], ["x"])]))][:1]
    assert int(batch.column(2)[0].as_py()) == (2 ** 40 - 2 ** 34) ** 2
    with pytest.raises(Exception, match="does not fit a long"):
        ew.whiten(spark.createDataFrame([(1, [1e300], 1)], df.schema)).collect()


def test_packed_round_trip():
    x = np.array([[1, -128], [127, 0], [128, -1], [-32768, 5], [2 ** 31, 0], [-2 ** 62, 3], [0, 0]])
    values = vec.packed(x)
    assert [v[0] for v in values] == [2, 1, 2, 4, 8, 8, 1]
    assert (vec.unpacked(values, 2) == x).all()
    assert vec.packed(x[:0]) == [] and vec.unpacked([], 2).shape == (0, 2)


def test_partitioning_changes_nothing(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    a, b = (ew.fit(table.repartition(k), "embedding", 64) for k in (1, 6))
    assert (a.covariance == b.covariance).all() and (a.components == b.components).all()
