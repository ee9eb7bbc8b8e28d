import itertools
import zlib

import numpy as np
import pytest

from playmetrics.llm import quality_rff as q
from playmetrics.llm.queries import op7_rff_quality


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    scored = op7_rff_quality(spark, d)
    rows = scored.join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.97
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 and 0 <= r["score"] <= 1 for r in rows)
    assert scored.count() == spark.read.parquet(f"{d}/documents.parquet").count()


def test_random_features_approximate_the_kernel():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(20, 4))
    z = q.Model(np.zeros(4), np.ones(4), 8000, 2.0, 1).features(x)[:, :-1]
    kernel = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / (2 * 2.0 ** 2))
    assert np.abs(z @ z.T - kernel).max() < 0.06


def test_isotonic_against_brute_force():
    x, y, w = [0, 1, 2, 3, 4], np.array([0.0, 1.0, 0.0, 0.5, 1.0]), np.array([1, 1, 3, 2, 1])
    at, value = q.isotonic(x, y, w)
    grid = np.linspace(0, 1, 21)  # the best ascending values of all on a grid that holds them
    best = min(((w * (np.array(v) - y) ** 2).sum(), v) for v in itertools.combinations_with_replacement(grid, 5))
    assert np.allclose(np.repeat(value, [1, 2, 1, 1]), best[1])
    assert np.allclose(at, [0, 1.75, 3, 4])


def test_partition_sums_equal_one_sum(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    described = q.describe(docs, "doc_id", "text")
    a = q.fit(described, labels, features=16, partitions=1)
    b = q.fit(described, labels, features=16, partitions=5)
    assert np.allclose(a.weights, b.weights)


def test_odd_rows(spark):
    docs = spark.createDataFrame(
        [(None, "x y"), (1, None), (1, None), (2, ""), (3, "y " * 50_000)], "doc_id long, text string"
    ).selectExpr("*", "1 AS x", "2 AS score", "'f' AS fold")
    labels = spark.createDataFrame([(1, 1), (1, None), (3, 0), (None, 1)], "doc_id long, quality int")
    assert q.score_documents(docs, labels).count() == 5
    assert q.score_documents(docs.where("false"), labels).count() == 0
    none = q.score_documents(docs, labels.where("false")).collect()
    assert [r["score"] for r in none] == [0.5] * 5
    kept = q.keep_good(docs, labels, least=0.0)
    assert kept.columns == docs.columns and kept.count() == 5


def test_empty_text_statistics():
    assert len(q.statistics(b"")) == q.N_STATS == len(q.statistics(b"Some text, 12.\n"))
    assert np.isfinite(q.statistics(b" \n")).all()
