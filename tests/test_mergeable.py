"""Bitmaps of users, pruned top-N, Bloom filter: equal to the direct operators, on odd rows too."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from playmetrics.operators import (
    bloom_words, pruned_share, relabel_ever_paid, relabel_ever_paid_filtered, rows_to_join,
    top_artists, top_artists_pruned, top_pruned, with_membership,
)
from playmetrics.plans import (
    kpis_all_scopes, kpis_all_scopes_from_bitmaps, listen_sums, number_values, user_bitmaps, users_by,
)

SCHEMA = ("userId string, artist string, state string, duration double, subscription string, "
          "year int, month int")
ROWS = [
    ("u1", "A", "CA", 10.0, "free", 2024, 1), ("u1", "A", "CA", 20.0, "paid", 2024, 2),
    ("u2", "B", "NY", None, "free", 2024, 1), ("u2", "B", None, 5.0, "free", 2023, 12),
    (None, "B", "CA", 2.5, "paid", 2024, 1), (None, None, "TX", 1.0, "free", 2024, 2),
    ("u3", "C", "CA", 4.0, "free", None, None), ("u1", "A", "CA", 10.0, "free", 2024, 1),
    ("u4", "A", "NY", 7.0, None, 2024, 1), ("u1", "C", "NY", 1.0, None, 2024, 1),
]


@pytest.fixture()
def listens(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def many(spark, n=70_000):
    """More users than one bitmap holds; a third of the rows are one user's."""
    return spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit(-7)).otherwise(F.col("id")).alias("userId"),
        F.when(F.col("id") % 2 == 0, "CA").otherwise("NY").alias("state"),
        F.lit(2024).alias("year"), (F.col("id") % 12 + 1).cast("int").alias("month"),
        F.lit(0.5).alias("duration"), F.lit("free").alias("subscription"))


# ------------------------------------------------------------------ bitmaps

def test_numbers_are_dense_and_grow(spark, listens):
    first = number_values(listens.where("userId in ('u2', 'u4')"))
    assert {r["userId"]: r["number"] for r in first.collect()} == {"u2": 1, "u4": 2}
    grown = {r["userId"]: r["number"] for r in number_values(listens, known=first).collect()}
    assert grown == {"u2": 1, "u4": 2, "u1": 3, "u3": 4}
    again = number_values(listens, known=number_values(listens, known=first))
    assert {r["userId"]: r["number"] for r in again.collect()} == grown
    assert number_values(listens.where("false")).collect() == []


def test_numbers_have_no_gap_over_many_partitions(spark):
    rows = number_values(many(spark)).agg(F.min("number"), F.max("number"), F.countDistinct("number"),
                                          F.count("*")).first()
    users = many(spark).select("userId").distinct().count()
    assert tuple(rows) == (1, users, users, users)


def test_kpis_equal_the_direct_ones(spark, listens):
    for df in (listens, listens.where("userId IS NULL"), many(spark)):
        got = kpis_all_scopes_from_bitmaps(user_bitmaps(df, number_values(df)), listen_sums(df))
        assert sorted(map(str, got.collect())) == sorted(map(str, kpis_all_scopes(df).collect()))
    none = listens.where("false")
    got = kpis_all_scopes_from_bitmaps(user_bitmaps(none, number_values(none)), listen_sums(none))
    assert got.collect() == kpis_all_scopes(none).collect() == []


def test_any_scope_is_an_or(spark, listens):
    bits = user_bitmaps(listens, number_values(listens))

    def count(where, **how):
        return users_by(bits.where(where), **how).first()[0]

    assert count("true") == 5 and count("true", include_null=False) == 4
    assert count("state = 'CA'") == 3 and count("state = 'CA'", include_null=False) == 2
    assert count("state IN ('CA', 'NY') AND year = 2024 AND month = 1") == 4
    assert count("year IS NULL") == 1 and count("state IS NULL") == 1
    assert count("state = 'ZZ'") == 0 and count("state = 'TX'", include_null=False) == 0
    by = {r["state"]: r["n_users"] for r in users_by(bits, ("state",), include_null=False).collect()}
    assert by == {"CA": 2, "NY": 3, None: 1, "TX": 0}


def test_new_months_are_appended(spark, listens):
    old, new = listens.where("year = 2023"), listens.where("year IS NULL OR year = 2024")
    numbers = number_values(old)
    bits, sums = user_bitmaps(old, numbers), listen_sums(old)
    numbers = number_values(new, known=numbers)
    bits, sums = bits.unionByName(user_bitmaps(new, numbers)), sums.unionByName(listen_sums(new))
    got = kpis_all_scopes_from_bitmaps(bits, sums).collect()
    assert sorted(map(str, got)) == sorted(map(str, kpis_all_scopes(listens).collect()))


def test_an_id_without_number_is_an_error(spark, listens):
    with pytest.raises(Exception, match="no number for id u3"):
        user_bitmaps(listens, number_values(listens.where("userId <> 'u3'"))).collect()


def test_bitmaps_read_no_events(spark):
    bits = user_bitmaps(many(spark), number_values(many(spark)))
    assert bits.agg(F.max(F.octet_length("bits"))).first()[0] == 4096
    cells = bits.groupBy("state", "month").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    assert cells <= 46_667 // 32_768 + 1  # a row a bucket, however hot a user


# ------------------------------------------------------------------ pruned top-N

def names(spark, counts, extra=0):
    rows = [(k,) for k, n in counts.items() for _ in range(n)] + [(f"rare{i}",) for i in range(extra)]
    return spark.createDataFrame(rows, "artist string").withColumn("state", F.lit("CA"))


@pytest.mark.parametrize("buckets, first", [(1 << 16, None), (64, 2), (8, 1), (1, 1)])
def test_pruned_equals_direct(spark, buckets, first):
    counts = {f"name{i}": 40 - i // 3 for i in range(60)} | {None: 33}  # ties at every bar
    df = names(spark, counts, extra=300).repartition(5)
    for n in (1, 10, 50, 1000):
        want = [tuple(r) for r in top_artists(df, None, n).collect()]
        assert [tuple(r) for r in top_artists_pruned(df, None, n, buckets=buckets, first=first).collect()] == want
    assert top_artists_pruned(df, "NY", 5, buckets=buckets, first=first).collect() == []


def test_pruned_by_weight(spark):
    df = spark.range(500).selectExpr("concat('n', id % 50) AS song", "id % 50 AS plays")
    want = sorted(Counter({f"n{i}": 10 * i for i in range(50)}).items(), key=lambda x: (-x[1], x[0]))[:7]
    got = top_pruned(df, "song", 7, weight="plays", buckets=32, first=3).collect()
    assert [tuple(r) for r in got] == want


def test_rare_names_are_never_counted(spark):
    df = names(spark, {f"hit{i}": 200 for i in range(10)}, extra=3000)
    share = pruned_share(df, "artist", 10, first=16).first()
    assert share["rows"] == 5000 and share["left_out"] > 2900
    flat = names(spark, {}, extra=3000)  # nothing separates: all are counted
    assert tuple(pruned_share(flat, "artist", 10, first=16).first()) == (3000, 0)


# ------------------------------------------------------------------ Bloom filter

def test_filter_never_misses_and_seldom_errs(spark):
    df = spark.range(40_000).select(F.col("id").cast("string").alias("v"))
    in_set = df.where("cast(v as int) < 10000")
    words = 1 << 12  # 26 bits a value
    tested = with_membership(df.unionByName(spark.createDataFrame([(None,)], "v string")),
                             bloom_words(in_set, "v", words), "v", "hit", words)
    rows = tested.groupBy(F.col("v").cast("int") < 10_000, "hit").count().collect()
    by = {(r[0], r["hit"]): r["count"] for r in rows}
    assert by[True, True] == 10_000 and (True, False) not in by
    assert by.get((False, True), 0) < 0.03 * 30_000 and by[None, False] == 1
    assert bloom_words(df, "v", 64).count() <= 64
    empty = with_membership(df, bloom_words(df.where("false"), "v", words), "v", "hit", words)
    assert empty.where("hit").count() == 0


@pytest.mark.parametrize("words", [1, 1 << 12])
@pytest.mark.parametrize("hot", [1, 100_000])
def test_filtered_relabel_equals_the_direct_one(spark, listens, words, hot):
    df = listens.withColumn("word", F.lit(1)).withColumn("mask", F.lit(2))  # clashing names
    want = sorted(map(str, relabel_ever_paid(df).collect()))
    got = relabel_ever_paid_filtered(df, max_hot_users=hot, words=words)
    assert got.columns == df.columns and sorted(map(str, got.collect())) == want
    assert relabel_ever_paid_filtered(df.where("false")).collect() == []


def test_share_of_rows_not_moved(spark):
    df = many(spark).withColumn(
        "subscription", F.when(F.col("userId") % 10 == 1, "paid").otherwise("free"))
    share = rows_to_join(df).first()
    assert share["rows"] == 70_000 and share["joined"] < 3_000  # the hot user never paid
    plan = relabel_ever_paid_filtered(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
