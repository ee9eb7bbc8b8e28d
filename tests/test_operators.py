"""Operators on hand-made rows: NULLs, ties, scopes, ever-paid, map fill, scaling."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from playmetrics.functions.labels import count_label, percent_label
from playmetrics.operators import (artist_by_state, artist_list, artists_over,
                                   artists_over_count, distinct_count, ever_paid_users,
                                   exclude_states, in_alaska_box, in_rectangle, in_scope, kpi_labels,
                                   kpis, listens_bounds, map_join_inline, map_prep, map_scale,
                                   monthly_listening, only_state, relabel_ever_paid, state_songs,
                                   states_list, subscription_breakdown, top_artist_at, top_artists,
                                   top_n, top_songs)
from playmetrics.sources import state_dim

T1 = dt.datetime(2024, 1, 31, 23, 0)
T2 = dt.datetime(2024, 2, 1, 1, 0)


def listens(spark, rows, schema):
    df = spark.createDataFrame(rows, schema)
    return (df.withColumn("year", F.year("ts")).withColumn("month", F.month("ts"))
            .withColumn("month_name", F.date_format("ts", "MMMM")))


@pytest.fixture()
def small(spark, listens_schema):
    rows = [
        ("1", "A", "s1", "CA", 100.0, "free", T1),
        ("1", "A", "s1", "CA", 100.0, "paid", T2),   # user 1 paid in February only
        ("2", "A", "s2", "NY", 60.0, "free", T1),    # user 2 never paid
        ("2", "B", "s2", "NY", 60.0, "free", T2),
        ("3", "B", "s3", "CA", 30.0, "paid", T1),
        (None, "B", "s3", "XX", 120.0, "paid", T1),  # NULL user with a paid row
        (None, None, "s4", "CA", 10.0, "free", T2),  # NULL user, NULL artist
        (None, None, "s4", "CA", 10.0, "free", T2),
        (None, None, "s4", "CA", 10.0, "free", T2),
        ("4", "C", "s5", "CA", 20.0, "free", T1),
    ]
    return listens(spark, rows, listens_schema)


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_scope(small):
    assert in_scope(small, None).count() == 10
    assert in_scope(small, "Nationwide").count() == 10
    assert in_scope(small, "CA").count() == 7
    assert in_scope(small, "TX").count() == 0


def test_null_artist_ranks(small):
    got = rows(top_artists(small, None, 2))
    assert got == [(None, 3), ("A", 3)]  # NULL group kept; tie by name, NULL first


def test_ties_broken_by_name(small):
    got = rows(top_songs(small, "free", None, 2))
    # free: s4 x3, s1 x1, s2 x2, s5 x1 -> top 2 = s4, s2; display order ascending
    assert got == [("s2", 2), ("s4", 3)]
    got = rows(top_songs(small, "free", "CA", 2))
    # CA free: s4 x3, s1 x1, s5 x1 -> tie at the boundary, s1 wins by name
    assert got == [("s1", 1), ("s4", 3)]


def test_artist_operators(small):
    assert rows(artist_by_state(small, "A")) == [("A", "CA", 2), ("A", "NY", 1)]
    assert rows(artist_by_state(small, "nobody")) == []
    assert rows(artists_over(small, 3)) == [(None, 3), ("A", 3), ("B", 3)]
    assert rows(artists_over_count(small, 3)) == [(3,)]
    assert rows(top_artist_at(small, 2, None, 10)) == [(2, "A", 3)]
    assert rows(artist_list(small, None, 50)) == [("A, B, C",)]  # listagg skips NULL
    assert rows(top_n(artist_by_state(small, "A"), 1, "listens", "state")) == [("A", "CA", 2)]
    assert rows(state_songs(small, "NY")) == [("NY", "s2", 2)]


def test_distinct_counts_and_states(small):
    assert rows(distinct_count(small, "userId")) == [(4,)]
    assert rows(distinct_count(small, "userId", include_null=True)) == [(5,)]
    assert rows(states_list(small)) == [("CA",), ("NY",), ("XX",)]


def test_kpis(small):
    (u, avg, paid), = rows(kpis(small))
    assert u == 5 and avg == pytest.approx(52.0) and paid == 250.0
    (u, avg, paid), = rows(kpis(small, "TX"))
    assert (u, avg, paid) == (0, None, None)


def test_kpi_labels_half_even(spark):
    df = spark.createDataFrame([(1500, 90.0, 9_000_000.0), (2500, 150.0, 1_800_000.0)],
                               "total_users long, avg_duration double, paid_duration double")
    got = rows(kpi_labels(df))
    exp = [(f"{round(u / 1000)}k+", f"{round(a / 60)} MIN", f"{round(p / 3600000)}k+ H")
           for u, a, p in [(1500, 90.0, 9_000_000.0), (2500, 150.0, 1_800_000.0)]]
    assert got == exp


def test_percent_label_matches_python(spark):
    vals = [0.35, 0.25, 0.45, 12.25, 80.05, 99.95, 100.0, 0.0, 33.333333333333336]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r[0] for r in df.select(percent_label(F.col("x"))).collect()]
    assert got == ["{:.1f}%".format(v) for v in vals]


def test_count_label_matches_python(spark):
    vals = [0.5, 1.5, 2.5, 1499.0, 2500.0, 3499.999]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r[0] for r in df.select(count_label(F.col("x"), 1000, "k+")).collect()]
    assert got == [f"{round(v / 1000)}k+" for v in vals]


def test_ever_paid(small):
    assert sorted(r[0] for r in ever_paid_users(small).collect()) == ["1", "3"]
    rel = relabel_ever_paid(small)
    assert rel.columns == small.columns
    subs = {(r.userId, r.ts, r.song): r.subscription for r in rel.collect()}
    assert subs[("1", T1, "s1")] == "paid"          # free month relabelled
    assert subs[("2", T1, "s2")] == "free"          # never paid
    assert all(v == "free" for (u, _, s), v in subs.items() if u is None and s == "s4")


def test_monthly_listening(small):
    got = rows(monthly_listening(small))
    assert got == [
        (2024, 1, "January", "free", (60.0 + 20.0) / 60),
        (2024, 1, "January", "paid", (100.0 + 30.0 + 120.0) / 60),
        (2024, 2, "February", "free", (60.0 + 30.0) / 60),
        (2024, 2, "February", "paid", 100.0 / 60),
    ]
    # State scope: the paid set stays national (user 1 is paid in January CA).
    got = rows(monthly_listening(small, "CA"))
    assert got == [
        (2024, 1, "January", "free", 20.0 / 60),
        (2024, 1, "January", "paid", 130.0 / 60),
        (2024, 2, "February", "free", 30.0 / 60),
        (2024, 2, "February", "paid", 100.0 / 60),
    ]


def test_subscription_breakdown(small):
    got = rows(subscription_breakdown(small))
    assert got == [("free", 7, 7 / 10 * 100), ("paid", 3, 3 / 10 * 100)]
    assert rows(subscription_breakdown(small, "TX")) == []


def test_map_prep_fills_every_state(spark, small):
    dim = state_dim(spark)
    got = {r.state: r for r in map_prep(artist_by_state(small, "A"), "A", dim).collect()}
    assert len(got) == 51
    assert got["CA"].listens == 2 and got["NY"].listens == 1 and got["TX"].listens == 0
    assert got["CA"].NAME == "California" and got["TX"].artist == "A"
    # unknown artist: every state, zero listens
    unk = map_prep(artist_by_state(small, "Z"), "Z", dim)
    assert unk.count() == 51 and unk.where("listens != 0 OR artist != 'Z'").count() == 0
    # states outside the dimension vanish
    xx = map_prep(artist_by_state(small, "B"), "B", dim)
    assert xx.where("state = 'XX'").count() == 0 and xx.count() == 51
    assert map_prep(artist_by_state(small, "A"), "A", state_dim(spark, True)).count() == 57


def test_map_join_inline(spark, small):
    got = map_join_inline(artist_by_state(small, "A"), state_dim(spark, True))
    assert got.columns == ["artist", "state_x", "listens", "state_y"]
    assert got.count() == 57 and got.where("artist IS NULL").count() == 55


def test_map_scale_and_bounds(spark, small):
    m = map_prep(artist_by_state(small, "A"), "A", state_dim(spark))
    assert rows(listens_bounds(m)) == [(0, 2)]
    s = {r.state: r.scaled for r in map_scale(m).collect()}
    assert s["CA"] == 1.0 and s["NY"] == 0.5 and s["TX"] == 0.0
    flat = map_prep(artist_by_state(small, "Z"), "Z", state_dim(spark))
    assert {r.scaled for r in map_scale(flat).collect()} == {0.0}


def test_map_filters(spark, small):
    m = map_prep(artist_by_state(small, "A"), "A", state_dim(spark))
    assert exclude_states(m).count() == 49
    assert rows(only_state(m, "CA").select("listens")) == [(2,)]


def test_rectangles(spark):
    pts = spark.createDataFrame([(-150.0, 60.0), (-157.8, 21.3), (-100.0, 40.0), (None, 60.0)],
                                "lon double, lat double")
    assert rows(in_alaska_box(pts)) == [(-150.0, 60.0)]
    assert rows(in_rectangle(pts, (-160, -120), (0, 90))) == [(-150.0, 60.0), (-157.8, 21.3)]


def test_attach_boundaries_keeps_every_boundary(spark, small):
    from playmetrics.operators import attach_boundaries, complete_rows
    b = spark.createDataFrame([("California", "CA", "POINT (0 0)"), ("Texas", "TX", "POINT (1 1)"),
                               ("Atlantis", "AT", "POINT (2 2)")],
                              "NAME string, STUSPS string, geometry string")
    m = map_prep(artist_by_state(small, "A"), "A", state_dim(spark))
    got = {r.NAME: r for r in attach_boundaries(b, m).collect()}
    assert len(got) == 3 and got["California"].listens == 2 and got["Texas"].listens == 0
    assert got["Atlantis"].listens is None and got["Atlantis"].artist is None
    inline = map_join_inline(artist_by_state(small, "A"), state_dim(spark))
    joined = attach_boundaries(b, inline, right_on="state_y")
    assert joined.count() == 3
    assert [r.NAME for r in complete_rows(joined).collect()] == ["California"]


def test_artist_list_separator_is_literal(small):
    for sep in [" | ", "', '", "\\n"]:
        assert rows(artist_list(small, None, 50, sep)) == [(sep.join(["A", "B", "C"]),)]


def test_edges_under_default_ansi_mode(spark, listens_schema):
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"
    df = spark.createDataFrame([("a", 5), ("b", 5), ("c", None)], "state string, listens long")
    assert sorted(rows(map_scale(df)), key=str) == [("a", 5, 0.0), ("b", 5, 0.0), ("c", None, None)]
    no_time = spark.createDataFrame(
        [("1", "CA", 60.0, "free", None, None, None)],
        "userId string, state string, duration double, subscription string, year int, "
        "month int, month_name string")
    assert rows(monthly_listening(no_time)) == [(None, None, None, "free", 1.0)]
    empty = no_time.where("false")
    assert rows(kpis(empty)) == [(0, None, None)]
    assert rows(kpi_labels(kpis(empty))) == [("0k+", None, None)]
    assert rows(subscription_breakdown(empty)) == [] and rows(monthly_listening(empty)) == []
