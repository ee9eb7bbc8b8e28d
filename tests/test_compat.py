"""The original API names on top of the operators."""

import datetime as dt

from playmetrics import compat
from playmetrics.operators import artist_by_state, map_prep, null_audit
from playmetrics.sources import state_dim

T = dt.datetime(2024, 3, 1)


def test_compat_names(spark, listens_schema):
    rows = [("1", "A", "s1", "CA", 10.0, "paid", T), ("2", "A", "s2", "NY", 20.0, "free", T),
            ("2", "B", "s2", "NY", 20.0, "free", T)]
    df = spark.createDataFrame(rows, listens_schema)
    assert [r[0] for r in compat.get_artist_over(df, 2).collect()] == ["A"]
    assert [r[0] for r in compat.get_top_50(df, "Nationwide").collect()] == ["A", "B"]
    assert compat.get_top_10_artists(df, "NY").columns == ["Artist", "Total Streams"]
    assert compat.create_subscription_pie_chart(df, "Nationwide").columns == [
        "subscription", "count"]
    counts = compat.get_artist_state_listen(df, "A")
    a = sorted(tuple(r) for r in compat.map_prep_df(counts).collect())
    b = sorted(tuple(r) for r in map_prep(artist_by_state(df, "A"), "A", state_dim(spark))
               .collect())
    assert a == b and len(a) == 51
    assert [tuple(r) for r in compat.top_5(counts).collect()] == [("A", "CA", 1), ("A", "NY", 1)]
    assert compat.calculate_kpis(df).collect()[0].total_users == 2


def test_null_audit(spark):
    df = spark.createDataFrame([(None, "free"), ("1", None), ("2", "paid"), (None, None)],
                               "userId string, level string")
    assert tuple(null_audit(df).collect()[0]) == (2, 2, 1)


def test_load_data(spark, tmp_path):
    d = tmp_path / "listen"
    d.mkdir()
    (d / "a.json").write_text('{"userId": 1, "artist": "A", "level": "free", "ts": 0}\n')
    df = compat.clean(compat.load_data(spark, str(d)))
    assert [r.artist for r in df.collect()] == ["A"] and "subscription" in df.columns


def test_every_compat_function_runs(spark):
    from pyspark.sql import functions as F

    from conftest import SF_SMALL
    from playmetrics.sources import testview as tv

    L = tv.listens(spark, SF_SMALL)
    state = L.select("state").first()[0]
    artist = L.select("artist").first()[0]
    counts = compat.get_artist_state(L, artist)
    dim = tv.nation_dim(spark, SF_SMALL, with_regions=True)
    mapped = compat.map_prep_df(counts, dim)
    assert mapped.count() == dim.count()
    assert compat.make_map_df(mapped, tv.nation_boundaries(spark, SF_SMALL)).count() == dim.count()
    assert compat.get_artist_over_1000(L, 1).count() == L.select("artist").distinct().count()
    assert compat.get_arist_over_1000(L, 10**9).count() == 0
    assert compat.get_top_100(L, state).count() <= 50
    assert compat.get_user_list(L, state).count() > 0
    assert compat.get_states_list(L).count() == L.select("state").distinct().count()
    assert compat.top_free_songs(L, "Nationwide").count() == 5
    assert compat.top_paid_songs(L, state).count() <= 5
    fixed = spark.createDataFrame([("BeyoncÃ©",)], "t string").select(
        compat.fix_multiple_encoding(F.col("t"))).first()[0]
    assert fixed == "Beyonc�"  # the legacy rule on single damage
