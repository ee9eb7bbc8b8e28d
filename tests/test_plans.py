"""Plan shapes that matter at scale, and C1 materialization / all-scope tables."""

import os
import sys
import pytest
from pyspark.sql import functions as F

from playmetrics.operators import (kpis, monthly_listening, subscription_breakdown,
                                   top_artists, top_songs)
from playmetrics.plans import (checkpoint_dir, kpis_all_scopes, materialize,
                               monthly_listening_all_scopes, reliable_checkpoint,
                               subscription_breakdown_all_scopes, top_artists_all_scopes,
                               top_songs_all_scopes)
from playmetrics.sources import testview as tv

from conftest import SF_SMALL


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def L(spark):
    return tv.listens(spark, SF_SMALL)


def test_top_n_is_take_ordered(L):
    p = plan(top_artists(L, None, 10))
    assert "TakeOrderedAndProject" in p and "rangepartitioning" not in p


def test_all_scope_top_n_limits_before_shuffle(L):
    p = plan(top_artists_all_scopes(L, 10))
    assert "WindowGroupLimit" in p and "Partial" in p


def test_kpis_one_job_no_python(L):
    p = plan(kpis(L))
    assert "PythonUDF" not in p and "BatchEvalPython" not in p
    assert p.count("HashAggregate") >= 3  # partial de-dup by userId before the shuffle


def test_monthly_never_joins_raw_rows_on_user(L):
    p = plan(monthly_listening(L, "NATION_7"))
    assert "Window" in p
    # the only join work is the test view's own; ever-paid adds none
    assert p.count("Join") == plan(L).count("Join")


def test_rollups_equal_per_scope(spark, L):
    top = top_artists_all_scopes(L, 10)
    for scope in ["Nationwide", "NATION_7", "NATION_0"]:
        a = [tuple(r) for r in top.where(F.col("scope") == scope).orderBy("rank")
             .select("artist", "listens").collect()]
        b = [tuple(r) for r in top_artists(L, scope, 10).collect()]
        assert a == b
    songs = top_songs_all_scopes(L, "free", 5)
    for scope in ["Nationwide", "NATION_3"]:
        a = sorted(tuple(r) for r in songs.where(F.col("scope") == scope)
                   .select("song", "listens").collect())
        assert a == sorted(tuple(r) for r in top_songs(L, "free", scope, 5).collect())
    br = subscription_breakdown_all_scopes(L)
    a = sorted(tuple(r) for r in br.where("scope = 'NATION_7'")
               .select("subscription", "count", "percentage").collect())
    assert a == sorted(tuple(r) for r in subscription_breakdown(L, "NATION_7").collect())
    k = kpis_all_scopes(L).where("scope = 'Nationwide'").drop("scope").collect()
    assert [tuple(r) for r in k] == [tuple(r) for r in kpis(L).collect()]
    m = monthly_listening_all_scopes(L).where("scope = 'NATION_7'").drop("scope")
    assert sorted(tuple(r) for r in m.collect()) == sorted(
        tuple(r) for r in monthly_listening(L, "NATION_7").collect())


def test_materialize_roundtrip(spark, L):
    assert checkpoint_dir(spark)
    m = materialize(L, "listens", partition_by=["year"])
    assert m.count() == L.count()
    p = plan(m.where("year = 1996"))
    assert "PartitionFilters: [isnotnull(year" in p and "= 1996" in p
    c = reliable_checkpoint(L.select("userId", "artist"))
    assert c.count() == L.count()


def test_materialize_dashboard(spark, L):
    from playmetrics.plans import materialize_dashboard
    out = materialize_dashboard(L, "t")
    assert set(out) == {"listens", "top_artists", "top_free_songs", "top_paid_songs",
                        "subscription_breakdown", "kpis", "monthly_listening"}
    nat = [tuple(r) for r in out["top_artists"].where("scope = 'Nationwide'")
           .orderBy("rank").select("artist", "listens").collect()]
    assert nat == [tuple(r) for r in top_artists(L, None, 10).collect()]
    assert out["kpis"].count() == L.select("state").distinct().count() + 1


def test_no_python_and_no_cross_join_in_any_query(spark):
    from __spark_entry__ import core_queries as queries

    for key, fn in queries().items():
        plan = fn(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
        for bad in ("EvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
            assert bad not in plan, (key, bad)


def test_fact_join_is_sort_merge(L):
    p = plan(top_artists(L, None, 10))
    assert "SortMergeJoin [l_orderkey" in p  # never a broadcast of either fact side


def test_tiles_from_additive_counts(spark, L):
    from playmetrics.plans import listen_counts

    # counts appended month by month equal counts of the whole history
    months = [r[0] for r in L.select("year").distinct().collect()]
    parts = [listen_counts(L.where(F.col("year") == y)) for y in months]
    counts = parts[0]
    for p_ in parts[1:]:
        counts = counts.unionByName(p_)

    def same(a, b):
        return sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))

    assert same(top_artists_all_scopes(counts, 10, weight="listens"), top_artists_all_scopes(L, 10))
    assert same(top_songs_all_scopes(counts, "paid", 5, weight="listens"),
                top_songs_all_scopes(L, "paid", 5))
    assert same(subscription_breakdown_all_scopes(counts, weight="listens"),
                subscription_breakdown_all_scopes(L))
    assert counts.count() < L.count()


def test_user_tiles_from_additive_fold(spark, L):
    from playmetrics.plans import kpis_all_scopes_from_fold, user_month_fold

    years = [r[0] for r in L.select("year").distinct().collect()]
    fold = user_month_fold(L.where(F.col("year") == years[0]))
    for y in years[1:]:
        fold = fold.unionByName(user_month_fold(L.where(F.col("year") == y)))

    def rows_of(df):
        return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r)
                       for r in df.collect()), key=str)

    assert rows_of(kpis_all_scopes_from_fold(fold)) == rows_of(kpis_all_scopes(L))
    assert rows_of(monthly_listening_all_scopes(fold)) == rows_of(monthly_listening_all_scopes(L))


def test_tiles_from_appended_parts(spark, L):
    import uuid

    from playmetrics.plans import append_tile_parts, dashboard_tables, tiles_from_parts

    name = f"parts-{uuid.uuid4().hex[:8]}"
    for (y,) in L.select("year").distinct().collect():
        paths = append_tile_parts(L.where(F.col("year") == y), name)
    append_tile_parts(L.where(F.col("year") == y), name)  # the same batch again changes nothing
    got = tiles_from_parts(spark, paths)
    want = dashboard_tables(L)
    assert set(got) == set(want)
    for k in want:
        def rows_of(df):
            return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r)
                           for r in df.select(*sorted(df.columns)).collect()), key=str)
        assert rows_of(got[k]) == rows_of(want[k]), k


def test_ranking_never_takes_a_whole_scope(spark, L):
    """Above the threshold of Spark's own limit the first window still spans name buckets."""
    from playmetrics.plans.rollups import top_artists_all_scopes

    p = plan(top_artists_all_scopes(L, 5000))
    assert p.count("Window [row_number") == 2 and "__bucket" in p


def test_relabel_runs_the_fact_join_twice_at_most(spark, L):
    from playmetrics.operators import relabel_ever_paid

    sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "scripts"))
    from show_plans import final_plan

    assert 1 <= final_plan(relabel_ever_paid(L, 100)).count("SortMergeJoin [l_orderkey") <= 2


def test_views_see_appended_files(spark, tmp_path):
    import shutil

    from playmetrics.sources import testview as tv

    for name in ("customer", "nation", "orders", "part", "lineitem"):
        spark.read.parquet(f"{SF_SMALL}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    before = tv.listens(spark, str(tmp_path)).count()
    part = next((tmp_path / "lineitem.parquet").glob("part-*.parquet"))
    shutil.copy(part, part.with_name("part-again.parquet"))
    assert tv.listens(spark, str(tmp_path)).count() > before


def test_partitioned_writes_are_clustered(spark, L):
    from playmetrics.plans import materialize

    m = materialize(L.repartition(8), "clustered", ["year", "month"])
    assert len(m.inputFiles()) <= 2 * m.select("year", "month").distinct().count()
