"""Tiles kept up to date: stale months, batches without a month, a dictionary of names."""

import uuid

import pytest
from pyspark.sql import functions as F

from playmetrics.functions.text import repair_text
from playmetrics.operators import attach, clean, clean_by_dictionary, repair_dictionary
from playmetrics.operators.dictionary import names_of, repair_by_dictionary
from playmetrics.plans import (
    append_tile_parts, dashboard_tables, fingerprints, fresh_parts, fresh_tiles, refresh_parts,
    tiles_from_parts,
)
from playmetrics.sources.schemas import LISTEN_SCHEMA

from conftest import SF_SMALL

SCHEMA = ("userId string, artist string, song string, state string, duration double, "
          "subscription string, year int, month int, month_name string")
ROWS = [
    ("u1", "A", "s", "CA", 10.0, "free", 2024, 1, "January"),
    ("u1", "A", "s", "CA", 20.0, "paid", 2024, 2, "February"),
    ("u2", "B", "t", "NY", 5.0, "free", 2023, 12, "December"),
    ("u2", "B", "t", None, None, "free", 2023, 12, "December"),
    (None, "B", "s", "CA", 2.5, "paid", None, None, None),
    ("u3", None, "t", "TX", 1.0, "free", None, None, None),
]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def same_tiles(got, listens):
    for key, want in dashboard_tables(listens).items():
        assert sorted(map(str, got[key].collect())) == sorted(map(str, want.collect())), key


@pytest.fixture()
def name():
    return f"test-{uuid.uuid4().hex}"


def test_only_stale_months_are_folded(spark, name):
    listens = frame(spark, ROWS)
    assert refresh_parts(listens, name) == [(None, None), (2023, 12), (2024, 1), (2024, 2)]
    same_tiles(fresh_tiles(spark, name), listens)
    assert refresh_parts(listens.repartition(3), name) == []  # the same rows in another order
    late = frame(spark, [*ROWS, ("u9", "Z", "s", "CA", 1.0, "paid", 2023, 12, "December")])
    assert refresh_parts(late, name) == [(2023, 12)]
    same_tiles(fresh_tiles(spark, name), late)
    undated = frame(spark, [*ROWS, ROWS[4]])  # one more without a month, the late row gone again
    assert refresh_parts(undated, name) == [(None, None), (2023, 12)]
    same_tiles(fresh_tiles(spark, name), undated)
    fewer = frame(spark, ROWS[1:])
    assert refresh_parts(fewer, name) == [(None, None)]  # January is gone: nothing to fold for it
    same_tiles(fresh_tiles(spark, name), fewer)


def test_a_refresh_that_died_changes_nothing(spark, name, monkeypatch):
    listens = frame(spark, ROWS)
    refresh_parts(listens, name)
    from playmetrics.plans import refresh
    monkeypatch.setattr(refresh, "user_month_fold", lambda rows: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        refresh_parts(frame(spark, [*ROWS[:2], ROWS[0]]), name)
    monkeypatch.undo()
    same_tiles(fresh_tiles(spark, name), listens)


def test_stale_months_prune_the_scan(spark, name, tmp_path):
    path = str(tmp_path / "listens")
    frame(spark, ROWS).write.partitionBy("year", "month").parquet(path)
    listens = spark.read.parquet(path).select(*[c.split()[0] for c in SCHEMA.split(", ")])
    months = refresh_parts(listens, name)
    from playmetrics.plans.refresh import _in_months
    plan = listens.where(_in_months([(2024, 2), (None, None)]))._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert len(months) == 4 and "2024" in filters and "isnull(year" in filters
    assert listens.where(_in_months([(2024, 2), (None, None)])).count() == 3


def test_fingerprints_tell_rows_apart(spark):
    def of(rows):
        return {(r["year"], r["month"]): tuple(r)[2:] for r in fingerprints(frame(spark, rows)).collect()}
    a = of(ROWS)
    assert a == of(ROWS[::-1]) and len(a) == 4
    twice = of([*ROWS, ROWS[0], ROWS[0]])  # an exclusive or alone would not see it
    assert twice[2024, 1] != a[2024, 1] and twice[2024, 2] == a[2024, 2]
    assert of([]) == {}


def test_no_part_yet(spark, name):
    with pytest.raises(ValueError, match="refresh it first"):
        fresh_parts(spark, name)
    assert refresh_parts(frame(spark, []), name) == []


def test_batches_keep_rows_without_a_month(spark, name):
    """Five rows in, five out, in any order and after a rerun."""
    first, second = frame(spark, [ROWS[0], ROWS[4], ROWS[5]]), frame(spark, [ROWS[2], ROWS[4]])
    both = first.unionByName(second)
    for order in ((first, second), (second, first), (first, second, first), (second, second, first)):
        n = f"{name}-{uuid.uuid4().hex}"
        for batch in order:
            paths = append_tile_parts(batch, n)
        same_tiles(tiles_from_parts(spark, paths), both)
    alike = frame(spark, [ROWS[4]])  # two batches with the very same undated rows: named
    for batch in ("a", "b", "a"):
        paths = append_tile_parts(alike, f"{name}-alike", batch)
    assert tiles_from_parts(spark, paths)["kpis"].where("scope = 'Nationwide'").first()["paid_duration"] == 5.0


# ------------------------------------------------------------------ names

def once(s):
    return s.encode().decode("latin-1")


NAMES = ["Beyoncé", once("Beyoncé"), once(once("Beyoncé")), "plain", None, "Мир", once("Мир"), "a?é", "", "é" * 3000]


def raw(spark, pairs):
    null = {f.name: None for f in LISTEN_SCHEMA.fields}
    rows = [tuple({**null, "artist": a, "song": s, "ts": 1_700_000_000_000 + i}.values())
            for i, (a, s) in enumerate(pairs)]
    return spark.createDataFrame(rows, LISTEN_SCHEMA)


@pytest.mark.parametrize("hot", [1, 3, 100_000])
@pytest.mark.parametrize("mode", ["intended", "compat"])
def test_cleaning_by_dictionary(spark, hot, mode):
    pairs = [(a, s) for a in NAMES for s in NAMES] + [(NAMES[1], "plain")] * 60
    df = raw(spark, pairs).repartition(4)
    known = repair_dictionary(df, mode=mode)
    got = clean_by_dictionary(df, known, "UTC", max_hot=hot)
    want = clean(df, mode, "UTC")
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_each_name_is_repaired_once(spark):
    df = raw(spark, [(NAMES[1], NAMES[2])] * 50 + [("plain", NAMES[1])] * 50)
    assert {r["name"] for r in names_of(df).collect()} == {NAMES[1], NAMES[2]}
    begun = repair_dictionary(df.where("artist = 'plain'"))
    grown = repair_dictionary(df, begun)
    assert sorted(map(tuple, grown.collect())) == sorted(
        [(NAMES[1], "Beyoncé"), (NAMES[2], "Beyoncé")])
    wrong = spark.createDataFrame([(NAMES[1], "kept")], "name string, repaired string")
    assert dict(map(tuple, repair_dictionary(df, wrong).collect()))[NAMES[1]] == "kept"
    assert repair_by_dictionary(df.where("false"), grown).collect() == []
    unknown = repair_by_dictionary(df, begun.where("false"))
    assert unknown.where(F.col("artist") == NAMES[1]).count() == 50


def reads(df):
    """How often the plan of ``df`` reads the events, and how often it moves rows."""
    df.collect()
    plan = df._jdf.queryExecution().analyzed().toString()
    physical = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return plan.count("Relation [userId"), physical.count("Exchange hashpartitioning")


def test_few_names_are_one_pass(spark, tmp_path):
    path = f"{tmp_path}/raw"
    raw(spark, [(a, s) for a in NAMES for s in NAMES]).write.parquet(path)
    df = spark.read.schema(LISTEN_SCHEMA).parquet(path)
    repair_dictionary(df).write.parquet(f"{tmp_path}/known")
    known = spark.read.parquet(f"{tmp_path}/known")
    assert reads(repair_by_dictionary(df, known)) == (1, 0)
    changed = known.where("name <> repaired").count()
    assert reads(repair_by_dictionary(df, known, max_hot=changed)) == (1, 0)
    assert reads(repair_by_dictionary(df, known, max_hot=changed - 1))[0] > 1


def test_reads_grow_with_the_columns_only(spark, tmp_path):
    path = f"{tmp_path}/raw"
    raw(spark, [(a, s) for a in NAMES for s in NAMES]).write.parquet(path)
    df = spark.read.schema(LISTEN_SCHEMA).parquet(path)
    known = repair_dictionary(spark.createDataFrame(df.collect(), LISTEN_SCHEMA))
    n = [reads(repair_by_dictionary(df, known, cols, max_hot=1))[0] for cols in (
        ("artist",), ("artist", "song"), ("artist", "song", "city"))]
    assert n[2] - n[1] == n[1] - n[0]


@pytest.mark.parametrize("hot", [1, 100_000])
def test_ascii_names_and_repeated_entries(spark, hot):
    df = raw(spark, [("plain", NAMES[1]), (None, "plain"), (NAMES[1], None), (NAMES[2], NAMES[2])])
    entries = [("plain", "other"), (NAMES[1], "x"), (NAMES[1], "y"), (NAMES[1], NAMES[1]),
               (NAMES[2], None), (None, "z")]
    known = spark.createDataFrame(entries, "name string, repaired string")
    got = repair_by_dictionary(df, known, max_hot=hot).select("artist", "song").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [
        ("plain", "x"), ("plain", "y"), (None, "plain"), ("x", None), ("y", None), (NAMES[2], NAMES[2])]))


def test_damaged_events_are_joined_once(spark):
    import __spark_entry__ as e

    df = e.queries()["clean_by_dictionary"](spark, SF_SMALL)
    assert not [f for f in df.inputFiles() if "lineitem" in f]
    want = e.queries()["clean_events_damaged"](spark, SF_SMALL)
    assert df.schema.simpleString() == want.schema.simpleString()
    assert sorted(map(str, df.collect())) == sorted(map(str, want.collect()))


def test_layers_are_a_parameter(spark):
    text = "Beyoncé"
    df = spark.createDataFrame([(once(once(once(text))),)], "t string")
    got = [df.select(repair_text("t", layers=k)).first()[0] for k in (1, 2, 3, 4)]
    assert got == [once(once(text)), once(text), text, text]
    with pytest.raises(ValueError):
        repair_text("t", layers=0)


def test_attach_spreads_hot_keys(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 > 0, "hot").when(
        F.col("id") % 9 == 0, F.lit(None)).otherwise(F.col("id").cast("string")).alias("k"), "id")
    per = df.groupBy("k").agg(F.count("*").alias("__n")).withColumn("v", F.concat(F.lit("v"), "k")).where(
        "v IS NOT NULL AND k <> '3'")
    for hot in (1, 10, 100_000):
        rows = attach(df, per, "k", "v", hot).collect()
        assert len(rows) == 3000
        assert all(r["v"] == (None if r["k"] in (None, "3") else f"v{r['k']}") for r in rows)
