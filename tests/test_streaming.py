"""The listen feed as a file stream gives the batch counts."""

import json
import os
import uuid

import pytest

from playmetrics.operators import artist_state_listens, clean
from playmetrics.sources import read_listen_events
from playmetrics.streaming import (live_artist_state_listens, live_subscription_counts,
                                   read_listen_stream, start_tile)


def test_live_counts_equal_batch(spark, tmp_path):
    d = tmp_path / "feed"
    d.mkdir()
    recs = [{"userId": str(i % 3), "artist": "A" if i % 2 else "BeyoncÃ©", "song": "s",
             "level": "paid" if i % 4 == 0 else "free", "state": "CA" if i < 5 else "NY",
             "duration": 10.0, "ts": 1706745600000 + i} for i in range(10)]
    for k in range(2):
        (d / f"f{k}.json").write_text("\n".join(json.dumps(r) for r in recs[k * 5:(k + 1) * 5]))
    stream = read_listen_stream(spark, str(d), max_files_per_trigger=1)
    name = f"live_artist_state_{uuid.uuid4().hex[:8]}"
    q = start_tile(live_artist_state_listens(stream), name,
                   sink="memory", output_mode="complete", available_now=True)
    q.awaitTermination(120)
    got = sorted(tuple(r) for r in spark.sql(f"SELECT * FROM {name}").collect())
    batch = artist_state_listens(clean(read_listen_events(spark, str(d))))
    assert got == sorted(tuple(r) for r in batch.collect())
    assert ("Beyoncé", "CA", 3) in got
    subs = f"live_subs_{uuid.uuid4().hex[:8]}"
    q2 = start_tile(live_subscription_counts(stream), subs, sink="memory", output_mode="complete",
                    available_now=True)
    q2.awaitTermination(120)
    assert spark.sql(f"SELECT sum(count) FROM {subs}").collect()[0][0] == 10


def test_live_top_artists_and_checkpoint_location(spark, tmp_path):
    from playmetrics.operators import top_artists
    from playmetrics.plans import checkpoint_dir
    from playmetrics.streaming import live_top_artists

    d = tmp_path / "feed"
    d.mkdir()
    artists = ["A"] * 5 + ["B"] * 3 + ["C"] * 3 + ["D"]
    for k, a in enumerate(artists):
        (d / f"f{k}.json").write_text(json.dumps(
            {"userId": "1", "artist": a, "state": "CA", "level": "free", "ts": k}))
    name = f"live_top_{uuid.uuid4().hex[:8]}"
    q = start_tile(live_top_artists(read_listen_stream(spark, str(d), max_files_per_trigger=4), None, 3), name,
                   sink="memory", output_mode="complete", available_now=True)
    q.awaitTermination(120)
    got = [tuple(r) for r in spark.sql(f"SELECT * FROM {name}").collect()]
    batch = top_artists(clean(read_listen_events(spark, str(d))), None, 3)
    assert sorted(got) == sorted(tuple(r) for r in batch.collect()) == [
        ("A", 5), ("B", 3), ("C", 3)]
    assert q.lastProgress is not None
    # a started tile goes on under its name: the second start reads the new file only
    ckpt = checkpoint_dir(spark).rstrip("/")
    rows = clean(read_listen_stream(spark, str(d))).select("artist", "state")
    name, out = f"rows_{uuid.uuid4().hex[:8]}", str(tmp_path / "out")
    for extra in (None, "E"):
        if extra:
            (d / "more.json").write_text(json.dumps(
                {"userId": "1", "artist": extra, "state": "CA", "level": "free", "ts": 99}))
        start_tile(rows, name, "parquet", "append", out, available_now=True).awaitTermination(120)
    assert os.path.isdir(os.path.join(ckpt.replace("file:", ""), "streams", name))
    assert spark.read.parquet(out).count() == len(artists) + 1
    with pytest.raises(ValueError):
        start_tile(rows, name, "memory", "append")


def test_refresh_clean_table_is_incremental(spark, tmp_path):
    from playmetrics.streaming import refresh_clean_table

    feed, table = tmp_path / "feed", str(tmp_path / "clean")
    feed.mkdir()
    name = f"refresh_{uuid.uuid4().hex[:8]}"

    def write(k, n):
        (feed / f"f{k}.json").write_text("\n".join(json.dumps(
            {"userId": str(i), "artist": "BeyoncÃ©", "song": "s", "level": "free",
             "state": "CA", "duration": 1.0, "ts": 1706745600000 + i}) for i in range(n)))

    write(0, 5)
    refresh_clean_table(spark, str(feed), table, name).awaitTermination(120)
    assert spark.read.parquet(table).count() == 5
    refresh_clean_table(spark, str(feed), table, name).awaitTermination(120)
    assert spark.read.parquet(table).count() == 5          # nothing new: nothing added
    write(1, 3)
    refresh_clean_table(spark, str(feed), table, name).awaitTermination(120)
    t = spark.read.parquet(table)
    assert t.count() == 8 and {r.artist for r in t.collect()} == {"Beyoncé"}
    assert {(r.year, r.month) for r in t.select("year", "month").collect()} == {(2024, 2)}
