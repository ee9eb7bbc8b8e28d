"""Event feeds written as JSON lines read back and cleaned."""

import json

import pytest
from pyspark.sql import functions as F

from playmetrics.operators import (auth_view, clean, complete_rows, drop_null_users,
                                   listen_view, null_level_rows, null_user_rows)
from playmetrics.sources import (AUTH_SCHEMA, LISTEN_SCHEMA, read_auth_events,
                                 read_boundaries, read_listen_events, read_page_view_events,
                                 read_status_change_events, state_dim)

# 2024-01-31T23:59:59.999Z and 2024-02-01T00:00:00.000Z
JAN_LAST_MS = 1706745599999
FEB_FIRST_MS = 1706745600000


def _listen(user, song, artist, level, state, ts, duration=200.0):
    return {"userId": user, "lastName": "L", "firstName": "F", "gender": "M", "song": song,
            "artist": artist, "duration": duration, "sessionId": 1, "itemInSession": 0,
            "auth": "Logged In", "level": level, "city": "X", "state": state, "zip": "1",
            "lat": 1.0, "lon": 2.0, "registration": 5, "userAgent": "ua", "ts": ts}


@pytest.fixture()
def listen_dir(tmp_path):
    d = tmp_path / "listen_events"
    d.mkdir()
    recs = [
        _listen(916, "Halo", "BeyoncÃ\u0083Â©", "paid", "CA", JAN_LAST_MS),
        _listen(916, "Yellow", "Coldplay", "free", "CA", FEB_FIRST_MS),
        _listen(None, "Halo", "Beyoncé", None, "NY", FEB_FIRST_MS),
    ]
    (d / "part-0.json").write_text("\n".join(json.dumps(r) for r in recs[:2]) + "\n")
    (d / "part-1.json").write_text(json.dumps(recs[2]) + "\n")
    return str(d)


def test_read_and_clean_listens(spark, listen_dir):
    raw = read_listen_events(spark, listen_dir)
    assert raw.schema == LISTEN_SCHEMA
    assert raw.count() == 3
    c = clean(raw)
    assert c.columns[10] == "subscription" and c.columns[-3:] == ["year", "month", "month_name"]
    got = {(r.song, r.ts.isoformat()): r for r in c.collect()}
    jan = got[("Halo", "2024-01-31T23:59:59.999000")]
    assert jan.artist == "Beyoncé" and (jan.year, jan.month, jan.month_name) == (2024, 1, "January")
    feb = got[("Yellow", "2024-02-01T00:00:00")]
    assert (feb.year, feb.month, feb.month_name) == (2024, 2, "February")
    assert feb.userId == "916"  # numeric JSON id read as text


def test_listen_projection_and_audits(spark, listen_dir):
    raw = read_listen_events(spark, listen_dir)
    v = listen_view(raw)
    assert "subscription" in v.columns and "level" not in v.columns and len(v.columns) == 19
    assert len(listen_view(raw, "subcription").columns) == 19
    assert null_user_rows(raw).count() == 1
    assert drop_null_users(raw).count() == 2
    assert null_level_rows(raw).count() == 0
    assert complete_rows(raw).count() == 2


def test_auth_events(spark, tmp_path):
    d = tmp_path / "auth_events"
    d.mkdir()
    recs = [{"userId": 1, "level": None, "success": True, "ts": 1, "state": "CA"},
            {"userId": None, "level": "free", "success": False, "ts": 2, "state": "NY"}]
    (d / "a.json").write_text("\n".join(json.dumps(r) for r in recs))
    a = read_auth_events(spark, str(d))
    assert a.schema == AUTH_SCHEMA
    assert auth_view(a).columns == [f.name for f in AUTH_SCHEMA.fields]
    assert null_level_rows(a).count() == 1
    assert sorted(r[0] for r in a.select("success").distinct().collect()) == ["false", "true"]


def test_untyped_feeds(spark, tmp_path):
    d = tmp_path / "page_view_events"
    d.mkdir()
    (d / "p.json").write_text('{"page": "Home", "ts": 1}\n{"page": "NextSong", "ts": 2}\n')
    assert read_page_view_events(spark, str(d), "page string, ts bigint").count() == 2
    assert read_status_change_events(spark, str(d), "page string, ts bigint").columns == ["page", "ts"]


def test_missing_path_raises(spark, tmp_path):
    with pytest.raises(Exception):
        read_listen_events(spark, str(tmp_path / "nope")).count()


def test_parquet_feed_and_pushdown(spark, listen_dir, tmp_path):
    out = str(tmp_path / "pq")
    read_listen_events(spark, listen_dir).write.parquet(out)
    c = clean(read_listen_events(spark, out, fmt="parquet")).where(F.col("state") == "CA")
    plan = c._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(state,CA)" in plan  # the scope filter reaches the scan
    assert c.count() == 2


def test_state_dim(spark):
    d = state_dim(spark)
    assert d.count() == 51 and d.columns == ["NAME", "state"]
    t = state_dim(spark, include_territories=True, name_col="state", code_col="state_abbr")
    assert t.count() == 57 and t.columns == ["state", "state_abbr"]
    assert d.select("state").distinct().count() == 51


def test_boundaries(spark, tmp_path):
    p = str(tmp_path / "b")
    spark.createDataFrame([("California", "CA", "POLYGON ((0 0, 1 0, 1 1, 0 0))", 1)],
                          "NAME string, STUSPS string, geometry string, extra int") \
        .write.parquet(p)
    b = read_boundaries(spark, p)
    assert b.columns == ["NAME", "STUSPS", "geometry"] and b.count() == 1


def test_clean_with_fixed_zone_ignores_session_zone(spark, listen_dir):
    raw = read_listen_events(spark, listen_dir)
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
        got = {r.song: (r.ts.isoformat(), r.month) for r in
               clean(raw, time_zone="UTC").select("song", "ts", "month").collect()}
        assert got["Halo"] in {("2024-01-31T23:59:59.999000", 1), ("2024-02-01T00:00:00", 2)}
        assert got["Yellow"] == ("2024-02-01T00:00:00", 2)
        # New York wall clock: both listens fall on January 31
        ny = {r.song: r.month for r in
              clean(raw, time_zone="America/New_York").select("song", "month").collect()}
        assert ny["Yellow"] == 1
        # session-zone form: Tokyo is 9h ahead, so the last-January listen is February
        jp = {r.ts_ms: r.month for r in clean(raw).select(
            F.unix_millis("ts").alias("ts_ms"), "month").collect()}
        assert jp[JAN_LAST_MS] == 2 and jp[FEB_FIRST_MS] == 2
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_json_round_trip_of_driver_events(spark, tmp_path):
    from conftest import SF_SMALL
    from playmetrics.operators import top_artists
    from playmetrics.sources import testview as tv

    raw = tv.raw_listen_events(spark, SF_SMALL)
    out = str(tmp_path / "listen_events")
    raw.write.json(out)
    back = read_listen_events(spark, out)
    a = clean(back, time_zone="UTC")
    b = clean(raw, time_zone="UTC")
    assert a.count() == b.count() == raw.count()
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert [tuple(r) for r in top_artists(a, None, 10).collect()] == \
        [tuple(r) for r in top_artists(b, None, 10).collect()]


def test_where_clean_equals_pushes_candidates(spark, tmp_path):
    from playmetrics.operators import artist_by_state, where_clean_equals

    def dmg(s, k):
        for _ in range(k):
            s = s.encode("utf-8").decode("latin-1")
        return s

    recs = [_listen(i, "Halo", dmg("Beyoncé", i % 3), "free", "CA" if i % 2 else "NY",
                    FEB_FIRST_MS) for i in range(30)]
    recs += [_listen(100 + i, "Yellow", "Coldplay", "free", "CA", FEB_FIRST_MS)
             for i in range(10)]
    d = tmp_path / "feed"
    d.mkdir()
    (d / "p.json").write_text("\n".join(json.dumps(r) for r in recs))
    pq = str(tmp_path / "pq")
    read_listen_events(spark, str(d)).write.parquet(pq)
    raw = read_listen_events(spark, pq, fmt="parquet")
    fast = artist_by_state(clean(where_clean_equals(raw, "artist", "Beyoncé")), "Beyoncé")
    slow = artist_by_state(clean(raw), "Beyoncé")
    assert [tuple(r) for r in fast.collect()] == [tuple(r) for r in slow.collect()]
    assert sum(r.listens for r in fast.collect()) == 30
    plan = fast._jdf.queryExecution().executedPlan().toString()
    assert "In(artist" in plan  # candidate set reaches the parquet scan


def test_malformed_lines_and_many_folders(spark, tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    a.mkdir()
    b.mkdir()
    (a / "x.json").write_text('{"userId": 1, "artist": "A", "ts": 1}\nnot json\n')
    (b / "y.json").write_text('{"userId": 2, "artist": "B", "ts": 2}\n')
    assert read_listen_events(spark, [str(a), str(b)]).count() == 3
    assert read_listen_events(spark, [str(a), str(b)], mode="DROPMALFORMED").count() == 2


def test_boundaries_csv(spark, tmp_path):
    p = tmp_path / "b.csv"
    p.write_text('NAME,STUSPS,geometry\nTexas,TX,"POINT (1 2)"\n')
    b = read_boundaries(spark, str(p), fmt="csv", header=True)
    assert [tuple(r) for r in b.collect()] == [("Texas", "TX", "POINT (1 2)")]
