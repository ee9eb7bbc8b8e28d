"""The README usage flow, end to end, on driver-derived JSON events."""

from conftest import SF_SMALL


def test_readme_flow(spark, tmp_path):
    from playmetrics import clean, kpis, monthly_listening, read_listen_events, top_artists
    from playmetrics.plans import materialize_dashboard
    from playmetrics.sources import testview as tv

    feed = str(tmp_path / "listen_events")
    tv.raw_listen_events(spark, SF_SMALL).write.json(feed)

    raw = read_listen_events(spark, feed)
    tiles = materialize_dashboard(clean(raw, time_zone="UTC"))
    listens = tiles["listens"]

    state = listens.select("state").first()[0]
    tile = [tuple(r) for r in top_artists(listens, state=state, n=10).collect()]
    table = [tuple(r) for r in tiles["top_artists"].where(f"scope = '{state}'")
             .orderBy("rank").select("artist", "listens").collect()]
    assert tile == table and len(tile) > 0
    assert kpis(listens).first().total_users == listens.select("userId").distinct().count()
    assert monthly_listening(listens, state=state).count() > 0
