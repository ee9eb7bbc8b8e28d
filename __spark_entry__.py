"""

``entry(spark)`` runs the flagship query (national top-10 artists) on
sf0.001. ``queries()`` maps every implemented operator to a callable
``(spark, sf_dir) -> DataFrame`` over the driver tables (via the test view of
`playmetrics.sources.testview`), and ``oracle_sql()`` gives the same query as
DuckDB SQL over the same parquet files. Column names and types match on both
sides; ties in every top-N are broken by name on both sides.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from playmetrics.functions.geometry import project, shape_area, unproject
from playmetrics.functions.text import damage_text, repair_text
from playmetrics.operators import (
    artists, cleaning as cl, dictionary, distinct, geo, pruned, songs, subs, users,
)
from playmetrics.plans import (
    append_tile_parts, bitmaps, fresh_tiles, materialize, refresh_parts, rollups, scratch_path,
    tiles_from_parts,
)
from playmetrics.sources import (
    ingest, ingested, quarantine, read_auth_events, read_boundaries, read_events, read_listen_events, state_dim,
    testview as tv, variant,
)
from playmetrics.sources.schemas import ALASKA_BOX, US_STATES, US_TERRITORIES

try:  # the training-data operators are optional; nothing else here needs them
    import corpus_pipeline
    import playmetrics.llm.oracle as llm_oracle
    import playmetrics.llm.queries as llm_queries
except ModuleNotFoundError as missing:
    if missing.name not in ("corpus_pipeline", "playmetrics.llm", "playmetrics.llm.oracle",
                            "playmetrics.llm.queries"):
        raise
    corpus_pipeline = llm_oracle = llm_queries = None

FLAGSHIP_SF = "/root/testdata/sf0.001"

# Query parameters (chosen from the sf0.01 data: 25 artists with listens
# between 1,787 and 2,900, 25 states).
ARTIST = "Brand#2"
UNKNOWN_ARTIST = "Brand#999"
STATE = "NATION_7"
THRESHOLD = 2400
EXCLUDED = ("NATION_1", "NATION_2")
SUBSET_STATE = "NATION_3"
SIZE_RANGE = (10, 20)
PRICE_RANGE = (920.0, 960.0)
LOOKUP_USER = "17"
# Of the harder view: a state, an artist, and a bound that splits the users of sf0.01 (1,500 with
# 60,000 listens) into hot and cold ones.
HARD_STATE = "CA"
HARD_SONG = "Brand#3"
SPLIT_USERS = 1500
# A scope of no tile: some states and months.
RANGE_STATES, RANGE_YEAR, RANGE_MONTHS = ("CA", "CO", "AZ"), 1997, (3, 8)


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: national top-10 artists on sf0.001."""
    return artists.top_artists(tv.listens(spark, FLAGSHIP_SF), state=None, n=10)


# --------------------------------------------------------------------------
# Spark side
# --------------------------------------------------------------------------

def _L(spark, d):
    return tv.listens(spark, d)


def _H(spark, d):
    return tv.hard_listens(spark, d)


def _hard_counts(spark, d):
    """Listens of one brand by US state, in the shape of an artist's counts."""
    listens = _H(spark, d)
    by_brand = listens.withColumn("artist", listens["song"])
    return artists.artist_by_state(by_brand, HARD_SONG)


def _map_table(spark, d, artist=ARTIST):
    counts = artists.artist_by_state(_L(spark, d), artist)
    return geo.map_prep(counts, artist, tv.nation_dim(spark, d, with_regions=True))


def _inline_table(spark, d, artist=ARTIST):
    counts = artists.artist_by_state(_L(spark, d), artist)
    return geo.map_join_inline(counts, tv.nation_dim(spark, d, with_regions=True))


def _user_bitmaps(spark, d):
    """(bitmaps, sums) of the harder view, written once as a dashboard's listens are."""
    listens = materialize(_H(spark, d), "entry-listens")
    return (bitmaps.user_bitmaps(listens, bitmaps.number_values(listens)),
            bitmaps.listen_sums(listens))


def _users_of_range(spark, d):
    cells = _user_bitmaps(spark, d)[0].where(
        F.col("state").isin(*RANGE_STATES) & (F.col("year") == RANGE_YEAR)
        & F.col("month").between(*RANGE_MONTHS))
    known = bitmaps.users_by(cells, include_null=False, alias="n_known").scalar()
    return bitmaps.users_by(cells).withColumn("n_known", known)


def _users_as_artists(spark, d):
    """The harder view with a name for each user: more names than a top-N keeps."""
    return _H(spark, d).withColumn("artist", F.concat(F.lit("user "), F.col("userId")))


def _feed(df, name):
    """The folder of JSON lines that ``df`` is written to, in the shared folder."""
    path = scratch_path(df.sparkSession, name)
    df.write.json(path) if df.columns != ["value"] else df.write.text(path)
    return path


def _boundary_feed(spark, d):
    path = scratch_path(spark, "boundaries")
    tv.nation_boundaries(spark, d).write.parquet(path)
    return read_boundaries(spark, path)


def _page_views(spark, d):
    rows, _ = variant.read_events_inferred(spark, _feed(tv.page_view_lines(spark, d), "page-views"))
    return rows.select("event_id", "user", "kind", "value", "amount", F.col("extra")["k"].alias("k"))


def _undated(spark, d):
    """The harder view; rows without a user have no month either. Written once."""
    dated = F.col("userId").isNotNull()
    return materialize(_H(spark, d).withColumns({
        c: F.when(dated, F.col(c)) for c in ("ts", "year", "month", "month_name")}), "entry-undated")


def _refreshed(spark, d, tile):
    """Tiles kept fresh: all but some rows of each year's March first, then everything."""
    listens, name = _undated(spark, d), f"entry-{uuid.uuid4().hex}"
    refresh_parts(listens.where("NOT (month <=> 3 AND artist IS NULL)"), name)
    refresh_parts(listens, name)
    return fresh_tiles(spark, name)[tile]


def _appended(spark, d, tile):
    """Tiles from two batches that both have rows without a month, the second one run twice."""
    listens, name = _undated(spark, d), f"entry-{uuid.uuid4().hex}"
    first = F.coalesce(F.col("year") < 1998, F.col("state").isNull())
    append_tile_parts(listens.where(first), name)
    append_tile_parts(listens.where(~first), name)
    return tiles_from_parts(spark, append_tile_parts(listens.where(~first), name))[tile]


def _ingested(spark, d):
    """``events`` as a feed folder that grows between loads, loaded thrice."""
    events, feed, store = tv.table(spark, d, "events"), scratch_path(spark, "feed"), scratch_path(spark, "store")

    def read(s, paths):
        return s.read.schema(events.schema).parquet(*paths)

    for part in (F.col("event_id") % 3 < 2, F.col("event_id") % 3 == 2, None):
        if part is not None:
            events.where(part).write.mode("append").parquet(feed)
        ingest(spark, feed, store, read, "*.parquet")
    return ingested(spark, store)


def _cleaned_by_dictionary(spark, d):
    """Damaged events, written once as a load's are, cleaned by a dictionary that was begun on half
    of them."""
    raw = materialize(tv.damaged_listen_events(spark, d), "entry-damaged")
    begun = materialize(dictionary.repair_dictionary(raw.where("sessionId % 2 = 0")), "entry-begun")
    known = materialize(dictionary.repair_dictionary(raw, begun), "entry-dictionary")
    return dictionary.clean_by_dictionary(raw, known, "UTC")


def _shapes(spark, d):
    return materialize(geo.with_shapes(tv.part_shapes(spark, d)), "entry-shapes")


def _shape_facts(spark, d):
    return _shapes(spark, d).select(
        "p_partkey", "problem", F.round("area", 9).alias("area"),
        *[F.round(c, 9).alias(c) for c in ("x_min", "y_min", "x_max", "y_max")])


def _clipped_shapes(spark, d):
    return geo.clip_shapes(_shapes(spark, d), *ALASKA_BOX).select(
        "p_partkey", F.round(shape_area("shape"), 9).alias("area"))


def _projected(spark, d):
    """Points on the equal-area map and back."""
    there = tv.customer_points(spark, d).withColumn("p", project(F.col("lon"), F.col("lat")))
    again = there.withColumn("q", unproject(F.col("p")["x"], F.col("p")["y"]))
    return again.select("c_custkey", *[F.round(F.col("p")[c], 3).alias(c) for c in ("x", "y")],
                        *[F.round(F.col("q")[c], 6).alias(c) for c in ("lon", "lat")])


def _scaled_kpis(spark, d):
    """KPIs as of a far larger feed, so that no label is 0."""
    k = users.kpis(_H(spark, d))
    return k.select((k["total_users"] * 1234).alias("total_users"),
                    (k["avg_duration"] * 17).alias("avg_duration"),
                    (k["paid_duration"] * 97_531).alias("paid_duration"))


def _docs_damaged(spark, d, times):
    docs = tv.table(spark, d, "documents")
    return docs.select("doc_id", damage_text("text", times).alias("text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The library's own queries, and those of the training-data operators if they are there."""
    q = core_queries()
    if corpus_pipeline is not None:
        q |= llm_queries.QUERIES | {"pipeline": corpus_pipeline.run}
    return q


def core_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    q: dict[str, Callable[[SparkSession, str], DataFrame]] = {
        # A12, A1, A2, A3, A13, O6
        "row_count": lambda s, d: distinct.row_count(_L(s, d)),
        "artist_state_listens": lambda s, d: artists.artist_state_listens(_L(s, d)),
        "artist_by_state": lambda s, d: artists.artist_by_state(_L(s, d), ARTIST),
        "artist_by_state_raw": lambda s, d: artists.artist_by_state(cl.clean(
            cl.where_clean_equals(tv.raw_listen_events(s, d), "artist", ARTIST)), ARTIST),
        "artists_over": lambda s, d: artists.artists_over(_L(s, d), THRESHOLD),
        "artists_over_count": lambda s, d: artists.artists_over_count(_L(s, d), THRESHOLD),
        "top5_states_for_artist": lambda s, d: artists.top_n(
            artists.artist_by_state(_L(s, d), ARTIST), 5, "listens", "state"),
        # A4, A5, O7, O8, A15
        "top_artists_national": lambda s, d: artists.top_artists(_L(s, d), None, 10),
        "top_artists_state": lambda s, d: artists.top_artists(_L(s, d), STATE, 10),
        "top_artists_pick": lambda s, d: artists.top_artist_at(_L(s, d), 3, None, 10),
        "top_artists_display": lambda s, d: artists.top_artists_display(_L(s, d), STATE, 10),
        "top50_artists": lambda s, d: artists.top_artists(_L(s, d), "Nationwide", 50),
        "artist_list": lambda s, d: artists.artist_list(_L(s, d), None, 50),
        "artist_list_state": lambda s, d: artists.artist_list(_L(s, d), STATE, 50),
        # A6, A7, A8
        "top_free_songs": lambda s, d: songs.top_free_songs(_L(s, d), None),
        "top_paid_songs": lambda s, d: songs.top_paid_songs(_L(s, d), None),
        "top_free_songs_state": lambda s, d: songs.top_free_songs(_L(s, d), STATE),
        "top_paid_songs_state": lambda s, d: songs.top_paid_songs(_L(s, d), STATE),
        "state_songs": lambda s, d: songs.state_songs(_L(s, d), STATE),
        # A9, P11, P12
        "subscription_breakdown": lambda s, d: subs.subscription_breakdown(_L(s, d)),
        "subscription_breakdown_state": lambda s, d: subs.subscription_breakdown(_L(s, d), STATE),
        "subscription_labels": lambda s, d: subs.breakdown_labels(
            subs.subscription_breakdown(_L(s, d))),
        # A10, D4, P10
        "kpis": lambda s, d: users.kpis(_L(s, d)),
        "kpis_state": lambda s, d: users.kpis(_L(s, d), STATE),
        "kpi_labels": lambda s, d: users.kpi_labels(users.kpis(_L(s, d))),
        # J4, P9, A11, P6
        "ever_paid_users": lambda s, d: users.ever_paid_users(_L(s, d)),
        "relabeled_listens": lambda s, d: users.relabel_ever_paid(_L(s, d)),
        "relabeled_listens_split": lambda s, d: users.relabel_ever_paid(_L(s, d), SPLIT_USERS),
        # the same operators on NULLs, fractions, more artists than the limit, US codes
        "top50_binding": lambda s, d: artists.top_artists(_H(s, d), None, 50),
        "kpis_nulls": lambda s, d: users.kpis(_H(s, d)),
        "monthly_fractional": lambda s, d: users.monthly_listening(_H(s, d), HARD_STATE),
        # A10, D3, D4 from bitmaps; A4, A5, O7 by pruning; J4, P9 behind a filter in the scan
        "kpis_all_scopes_bitmaps": lambda s, d: bitmaps.kpis_all_scopes_from_bitmaps(
            *_user_bitmaps(s, d)),
        "monthly_users_bitmaps": lambda s, d: bitmaps.users_by(
            _user_bitmaps(s, d)[0], ("year", "month")),
        "users_of_range_bitmaps": _users_of_range,
        "top50_pruned": lambda s, d: pruned.top_artists_pruned(_H(s, d), None, 50),
        "top_users_pruned": lambda s, d: pruned.top_artists_pruned(
            _users_as_artists(s, d), None, 10),
        "top_users_pruned_state": lambda s, d: pruned.top_artists_pruned(
            _users_as_artists(s, d), HARD_STATE, 10, buckets=256, first=16),
        "relabeled_listens_filtered": lambda s, d: users.relabel_ever_paid_filtered(_L(s, d)),
        "top_artists_all_scopes_nulls": lambda s, d: rollups.top_artists_all_scopes(_H(s, d), 3),
        "top_artists_all_scopes_deep": lambda s, d: rollups.top_artists_all_scopes(_H(s, d), 1001),
        "map_prep_us": lambda s, d: geo.map_prep(_hard_counts(s, d), HARD_SONG, state_dim(s)),
        "map_join_inline_57": lambda s, d: geo.map_join_inline(
            _hard_counts(s, d), state_dim(s, include_territories=True)),
        # A parquet feed through the reader; feeds of JSON lines, good and bad
        "read_parquet_feed": lambda s, d: read_events(
            s, f"{d}/events.parquet", tv.DRIVER_SCHEMAS["events"], "parquet"),
        "listen_feed": lambda s, d: cl.clean(read_listen_events(
            s, _feed(tv.raw_listen_events(s, d), "listens")), time_zone="UTC"),
        "auth_feed": lambda s, d: read_auth_events(
            s, _feed(tv.audit_events(s, d).drop("event_id", "event_type"), "auth")),
        "auth_feed_checked": lambda s, d: quarantine.read_auth_events_checked(
            s, _feed(tv.audit_lines(s, d), "auth-lines"))[0],
        "auth_feed_quarantined": lambda s, d: quarantine.read_auth_events_checked(
            s, _feed(tv.audit_lines(s, d), "auth-lines"))[1].groupBy("reason").agg(
                F.count("*").alias("n"), F.count_distinct("file", "offset").alias("places")),
        "split_json_good": lambda s, d: quarantine.split_json(
            tv.props_lines(s, d), "line", "k bigint", ("event_id",))[0],
        "split_json_bad": lambda s, d: quarantine.split_json(
            tv.props_lines(s, d), "line", "k bigint", ("event_id",))[1],
        # Files by manifest; C1: stale months, batches; P7, P8: names repaired once
        "ingested_events": _ingested,
        "refreshed_top_artists": lambda s, d: _refreshed(s, d, "top_artists"),
        "refreshed_kpis": lambda s, d: _refreshed(s, d, "kpis"),
        "refreshed_monthly": lambda s, d: _refreshed(s, d, "monthly_listening"),
        "appended_kpis": lambda s, d: _appended(s, d, "kpis"),
        "clean_by_dictionary": _cleaned_by_dictionary,
        # Feeds of unknown columns; S8
        "page_views_inferred": _page_views,
        "status_changes_inferred": lambda s, d: variant.read_events_inferred(
            s, _feed(tv.status_lines(s, d), "status"))[0],
        "boundary_feed": _boundary_feed,
        # Rings, clipping, projection
        "shape_facts": _shape_facts,
        "clipped_shapes": _clipped_shapes,
        "projected_points": _projected,
        "monthly_listening": lambda s, d: users.monthly_listening(_L(s, d)),
        "monthly_listening_state": lambda s, d: users.monthly_listening(_L(s, d), STATE),
        # D1, D2, D3, D4, D5
        "distinct_values": lambda s, d: distinct.distinct_values(tv.audit_events(s, d), "success"),
        "distinct_artists": lambda s, d: distinct.distinct_count(
            _L(s, d), "artist", include_null=True, alias="n_artists"),
        "distinct_users": lambda s, d: distinct.distinct_count(
            tv.audit_events(s, d), "userId", include_null=False, alias="n_users"),
        "distinct_users_with_null": lambda s, d: distinct.distinct_count(
            tv.audit_events(s, d), "userId", include_null=True, alias="n_users"),
        "states_list": lambda s, d: distinct.states_list(_L(s, d)),
        # J1, J2, P4, J3, F11
        "map_prep": lambda s, d: _map_table(s, d),
        "map_prep_unknown": lambda s, d: _map_table(s, d, UNKNOWN_ARTIST),
        "map_join_inline": lambda s, d: _inline_table(s, d),
        "boundaries_attach": lambda s, d: geo.attach_boundaries(
            tv.nation_boundaries(s, d), _map_table(s, d)),
        "boundaries_attach_inline": lambda s, d: geo.attach_boundaries(
            tv.nation_boundaries(s, d), _inline_table(s, d), right_on="state_y"),
        "complete_rows": lambda s, d: cl.complete_rows(geo.attach_boundaries(
            tv.nation_boundaries(s, d), _inline_table(s, d), right_on="state_y")),
        # A14, P13, F8, F9, F12
        "listens_bounds": lambda s, d: geo.listens_bounds(_map_table(s, d)),
        "map_scale": lambda s, d: geo.map_scale(_map_table(s, d)),
        "states_excluding": lambda s, d: geo.exclude_states(_map_table(s, d), EXCLUDED),
        "state_subset": lambda s, d: geo.only_state(_map_table(s, d), SUBSET_STATE),
        "rectangle_filter": lambda s, d: geo.in_rectangle(
            tv.table(s, d, "part"), SIZE_RANGE, PRICE_RANGE, lon="p_size", lat="p_retailprice"),
        # F1, F2, F3, P1
        "null_user_rows": lambda s, d: cl.null_user_rows(tv.audit_events(s, d)),
        "drop_null_users": lambda s, d: cl.drop_null_users(tv.audit_events(s, d)),
        "null_level_rows": lambda s, d: cl.null_level_rows(tv.audit_events(s, d)),
        "null_audit": lambda s, d: cl.null_audit(tv.audit_events(s, d)),
        "auth_projection": lambda s, d: cl.auth_view(tv.audit_events(s, d)),
        "user_rows": lambda s, d: users.user_rows(tv.audit_events(s, d), LOOKUP_USER),
        # P2, P5, P6, P7, P8
        "listen_projection": lambda s, d: cl.listen_view(tv.raw_listen_events(s, d)),
        "clean_events": lambda s, d: cl.clean(tv.raw_listen_events(s, d), time_zone="UTC"),
        "clean_events_damaged": lambda s, d: cl.clean(
            tv.damaged_listen_events(s, d), time_zone="UTC"),
        "artist_by_state_raw_damaged": lambda s, d: artists.artist_by_state(cl.clean(
            cl.where_clean_equals(tv.damaged_listen_events(s, d), "artist", ARTIST + tv.ACCENT)),
            ARTIST + tv.ACCENT),
        "clean_events_ts": lambda s, d: cl.clean(tv.raw_listen_events(s, d)).select(
            "userId", "song", "artist", F.unix_millis("ts").alias("ts_ms")),
        "damaged_text": lambda s, d: _docs_damaged(s, d, 1),
        "repair_text_three_layers": lambda s, d: _docs_damaged(s, d, 3).select(
            "doc_id", repair_text("text", layers=3).alias("text")),
        "kpi_labels_scaled": lambda s, d: users.kpi_labels(_scaled_kpis(s, d)),
        "top_users_all_scopes_deep": lambda s, d: rollups.top_artists_all_scopes(
            _users_as_artists(s, d), 1001),
        "repair_text": lambda s, d: _docs_damaged(s, d, 2).select(
            "doc_id", repair_text("text").alias("text")),
        "repair_text_once": lambda s, d: _docs_damaged(s, d, 1).select(
            "doc_id", repair_text("text").alias("text")),
        "repair_text_compat": lambda s, d: _docs_damaged(s, d, 2).select(
            "doc_id", repair_text("text", mode="compat").alias("text")),
        "repair_text_clean_input": lambda s, d: tv.table(s, d, "documents").select(
            "doc_id", repair_text("text").alias("text")),
        # All-scope tables
        "top_artists_all_scopes": lambda s, d: rollups.top_artists_all_scopes(_L(s, d), 10),
        "top_free_songs_all_scopes": lambda s, d: rollups.top_songs_all_scopes(
            _L(s, d), "free", 5),
        "top_paid_songs_all_scopes": lambda s, d: rollups.top_songs_all_scopes(
            _L(s, d), "paid", 5),
        "subscription_breakdown_all_scopes": lambda s, d:
            rollups.subscription_breakdown_all_scopes(_L(s, d)),
        "kpis_all_scopes": lambda s, d: rollups.kpis_all_scopes(_L(s, d)),
        "kpis_all_scopes_from_fold": lambda s, d: rollups.kpis_all_scopes_from_fold(
            rollups.user_month_fold(_L(s, d))),
        "top_artists_all_scopes_from_counts": lambda s, d: rollups.top_artists_all_scopes(
            rollups.listen_counts(_L(s, d)), 10, weight="listens"),
        "monthly_listening_all_scopes": lambda s, d:
            rollups.monthly_listening_all_scopes(_L(s, d)),
    }
    return q


# --------------------------------------------------------------------------
# DuckDB side
# --------------------------------------------------------------------------

_L_SQL = """L AS (
  SELECT o_custkey AS userId, p_brand AS artist, p_name AS song, n_name AS state,
         l_quantity AS duration,
         CASE WHEN o_orderpriority = '1-URGENT' THEN 'paid' ELSE 'free' END AS subscription,
         o_orderdate AS ts,
         CAST(year(o_orderdate) AS INTEGER) AS year,
         CAST(month(o_orderdate) AS INTEGER) AS month,
         monthname(o_orderdate) AS month_name
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN part ON l_partkey = p_partkey
  JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey)"""

_RAW_SQL = """R AS (
  SELECT CAST(o_custkey AS VARCHAR) AS userId, CAST(NULL AS VARCHAR) AS lastName,
         CAST(NULL AS VARCHAR) AS firstName, CAST(NULL AS VARCHAR) AS gender,
         p_name AS song, p_brand AS artist, l_quantity AS duration,
         l_orderkey AS sessionId, CAST(l_linenumber AS BIGINT) AS itemInSession,
         CAST(NULL AS VARCHAR) AS auth,
         CASE WHEN o_orderpriority = '1-URGENT' THEN 'paid' ELSE 'free' END AS level,
         CAST(NULL AS VARCHAR) AS city, n_name AS state, CAST(NULL AS VARCHAR) AS zip,
         CAST(NULL AS DOUBLE) AS lat, CAST(NULL AS DOUBLE) AS lon,
         CAST(NULL AS BIGINT) AS registration, CAST(NULL AS VARCHAR) AS userAgent,
         o_orderdate AS ts
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN part ON l_partkey = p_partkey
  JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey)"""

_CODES = ", ".join(f"'{code}'" for _, code in US_STATES[:25])
_H_SQL = f"""L AS (
  SELECT CASE WHEN l_linenumber <> 7 THEN o_custkey END AS userId,
         CASE WHEN l_linenumber <> 6 THEN p_name END AS artist, p_brand AS song,
         CASE WHEN l_linenumber <> 5 THEN [{_CODES}][CAST(n_nationkey AS INTEGER) + 1] END AS state,
         l_quantity + l_linenumber * 0.25::DOUBLE AS duration,
         CASE WHEN o_orderpriority = '1-URGENT' THEN 'paid' ELSE 'free' END AS subscription,
         o_orderdate AS ts,
         CAST(year(o_orderdate) AS INTEGER) AS year,
         CAST(month(o_orderdate) AS INTEGER) AS month,
         monthname(o_orderdate) AS month_name
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN part ON l_partkey = p_partkey
  JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey)"""
_U_SQL = (_H_SQL.replace("L AS (", "U0 AS (", 1) + """,
L AS (
  SELECT * REPLACE (CASE WHEN userId IS NOT NULL THEN ts END AS ts,
                    CASE WHEN userId IS NOT NULL THEN year END AS year,
                    CASE WHEN userId IS NOT NULL THEN month END AS month,
                    CASE WHEN userId IS NOT NULL THEN month_name END AS month_name) FROM U0)""")
_HC_SQL = (f"C AS (SELECT song AS artist, state, count(*) AS listens FROM L "
           f"WHERE song = '{HARD_SONG}' GROUP BY song, state)")


def _states_sql(rows) -> str:
    values = ", ".join("('{}', '{}')".format(n.replace("'", "''"), c) for n, c in rows)
    return f"U AS (SELECT * FROM (VALUES {values}) AS t(NAME, state))"


_AUDIT_SQL = """A AS (
  SELECT CASE WHEN event_type = 'error' THEN NULL ELSE CAST(user_id AS VARCHAR) END AS userId,
         CAST(NULL AS VARCHAR) AS lastName, CAST(NULL AS VARCHAR) AS firstName,
         CAST(NULL AS VARCHAR) AS gender, CAST(NULL AS VARCHAR) AS city,
         CAST(NULL AS VARCHAR) AS state, CAST(NULL AS VARCHAR) AS zip,
         CAST(NULL AS DOUBLE) AS lat, CAST(NULL AS DOUBLE) AS lon,
         CASE WHEN event_type = 'view' THEN NULL
              WHEN event_type = 'purchase' THEN 'paid' ELSE 'free' END AS level,
         event_id AS sessionId, CAST(NULL AS BIGINT) AS itemInSession,
         CAST(NULL AS BIGINT) AS registration,
         CASE WHEN value >= 50.0 THEN 'true' ELSE 'false' END AS success,
         CAST(NULL AS VARCHAR) AS userAgent, epoch_us(ts) // 1000 AS ts,
         event_id, event_type
  FROM events)"""

_AUTH_COLS = ("userId, lastName, firstName, gender, city, state, zip, lat, lon, level, "
              "sessionId, itemInSession, registration, success, userAgent, ts")

_PROPS_SQL = """P0 AS (
  SELECT event_id, CASE event_id % 10
           WHEN 3 THEN substr(props, 1, length(props) - 1) WHEN 4 THEN '{"k": "x"}'
           WHEN 5 THEN '[' || props || ']' WHEN 6 THEN '  '
           WHEN 7 THEN props || ' ' || props ELSE props END AS line
  FROM events),
P AS (
  SELECT *, CASE WHEN regexp_matches(line, '^\\{[^{}]*\\}\\s*\\S') THEN 'text after the object'
                 WHEN NOT json_valid(line) THEN 'not JSON'
                 WHEN json_type(line) <> 'OBJECT' THEN 'not an object'
                 WHEN json_type(line, '$.k') NOT IN ('BIGINT', 'UBIGINT') THEN 'wrong type'
            END AS reason FROM P0)"""

_SHAPES_SQL = """P AS (
  SELECT p_partkey, p_partkey % 8 AS kind, -175.0::DOUBLE + p_partkey % 50 AS x,
         45.0::DOUBLE + p_size % 20 AS y, 0.5::DOUBLE + p_size / 16.0::DOUBLE AS s,
         CASE p_partkey % 8 WHEN 2 THEN 'ring not closed' WHEN 3 THEN 'not a polygon'
                            WHEN 4 THEN 'not a number' END AS problem,
         p_partkey % 8 NOT IN (2, 3, 4, 5) AS shown
  FROM part)"""


def _overlap_sql(a: float, b: float, width: float, height: float) -> str:
    """Area that a rectangle of a part's shape, placed and sized in arm widths, has in the box."""
    (x0, x1), (y0, y1) = ALASKA_BOX
    return (f"greatest(0, least(x + s * {a + width}, {x1}) - greatest(x + s * {a}, {x0})) * "
            f"greatest(0, least(y + s * {b + height}, {y1}) - greatest(y + s * {b}, {y0}))")


_PROJECTED_SQL = """WITH P AS (
  SELECT c_custkey, c_custkey % 360 - 180 + 0.25::DOUBLE AS lon, c_custkey % 179 - 89 + 0.5::DOUBLE AS lat
  FROM customer),
Q AS (
  SELECT *, 6370997.0::DOUBLE * sqrt(2 / (1 + sin(radians(45)) * sin(radians(lat))
              + cos(radians(45)) * cos(radians(lat)) * cos(radians(lon + 100)))) AS k FROM P)
SELECT c_custkey, round(k * cos(radians(lat)) * sin(radians(lon + 100)), 3) AS x,
       round(k * (cos(radians(45)) * sin(radians(lat))
                  - sin(radians(45)) * cos(radians(lat)) * cos(radians(lon + 100))), 3) AS y,
       round(lon, 6) AS lon, round(lat, 6) AS lat
FROM Q"""

_DIM_SQL = """D AS (
  SELECT r_name || '/' || n_name AS NAME, n_name AS state
  FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL
  SELECT r_name AS NAME, r_name AS state FROM region)"""

_BOUNDS_SQL = """B AS (
  SELECT r_name || '/' || n_name AS NAME, n_name AS STUSPS,
         printf('POINT (%d %d)', n_nationkey, n_regionkey) AS geometry
  FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL
  SELECT r_name AS NAME, r_name AS STUSPS, printf('POINT (%d 0)', r_regionkey) AS geometry
  FROM region)"""


def _counts_sql(artist: str) -> str:
    return (f"C AS (SELECT artist, state, count(*) AS listens FROM L "
            f"WHERE artist = '{artist}' GROUP BY artist, state)")


def _map_sql(artist: str = ARTIST) -> str:
    return (f"M AS (SELECT coalesce(C.artist, '{artist}') AS artist, D.state AS state, "
            f"coalesce(C.listens, 0) AS listens, D.NAME AS NAME "
            f"FROM D LEFT JOIN C ON D.state = C.state)")


_INLINE_SQL = ("I AS (SELECT C.artist AS artist, C.state AS state_x, C.listens AS listens, "
               "D.NAME AS state_y FROM D LEFT JOIN C ON D.state = C.state)")


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def _top_artists_sql(where: str = "", n: int = 10) -> str:
    return (f"SELECT artist, count(*) AS listens FROM L {where} GROUP BY artist "
            f"ORDER BY listens DESC, artist LIMIT {n}")


def _top_songs_sql(level: str, where: str = "") -> str:
    return (f"SELECT song, count(*) AS listens FROM L WHERE subscription = '{level}' {where} "
            f"GROUP BY song ORDER BY listens DESC, song LIMIT 5")


def _breakdown_sql(where: str = "") -> str:
    return (f"SELECT subscription, count(*) AS count, "
            f"CAST(count(*) AS DOUBLE) / CAST(sum(count(*)) OVER () AS DOUBLE) * 100.0 "
            f"AS percentage FROM L {where} GROUP BY subscription")


def _kpis_sql(where: str = "") -> str:
    return (f"SELECT CAST(count(DISTINCT userId) + "
            f"coalesce(max(CASE WHEN userId IS NULL THEN 1 ELSE 0 END), 0) AS BIGINT) "
            f"AS total_users, avg(duration) AS avg_duration, "
            f"sum(CASE WHEN subscription = 'paid' THEN duration END) AS paid_duration "
            f"FROM L {where}")


def _labels_sql(source: str) -> str:
    return ("SELECT CAST(CAST(round_even(total_users / 1000.0, 0) AS BIGINT) AS VARCHAR) || 'k+' "
            "AS users_label, "
            "CAST(CAST(round_even(avg_duration / 60.0, 0) AS BIGINT) AS VARCHAR) || ' MIN' "
            "AS avg_label, "
            "CAST(CAST(round_even(paid_duration / 3600000.0, 0) AS BIGINT) AS VARCHAR) "
            f"|| 'k+ H' AS paid_label FROM {source}")


def _monthly_sql(where: str = "") -> str:
    return (f"SELECT year, month, month_name, "
            f"CASE WHEN userId IN (SELECT userId FROM L WHERE subscription = 'paid') "
            f"THEN 'paid' ELSE subscription END AS subscription, "
            f"sum(duration) / 60.0 AS total_duration "
            f"FROM L {where} GROUP BY ALL")


_SCOPE = "CASE WHEN g = 1 THEN 'Nationwide' ELSE state END AS scope"


def _top_songs_all_scopes_sql(level: str) -> str:
    return (f"SELECT {_SCOPE}, CAST(rank AS INTEGER) AS rank, song, listens FROM ("
            "SELECT *, row_number() OVER (PARTITION BY g, state ORDER BY listens DESC, "
            "song) AS rank FROM (SELECT state, song, count(*) AS listens, "
            f"grouping(state) AS g FROM L WHERE subscription = '{level}' "
            "GROUP BY GROUPING SETS ((song), (state, song)))) WHERE rank <= 5")


def _top_all_scopes_sql(n: int) -> str:
    return (f"SELECT {_SCOPE}, CAST(rank AS INTEGER) AS rank, artist, listens FROM ("
            "SELECT *, row_number() OVER (PARTITION BY g, state ORDER BY listens DESC, "
            "artist NULLS FIRST) AS rank FROM (SELECT state, artist, count(*) AS listens, "
            "grouping(state) AS g FROM L GROUP BY GROUPING SETS ((artist), (state, artist))))"
            f" WHERE rank <= {n}")


_USERS_SQL = ("CAST(count(DISTINCT userId) + coalesce(max(CASE WHEN userId IS NULL THEN 1 "
              "ELSE 0 END), 0) AS BIGINT)")
_TOP_USERS_SQL = ("SELECT 'user ' || userId AS artist, count(*) AS listens FROM L {where} "
                  "GROUP BY userId ORDER BY listens DESC, artist NULLS FIRST LIMIT 10")
_KPIS_ALL_SCOPES_SQL = (
    f"SELECT {_SCOPE}, total_users, avg_duration, paid_duration FROM ("
    f"SELECT state, grouping(state) AS g, {_USERS_SQL} AS total_users, "
    "avg(duration) AS avg_duration, "
    "sum(CASE WHEN subscription = 'paid' THEN duration END) AS paid_duration "
    "FROM L GROUP BY GROUPING SETS ((), (state)))")


_MONTHLY_ALL_SCOPES_SQL = (
    f"SELECT {_SCOPE}, year, month, month_name, subscription, total_duration FROM ("
    "SELECT state, year, month, month_name, subscription, grouping(state) AS g, "
    "sum(duration) / 60.0 AS total_duration FROM (SELECT state, year, month, "
    "month_name, CASE WHEN userId IN (SELECT userId FROM L WHERE subscription = "
    "'paid') THEN 'paid' ELSE subscription END AS subscription, duration FROM L) "
    "GROUP BY GROUPING SETS ((year, month, month_name, subscription), "
    "(state, year, month, month_name, subscription)))")


def oracle_sql() -> dict[str, str]:
    sql = core_oracle_sql()
    if corpus_pipeline is not None:
        sql |= llm_oracle.oracle_sql()
        if corpus_pipeline.ORACLE_SQL is not None:
            sql["pipeline"] = corpus_pipeline.ORACLE_SQL
    return sql


def core_oracle_sql() -> dict[str, str]:
    wl = _with(_L_SQL)
    wh = _with(_H_SQL)
    state = f"WHERE state = '{STATE}'"
    top10 = f"({_top_artists_sql()})"
    sql = {
        "row_count": wl + "SELECT count(*) AS n FROM L",
        "artist_state_listens": wl + "SELECT artist, state, count(*) AS listens FROM L "
                                     "GROUP BY artist, state",
        "artist_by_state": wl + f"SELECT artist, state, count(*) AS listens FROM L "
                                f"WHERE artist = '{ARTIST}' GROUP BY artist, state",
        "artist_by_state_raw": wl + f"SELECT artist, state, count(*) AS listens FROM L "
                                    f"WHERE artist = '{ARTIST}' GROUP BY artist, state",
        "artists_over": wl + f"SELECT artist, count(*) AS listens FROM L GROUP BY artist "
                             f"HAVING count(*) >= {THRESHOLD}",
        "artists_over_count": wl + f"SELECT count(*) AS n_artists FROM (SELECT artist FROM L "
                                   f"GROUP BY artist HAVING count(*) >= {THRESHOLD})",
        "top5_states_for_artist": wl + f"SELECT artist, state, count(*) AS listens FROM L "
                                       f"WHERE artist = '{ARTIST}' GROUP BY artist, state "
                                       f"ORDER BY listens DESC, state LIMIT 5",
        "top_artists_national": wl + _top_artists_sql(),
        "top_artists_state": wl + _top_artists_sql(state),
        "top_artists_pick": wl + f"SELECT CAST(rank AS INTEGER) AS rank, artist, listens FROM "
                                 f"(SELECT artist, listens, row_number() OVER "
                                 f"(ORDER BY listens DESC, artist) AS rank FROM {top10}) "
                                 f"WHERE rank = 3",
        "top_artists_display": wl + f'SELECT artist AS "Artist", listens AS "Total Streams" '
                                    f"FROM ({_top_artists_sql(state)})",
        "top50_artists": wl + _top_artists_sql(n=50),
        "artist_list": wl + f"SELECT string_agg(artist, ', ' ORDER BY listens DESC, artist) "
                            f"AS artists FROM ({_top_artists_sql(n=50)})",
        "artist_list_state": wl + f"SELECT string_agg(artist, ', ' ORDER BY listens DESC, "
                                  f"artist) AS artists FROM ({_top_artists_sql(state, 50)})",
        "top_free_songs": wl + _top_songs_sql("free"),
        "top_paid_songs": wl + _top_songs_sql("paid"),
        "top_free_songs_state": wl + _top_songs_sql("free", f"AND state = '{STATE}'"),
        "top_paid_songs_state": wl + _top_songs_sql("paid", f"AND state = '{STATE}'"),
        "state_songs": wl + f"SELECT state, song, count(*) AS listens FROM L {state} "
                            f"GROUP BY state, song",
        "subscription_breakdown": wl + _breakdown_sql(),
        "subscription_breakdown_state": wl + _breakdown_sql(state),
        "subscription_labels": wl + f"SELECT subscription AS Subscription, "
                                    f"printf('%.1f%%', percentage) AS Percentage "
                                    f"FROM ({_breakdown_sql()})",
        "kpis": wl + _kpis_sql(),
        "kpis_state": wl + _kpis_sql(state),
        "kpi_labels": wl + _labels_sql(f"({_kpis_sql()})"),
        "kpi_labels_scaled": wh + _labels_sql(
            "(SELECT total_users * 1234 AS total_users, avg_duration * 17 AS avg_duration, "
            f"paid_duration * 97531 AS paid_duration FROM ({_kpis_sql()}))"),
        "ever_paid_users": wl + "SELECT DISTINCT userId FROM L "
                                "WHERE subscription = 'paid' AND userId IS NOT NULL",
        "relabeled_listens": wl + "SELECT userId, artist, song, state, duration, "
            "CASE WHEN userId IN (SELECT userId FROM L WHERE subscription = 'paid') "
            "THEN 'paid' ELSE subscription END AS subscription, ts, year, month, month_name "
            "FROM L",
        "top50_binding": wh + _top_artists_sql(n=50),
        "kpis_nulls": wh + _kpis_sql(),
        "monthly_fractional": wh + _monthly_sql(f"WHERE state = '{HARD_STATE}'"),
        # A10, D3, D4 from bitmaps; A4, A5, O7 by pruning; J4, P9 behind a filter in the scan
        "kpis_all_scopes_bitmaps": lambda s, d: bitmaps.kpis_all_scopes_from_bitmaps(
            *_user_bitmaps(s, d)),
        "monthly_users_bitmaps": lambda s, d: bitmaps.users_by(
            _user_bitmaps(s, d)[0], ("year", "month")),
        "users_of_range_bitmaps": _users_of_range,
        "top50_pruned": lambda s, d: pruned.top_artists_pruned(_H(s, d), None, 50),
        "top_users_pruned": lambda s, d: pruned.top_artists_pruned(
            _users_as_artists(s, d), None, 10),
        "top_users_pruned_state": lambda s, d: pruned.top_artists_pruned(
            _users_as_artists(s, d), HARD_STATE, 10, buckets=256, first=16),
        "relabeled_listens_filtered": lambda s, d: users.relabel_ever_paid_filtered(_L(s, d)),
        "kpis_all_scopes_bitmaps": wh + _KPIS_ALL_SCOPES_SQL,
        "monthly_users_bitmaps": wh + f"SELECT year, month, {_USERS_SQL} AS n_users FROM L "
                                      "GROUP BY year, month",
        "users_of_range_bitmaps": wh + f"SELECT {_USERS_SQL} AS n_users, "
            f"count(DISTINCT userId) AS n_known FROM L WHERE state IN {RANGE_STATES} "
            f"AND year = {RANGE_YEAR} AND month BETWEEN {RANGE_MONTHS[0]} AND {RANGE_MONTHS[1]}",
        "top50_pruned": wh + _top_artists_sql(n=50),
        "top_users_pruned": wh + _TOP_USERS_SQL.format(where=""),
        "top_users_pruned_state": wh + _TOP_USERS_SQL.format(where=f"WHERE state = '{HARD_STATE}'"),
        "top_artists_all_scopes_nulls": wh + _top_all_scopes_sql(3),
        "top_artists_all_scopes_deep": wh + _top_all_scopes_sql(1001),
        "map_prep_us": _with(_H_SQL, _HC_SQL, _states_sql(US_STATES))
            + f"SELECT coalesce(C.artist, '{HARD_SONG}') AS artist, U.state, "
              "coalesce(C.listens, 0) AS listens, U.NAME FROM U LEFT JOIN C ON U.state = C.state",
        "map_join_inline_57": _with(_H_SQL, _HC_SQL, _states_sql(US_STATES + US_TERRITORIES))
            + "SELECT C.artist, C.state AS state_x, C.listens, U.NAME AS state_y "
              "FROM U LEFT JOIN C ON U.state = C.state",
        "read_parquet_feed": "SELECT * FROM events",
        "auth_feed": _with(_AUDIT_SQL) + f"SELECT {_AUTH_COLS} FROM A",
        "auth_feed_checked": _with(_AUDIT_SQL) + f"SELECT {_AUTH_COLS} FROM A "
                                                 "WHERE sessionId % 10 <> 8",
        "auth_feed_quarantined": _with(_AUDIT_SQL) + "SELECT 'not JSON' AS reason, count(*) AS n, "
                                 "count(*) AS places FROM A WHERE sessionId % 10 = 8",
        "split_json_good": _with(_PROPS_SQL) + "SELECT event_id, "
            "CAST(json_extract(line, '$.k') AS BIGINT) AS k FROM P WHERE reason IS NULL",
        "split_json_bad": _with(_PROPS_SQL) + "SELECT event_id, reason, line FROM P "
                                              "WHERE reason IS NOT NULL AND trim(line) <> ''",
        "page_views_inferred": "SELECT event_id, CAST(user_id AS VARCHAR) AS user, "
            "event_type AS kind, value, CASE WHEN event_type = 'purchase' THEN value END AS amount, "
            "CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
        "status_changes_inferred": "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, "
                                   "o_orderpriority FROM orders",
        "ingested_events": "SELECT * FROM events",
        "refreshed_top_artists": _with(_U_SQL) + _top_all_scopes_sql(10),
        "refreshed_kpis": _with(_U_SQL) + _KPIS_ALL_SCOPES_SQL,
        "refreshed_monthly": _with(_U_SQL) + _MONTHLY_ALL_SCOPES_SQL,
        "appended_kpis": _with(_U_SQL) + _KPIS_ALL_SCOPES_SQL,
        "shape_facts": _with(_SHAPES_SQL) + "SELECT p_partkey, problem, "
            "CASE WHEN kind = 5 THEN 0.0 WHEN problem IS NULL THEN round(3 * s * s "
            "- (kind = 0)::INT * s * s / 16 + (kind = 1)::INT * s * s, 9) END AS area, "
            "CASE WHEN shown THEN round(x, 9) END AS x_min, CASE WHEN shown THEN round(y, 9) END AS y_min, "
            "CASE WHEN shown THEN round(x + s * CASE WHEN kind = 1 THEN 4 ELSE 2 END, 9) END AS x_max, "
            "CASE WHEN shown THEN round(y + 2 * s, 9) END AS y_max FROM P",
        "clipped_shapes": _with(_SHAPES_SQL) + "SELECT * FROM (SELECT p_partkey, round("
            + _overlap_sql(0, 0, 2, 1) + " + " + _overlap_sql(0, 1, 1, 1)
            + " - (kind = 0)::INT * " + _overlap_sql(0.25, 0.25, 0.25, 0.25)
            + " + (kind = 1)::INT * " + _overlap_sql(3, 0, 1, 1)
            + ", 9) AS area FROM P WHERE shown) WHERE area > 0",
        "projected_points": _PROJECTED_SQL,
        "boundary_feed": _with(_BOUNDS_SQL) + "SELECT * FROM B",
        "monthly_listening": wl + _monthly_sql(),
        "monthly_listening_state": wl + _monthly_sql(state),
        "distinct_values": _with(_AUDIT_SQL) + "SELECT DISTINCT success FROM A",
        "distinct_artists": wl + "SELECT CAST(count(DISTINCT artist) + coalesce(max(CASE WHEN "
                                 "artist IS NULL THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_artists "
                                 "FROM L",
        "distinct_users": _with(_AUDIT_SQL) + "SELECT count(DISTINCT userId) AS n_users FROM A",
        "distinct_users_with_null": _with(_AUDIT_SQL) +
            "SELECT CAST(count(DISTINCT userId) + coalesce(max(CASE WHEN userId IS NULL "
            "THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_users FROM A",
        "states_list": wl + "SELECT DISTINCT state FROM L",
        "map_prep": _with(_L_SQL, _DIM_SQL, _counts_sql(ARTIST), _map_sql())
                    + "SELECT * FROM M",
        "map_prep_unknown": _with(_L_SQL, _DIM_SQL, _counts_sql(UNKNOWN_ARTIST),
                                  _map_sql(UNKNOWN_ARTIST)) + "SELECT * FROM M",
        "map_join_inline": _with(_L_SQL, _DIM_SQL, _counts_sql(ARTIST), _INLINE_SQL)
                           + "SELECT * FROM I",
        "boundaries_attach": _with(_L_SQL, _DIM_SQL, _BOUNDS_SQL, _counts_sql(ARTIST),
                                   _map_sql())
            + "SELECT B.NAME, B.STUSPS, B.geometry, M.artist, M.state, M.listens "
              "FROM B LEFT JOIN M ON B.NAME = M.NAME",
        "boundaries_attach_inline": _with(_L_SQL, _DIM_SQL, _BOUNDS_SQL, _counts_sql(ARTIST),
                                          _INLINE_SQL)
            + "SELECT B.NAME, B.STUSPS, B.geometry, I.artist, I.state_x, I.listens, I.state_y "
              "FROM B LEFT JOIN I ON B.NAME = I.state_y",
        "complete_rows": _with(_L_SQL, _DIM_SQL, _BOUNDS_SQL, _counts_sql(ARTIST), _INLINE_SQL)
            + "SELECT * FROM (SELECT B.NAME, B.STUSPS, B.geometry, I.artist, I.state_x, "
              "I.listens, I.state_y FROM B LEFT JOIN I ON B.NAME = I.state_y) "
              "WHERE NAME IS NOT NULL AND STUSPS IS NOT NULL AND geometry IS NOT NULL "
              "AND artist IS NOT NULL AND state_x IS NOT NULL AND listens IS NOT NULL "
              "AND state_y IS NOT NULL",
        "listens_bounds": _with(_L_SQL, _DIM_SQL, _counts_sql(ARTIST), _map_sql())
            + "SELECT min(listens) AS min_listens, max(listens) AS max_listens FROM M",
        "map_scale": _with(_L_SQL, _DIM_SQL, _counts_sql(ARTIST), _map_sql())
            + "SELECT M.*, CASE WHEN listens IS NULL THEN NULL WHEN hi = lo THEN 0.0 "
              "ELSE greatest(0.0, least(1.0, (CAST(listens AS DOUBLE) - lo) / (hi - lo))) "
              "END AS scaled FROM M, (SELECT CAST(min(listens) AS DOUBLE) AS lo, "
              "CAST(max(listens) AS DOUBLE) AS hi FROM M) b",
        "states_excluding": _with(_L_SQL, _DIM_SQL, _counts_sql(ARTIST), _map_sql())
            + "SELECT * FROM M WHERE state NOT IN ("
            + ", ".join(f"'{s}'" for s in EXCLUDED) + ")",
        "state_subset": _with(_L_SQL, _DIM_SQL, _counts_sql(ARTIST), _map_sql())
            + f"SELECT * FROM M WHERE state = '{SUBSET_STATE}'",
        "rectangle_filter": f"SELECT * FROM part WHERE p_size BETWEEN {SIZE_RANGE[0]} AND "
                            f"{SIZE_RANGE[1]} AND p_retailprice BETWEEN {PRICE_RANGE[0]} "
                            f"AND {PRICE_RANGE[1]}",
        "null_user_rows": _with(_AUDIT_SQL) + "SELECT * FROM A WHERE userId IS NULL",
        "null_audit": _with(_AUDIT_SQL)
            + "SELECT count(*) FILTER (WHERE userId IS NULL) AS null_user_rows, "
              "count(*) FILTER (WHERE userId IS NOT NULL) AS user_rows, "
              "count(*) FILTER (WHERE userId IS NOT NULL AND level IS NULL) AS null_level_rows "
              "FROM A",
        "user_rows": _with(_AUDIT_SQL) + f"SELECT * FROM A WHERE userId = '{LOOKUP_USER}'",
        "drop_null_users": _with(_AUDIT_SQL) + "SELECT * FROM A WHERE userId IS NOT NULL",
        "null_level_rows": _with(_AUDIT_SQL)
            + "SELECT * FROM A WHERE level IS NULL AND userId IS NOT NULL",
        "auth_projection": _with(_AUDIT_SQL)
            + f"SELECT {_AUTH_COLS} FROM A",
        "listen_projection": _with(_RAW_SQL)
            + "SELECT userId, lastName, firstName, gender, song, artist, duration, sessionId, "
              "itemInSession, auth, level AS subscription, city, state, zip, lat, lon, "
              "registration, userAgent, epoch_ms(ts) AS ts FROM R",
        "clean_events": _with(_RAW_SQL)
            + "SELECT userId, lastName, firstName, gender, song, artist, duration, sessionId, "
              "itemInSession, auth, level AS subscription, city, state, zip, lat, lon, "
              "registration, userAgent, ts, CAST(year(ts) AS INTEGER) AS year, "
              "CAST(month(ts) AS INTEGER) AS month, monthname(ts) AS month_name FROM R",
        "artist_by_state_raw_damaged": wl + f"SELECT artist || '{tv.ACCENT}' AS artist, state, "
            f"count(*) AS listens FROM L WHERE artist = '{ARTIST}' GROUP BY artist, state",
        "clean_events_ts": _with(_RAW_SQL) + "SELECT userId, song, artist, epoch_ms(ts) AS ts_ms "
                                             "FROM R",
        # each byte of the text's UTF-8 becomes the character of that number
        "damaged_text": "SELECT doc_id, CASE WHEN text IS NOT NULL THEN array_to_string("
            "list_transform(regexp_extract_all(hex(encode(text)), '..'), "
            "lambda x: chr(CAST('0x' || x AS INTEGER))), '') END AS text FROM documents",
        "top_users_all_scopes_deep": _with(_H_SQL.replace("CASE WHEN l_linenumber <> 6 THEN p_name END",
            "CASE WHEN l_linenumber <> 7 THEN 'user ' || o_custkey END")) + _top_all_scopes_sql(1001),
        "repair_text": "SELECT doc_id, text FROM documents",
        "repair_text_once": "SELECT doc_id, text FROM documents",
        "repair_text_compat": "SELECT doc_id, text FROM documents",
        "repair_text_clean_input": "SELECT doc_id, text FROM documents",
        "top_artists_all_scopes": wl + _top_all_scopes_sql(10),
        "top_free_songs_all_scopes": wl + _top_songs_all_scopes_sql("free"),
        "top_paid_songs_all_scopes": wl + _top_songs_all_scopes_sql("paid"),
        "subscription_breakdown_all_scopes": wl
            + f"SELECT {_SCOPE}, subscription, count, CAST(count AS DOUBLE) / "
              "CAST(sum(count) OVER (PARTITION BY g, state) AS DOUBLE) * 100.0 AS percentage "
              "FROM (SELECT state, subscription, count(*) AS count, grouping(state) AS g "
              "FROM L GROUP BY GROUPING SETS ((subscription), (state, subscription)))",
        "kpis_all_scopes": wl + _KPIS_ALL_SCOPES_SQL,
        "monthly_listening_all_scopes": wl + _MONTHLY_ALL_SCOPES_SQL,
    }
    sql["relabeled_listens_split"] = sql["relabeled_listens"]
    sql["relabeled_listens_filtered"] = sql["relabeled_listens"]
    sql["repair_text_three_layers"] = sql["repair_text"]
    sql["listen_feed"] = sql["clean_events"]
    sql["clean_events_damaged"] = sql["clean_events"].replace(
        "song, artist,", f"song || '{tv.ACCENT}' AS song, artist || '{tv.ACCENT}' AS artist,", 1)
    sql["clean_by_dictionary"] = sql["clean_events_damaged"]
    # the incremental paths must give exactly the direct results
    sql["kpis_all_scopes_from_fold"] = sql["kpis_all_scopes"]
    sql["top_artists_all_scopes_from_counts"] = sql["top_artists_all_scopes"]
    return sql
