"""The original query API by name, for callers switching over.

Each function keeps the old name and arguments and returns a Spark
DataFrame. Where the old function handed back a pandas frame or a Python
list, call ``.toPandas()`` / ``collect()`` on the (bounded) result; nothing
here collects. Semantics are the documented ones of the operators they call
(ties broken by name, NULL rules of SURVEY §1.3, columns of §2.11).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.text import repair_text
from .operators import artists, cleaning, distinct, geo, songs, subs, users
from .operators.scope import is_national
from .sources.dims import state_dim
from .sources.events import read_listen_events


def load_data(spark, path: str) -> DataFrame:
    """The listen feed at ``path`` (a folder or object-store URI of JSON lines),
    read by the executors with the fixed listen schema."""
    return read_listen_events(spark, path)


def get_artist_state_listen(df: DataFrame, artist: str) -> DataFrame:
    return artists.artist_by_state(df, artist)


get_artist_state = get_artist_state_listen


def get_artist_over(df: DataFrame, number_of_lis: int) -> DataFrame:
    """Names of the artists with at least ``number_of_lis`` listens, most first."""
    return artists.artists_over(df, number_of_lis).select("artist")


get_arist_over_1000 = get_artist_over
get_artist_over_1000 = get_artist_over


def map_prep_df(counts: DataFrame, dim: DataFrame | None = None) -> DataFrame:
    """State fill of an `artist_by_state` result; the artist is taken from the
    counts themselves (a scalar subquery), or left NULL when they are empty."""
    dim = dim if dim is not None else state_dim(counts.sparkSession)
    artist: Column = counts.agg(F.max("artist")).scalar()
    return geo.map_prep(counts, artist, dim)


def make_map_df(mapped: DataFrame, boundaries: DataFrame) -> DataFrame:
    return geo.attach_boundaries(boundaries, mapped)


def top_5(df: DataFrame) -> DataFrame:
    return artists.top_n(df, 5, "listens", "state" if "state" in df.columns else "artist")


def get_top_50(df: DataFrame, state: str) -> DataFrame:
    """Top-50 artist names in rank order (``artist_list`` gives them as one string)."""
    return artists.top_artists(df, state, 50).select("artist")


def get_top_100(df: DataFrame, state: str) -> DataFrame:
    """``Artist, Total Streams`` of the 100 most streamed artists of a scope."""
    return artists.top_artists_display(df, state, 100)


def calculate_kpis(df: DataFrame) -> DataFrame:
    return users.kpis(df)


def get_user_list(df: DataFrame, state: str) -> DataFrame:
    return users.monthly_listening(df, state)


def get_top_10_artists(df: DataFrame, state: str) -> DataFrame:
    return artists.top_artists_display(df, state, 10)


def create_subscription_pie_chart(df: DataFrame, state: str) -> DataFrame:
    return subs.subscription_breakdown(df, state).select("subscription", "count")


def clean(df: DataFrame) -> DataFrame:
    return cleaning.clean(df, repair_mode="compat")


def get_states_list(df: DataFrame) -> DataFrame:
    return distinct.states_list(df)


def fix_multiple_encoding(col: Column | str) -> Column:
    """Column expression with the legacy repair rule (no Python UDF)."""
    return repair_text(col, mode="compat")


def _with_state(top: DataFrame, state: str) -> DataFrame:
    """``state, song, listens`` for one state, ``song, listens`` for the nation."""
    return top if is_national(state) else top.select(F.lit(state).alias("state"), *top.columns)


def top_free_songs(df: DataFrame, state: str) -> DataFrame:
    return _with_state(songs.top_free_songs(df, state), state)


def top_paid_songs(df: DataFrame, state: str) -> DataFrame:
    return _with_state(songs.top_paid_songs(df, state), state)
