"""Artist listens: by state, over a threshold, top-N, picks.

Every count is a hash aggregate with a map-side partial step, so a hot artist
is folded to one row per task before the shuffle. Top-N is ``orderBy.limit``,
which plans as a per-task top-N plus a merge of at most N x tasks rows, never
a global sort. Ties are broken by the name, ascending, so results are stable.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scope import in_scope

LISTENS = "listens"


def _listens() -> "F.Column":
    return F.count(F.lit(1)).alias(LISTENS)


def artist_state_listens(df: DataFrame) -> DataFrame:
    """Listens per (artist, state), every artist (A1); ordered by artist, descending."""
    return (df.groupBy("artist", "state").agg(_listens())
            .orderBy(F.desc("artist"), F.desc(LISTENS), F.asc("state")))


def artist_by_state(df: DataFrame, artist: str) -> DataFrame:
    """Listens per state for one artist, most first (A2).

    The artist filter is applied before grouping (the answer is the same), so
    it reaches the scan as a pushed filter.
    """
    return (df.where(F.col("artist") == F.lit(artist))
            .groupBy("artist", "state").agg(_listens())
            .orderBy(F.desc(LISTENS), F.asc("state")))


def artist_totals(df: DataFrame, state: str | None = None) -> DataFrame:
    """Listens per artist within a scope (NULL artist is a group of its own)."""
    return in_scope(df, state).groupBy("artist").agg(_listens())


def artists_over(df: DataFrame, threshold: int) -> DataFrame:
    """Artists with at least ``threshold`` listens over all rows."""
    return (artist_totals(df).where(F.col(LISTENS) >= F.lit(threshold))
            .orderBy(F.desc(LISTENS), F.asc("artist")))


def artists_over_count(df: DataFrame, threshold: int) -> DataFrame:
    """How many artists reach the threshold (A13), one row ``n_artists``."""
    return (artist_totals(df).where(F.col(LISTENS) >= F.lit(threshold))
            .agg(F.count(F.lit(1)).alias("n_artists")))


def top_n(df: DataFrame, n: int, measure: str, tie: str) -> DataFrame:
    """The ``n`` rows with the largest ``measure``, ties by ``tie``."""
    return df.orderBy(F.desc(measure), F.asc(tie)).limit(n)


def top_artists(df: DataFrame, state: str | None = None, n: int = 10) -> DataFrame:
    """Top ``n`` artists by listens in a scope (A4 with n=10, A5 with n=50)."""
    return top_n(artist_totals(df, state), n, LISTENS, "artist")


def top_artists_display(df: DataFrame, state: str | None = None, n: int = 10) -> DataFrame:
    """`top_artists` under the dashboard's column names ``Artist``, ``Total Streams``."""
    return top_artists(df, state, n).select(F.col("artist").alias("Artist"),
                                            F.col(LISTENS).alias("Total Streams"))


def top_artist_at(df: DataFrame, position: int, state: str | None = None,
                  n: int = 10) -> DataFrame:
    """Row ``position`` (1-based) of the top-``n`` table (O8): a click on a row.

    The ranking window runs after the limit, over at most ``n`` rows.
    """
    ranked = top_artists(df, state, n).withColumn(
        "rank", F.row_number().over(Window.orderBy(F.desc(LISTENS), F.asc("artist"))))
    return ranked.where(F.col("rank") == F.lit(position)).select("rank", "artist", LISTENS)


def artist_list(df: DataFrame, state: str | None = None, n: int = 50,
                sep: str = ", ") -> DataFrame:
    """Top-``n`` artist names in rank order joined into one string.

    The string is built after the limit, from at most ``n`` rows.
    """
    quoted = "'" + sep.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return top_artists(df, state, n).agg(
        F.expr(f"listagg(artist, {quoted}) WITHIN GROUP "
               f"(ORDER BY {LISTENS} DESC, artist ASC)").alias("artists"))
