"""Top songs by subscription level and scope."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scope import in_scope

LISTENS = "listens"


def top_songs(df: DataFrame, level: str, state: str | None = None, n: int = 5) -> DataFrame:
    """The ``n`` most played songs among ``level`` ('free' / 'paid') listens.

    Filters (level, state) go below the aggregate and reach the scan. The top
    ``n`` are picked by listens descending, song ascending, and returned in
    display order: fewest listens first. Columns ``song, listens`` in every
    scope.
    """
    scoped = in_scope(df.where(F.col("subscription") == F.lit(level)), state)
    top = (scoped.groupBy("song").agg(F.count(F.lit(1)).alias(LISTENS))
           .orderBy(F.desc(LISTENS), F.asc("song")).limit(n))
    return top.orderBy(F.asc(LISTENS), F.desc("song"))


def top_free_songs(df: DataFrame, state: str | None = None, n: int = 5) -> DataFrame:
    return top_songs(df, "free", state, n)


def top_paid_songs(df: DataFrame, state: str | None = None, n: int = 5) -> DataFrame:
    return top_songs(df, "paid", state, n)


def state_songs(df: DataFrame, state: str) -> DataFrame:
    """Listens per (state, song) for one state, most first."""
    return (df.where(F.col("state") == F.lit(state))
            .groupBy("state", "song").agg(F.count(F.lit(1)).alias(LISTENS))
            .orderBy(F.desc(LISTENS), F.asc("song")))
