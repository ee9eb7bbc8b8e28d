"""All-scope result tables: every state and the nation in one job.

A dashboard asks for one (tile, state) at a time; a precomputed table answers
every click with a lookup. Each function aggregates the listens once over
grouping sets ``(keys)`` and ``(state, keys)``; ``scope`` is the state, or
'Nationwide' for the national grouping (told apart from a NULL state by
``grouping(state)``).

Top-N per scope ranks in two stages: first within (scope, bucket of the name's
hash), then among the at most ``RANK_BUCKETS * n`` rows per scope that are left. So
no task receives a whole scope's names, whatever ``n`` is (Spark's own partial
limit before a ranking window stops working above a threshold of ``n``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.distinct import distinct_count_with_null
from ..operators.scope import NATIONWIDE
from ..operators.users import PAID, _folded_with_ever_paid, month_name_of

LISTENS = "listens"
_G = "__g_state"


def _scope() -> "F.Column":
    return F.when(F.col(_G) == 1, F.lit(NATIONWIDE)).otherwise(F.col("state"))


def _by_scope(df: DataFrame, keys: list[str], *aggs) -> DataFrame:
    return df.groupingSets([keys, ["state", *keys]], "state", *keys).agg(
        *aggs, F.grouping("state").alias(_G))


#: Buckets of names that are ranked on their own before a scope is.
RANK_BUCKETS = 64


def _top_per_scope(counted: DataFrame, name: str, n: int) -> DataFrame:
    bucket = F.pmod(F.xxhash64(name), F.lit(RANK_BUCKETS))
    first = Window.partitionBy(_G, "state", "__bucket").orderBy(F.desc(LISTENS), F.asc(name))
    counted = (counted.withColumn("__bucket", bucket)
               .withColumn("__rank", F.row_number().over(first))
               .where(F.col("__rank") <= F.lit(n)).drop("__bucket", "__rank"))
    w = Window.partitionBy(_G, "state").orderBy(F.desc(LISTENS), F.asc(name))
    return (counted.withColumn("rank", F.row_number().over(w))
            .where(F.col("rank") <= F.lit(n))
            .select(_scope().alias("scope"), "rank", name, LISTENS))


def _measure(weight: str | None) -> "F.Column":
    """Rows counted, or a count column of pre-aggregated input summed."""
    return F.count(F.lit(1)) if weight is None else F.sum(weight).cast("long")


def top_artists_all_scopes(df: DataFrame, n: int = 10, weight: str | None = None) -> DataFrame:
    """``scope, rank, artist, listens``: `top_artists` for every scope.

    ``weight`` names a count column when ``df`` is already aggregated (see
    `listen_counts`); the default counts rows."""
    counted = _by_scope(df, ["artist"], _measure(weight).alias(LISTENS))
    return _top_per_scope(counted, "artist", n)


def top_songs_all_scopes(df: DataFrame, level: str, n: int = 5,
                         weight: str | None = None) -> DataFrame:
    """``scope, rank, song, listens``: `top_songs` for every scope."""
    counted = _by_scope(df.where(F.col("subscription") == F.lit(level)), ["song"],
                        _measure(weight).alias(LISTENS))
    return _top_per_scope(counted, "song", n)


def subscription_breakdown_all_scopes(df: DataFrame, weight: str | None = None) -> DataFrame:
    """``scope, subscription, count, percentage`` for every scope."""
    counted = _by_scope(df, ["subscription"], _measure(weight).alias("count"))
    total = F.sum("count").over(Window.partitionBy(_G, "state"))
    return counted.select(
        _scope().alias("scope"), "subscription", "count",
        (F.col("count").cast("double") / total.cast("double") * F.lit(100.0))
        .alias("percentage"))


def listen_counts(df: DataFrame) -> DataFrame:
    """Listens per (year, month, state, artist, song, subscription): an additive
    table, far smaller than the events, from which the count-based tiles can
    be rebuilt. New months are appended (counts of different months never
    overlap), so refreshing those tiles never rescans the history; pass
    ``weight='listens'`` to the all-scope functions. KPIs and monthly
    listening have an additive table of their own, `user_month_fold`."""
    return (df.groupBy("year", "month", "state", "artist", "song", "subscription")
            .agg(F.count(F.lit(1)).alias(LISTENS)))


def user_month_fold(df: DataFrame) -> DataFrame:
    """Duration summed (and its non-NULL values counted) per (userId, state,
    year, month, subscription): the additive table behind the user-level
    tiles. Months never overlap, so new months are appended; rebuild with
    `kpis_all_scopes_from_fold` and `monthly_listening_all_scopes` (which
    accepts the fold as its input, since its first step is this same fold)."""
    return (df.groupBy("userId", "state", "year", "month", "subscription")
            .agg(F.sum("duration").alias("duration"),
                 F.count("duration").alias("n_duration")))


def kpis_all_scopes_from_fold(fold: DataFrame) -> DataFrame:
    """`kpis_all_scopes` computed from `user_month_fold` output: distinct users
    from the fold's ids, mean duration as summed duration over summed counts."""
    g = fold.groupingSets([[], ["state"]], "state").agg(
        distinct_count_with_null("userId").alias("total_users"),
        (F.sum("duration") / F.sum("n_duration")).alias("avg_duration"),
        F.sum(F.when(F.col("subscription") == F.lit(PAID), F.col("duration")))
        .alias("paid_duration"),
        F.grouping("state").alias(_G))
    return g.select(_scope().alias("scope"), "total_users", "avg_duration", "paid_duration")


def kpis_all_scopes(df: DataFrame) -> DataFrame:
    """``scope, total_users, avg_duration, paid_duration`` for every scope."""
    g = df.groupingSets([[], ["state"]], "state").agg(
        distinct_count_with_null("userId").alias("total_users"),
        F.avg("duration").alias("avg_duration"),
        F.sum(F.when(F.col("subscription") == F.lit(PAID), F.col("duration")))
        .alias("paid_duration"),
        F.grouping("state").alias(_G))
    return g.select(_scope().alias("scope"), "total_users", "avg_duration", "paid_duration")


def monthly_listening_all_scopes(df: DataFrame) -> DataFrame:
    """``scope`` plus `monthly_listening` columns for every scope; the
    ever-paid relabel is computed once, nationally."""
    folded = _folded_with_ever_paid(df, "state")
    g = _by_scope(folded, ["year", "month", "subscription"],
                  (F.sum("__dur") / F.lit(60.0)).alias("total_duration"))
    return g.select(_scope().alias("scope"), "year", "month",
                    month_name_of().alias("month_name"), "subscription", "total_duration")


def dashboard_tables(df: DataFrame, n_artists: int = 10, n_songs: int = 5) -> dict[str, DataFrame]:
    """Every all-scope table the dashboard reads, as lazy DataFrames over ``df``
    (the cleaned listen table; materialize it first so each table reads the
    written copy instead of recomputing it)."""
    return {
        "top_artists": top_artists_all_scopes(df, n_artists),
        "top_free_songs": top_songs_all_scopes(df, "free", n_songs),
        "top_paid_songs": top_songs_all_scopes(df, "paid", n_songs),
        "subscription_breakdown": subscription_breakdown_all_scopes(df),
        "kpis": kpis_all_scopes(df),
        "monthly_listening": monthly_listening_all_scopes(df),
    }
