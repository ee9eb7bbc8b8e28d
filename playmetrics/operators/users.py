"""Users: headline KPIs, ever-paid relabelling, monthly listening.

Scale notes
-----------
* ``kpis`` is one aggregate (one job) instead of three. The distinct count is
  planned as partial aggregation keyed by ``userId`` before the shuffle, so a
  user holding a third of all rows still reaches the exchange as one row per
  task.
* ``monthly_listening`` never joins raw rows on ``userId``. It first folds
  rows to one per (user[, state], month, level) with a map-side combine, then
  finds each user's ever-paid flag with a window over that folded table, whose
  rows per user are bounded by months x states x levels however hot the user.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import count_label
from .distinct import distinct_count_with_null
from .lookup import attach
from .membership import WORDS, bloom_words, with_membership
from .scope import in_scope, is_national

PAID = "paid"


def kpis(df: DataFrame, state: str | None = None) -> DataFrame:
    """One row: ``total_users`` (distinct ids, NULL counted as one), mean
    ``avg_duration`` over all rows, ``paid_duration`` summed over paid rows."""
    scoped = in_scope(df, state)
    return scoped.agg(
        distinct_count_with_null("userId").alias("total_users"),
        F.avg("duration").alias("avg_duration"),
        F.sum(F.when(F.col("subscription") == F.lit(PAID), F.col("duration")))
        .alias("paid_duration"),
    )


def kpi_labels(kpi_df: DataFrame) -> DataFrame:
    """Dashboard tile texts from a `kpis` row (P10): thousands of users,
    minutes of average listening, thousands of paid hours."""
    return kpi_df.select(
        count_label(F.col("total_users"), 1000, "k+").alias("users_label"),
        count_label(F.col("avg_duration"), 60, " MIN").alias("avg_label"),
        count_label(F.col("paid_duration"), 3_600_000, "k+ H").alias("paid_label"),
    )


def ever_paid_users(df: DataFrame) -> DataFrame:
    """Distinct non-NULL ``userId`` with at least one paid row."""
    return (df.where((F.col("subscription") == F.lit(PAID)) & F.col("userId").isNotNull())
            .select("userId").distinct())


def relabel_ever_paid(df: DataFrame, max_hot_users: int = 100_000,
                      salt_buckets: int | None = None) -> DataFrame:
    """Every row of a user who ever paid becomes ``paid`` (J4 + P9), row level.

    NULL ids never match, as with ``isin``. Built for a user who holds a
    large share of all rows:

    1. one aggregate per user gives its row count and ever-paid flag (partial
       aggregation folds a hot user per task before the shuffle);
    2. users holding more than 1/``max_hot_users`` of all rows are *hot*;
       there are at most ``max_hot_users`` of them, so that table has a proven
       size bound and is broadcast, and their rows get their flag without
       moving;
    3. rows of hot users and rows without an id are spread over
       ``salt_buckets`` join keys (a hash of the whole row, so a recomputed
       task salts identically) that match nothing; only cold users, each with
       at most 1/``max_hot_users`` of the rows, are joined by ``userId``.
    """
    paid_flag = F.max(F.when(F.col("subscription") == F.lit(PAID), 1).otherwise(0))
    per_user = (df.groupBy("userId")
                .agg(F.count(F.lit(1)).alias("__n"), paid_flag.alias("__paid")))
    return _relabel_by(df, per_user, max_hot_users, salt_buckets)


def _relabel_by(df: DataFrame, per_user: DataFrame, max_hot_users: int,
                salt_buckets: int | None) -> DataFrame:
    """``df`` relabelled by ``per_user``: (userId, rows of ``df`` __n, flag __paid)."""
    flagged = attach(df, per_user, "userId", "__paid", max_hot_users, salt_buckets)
    ever_paid = F.coalesce(F.col("__paid") == 1, F.lit(False))
    return flagged.select(*[
        F.when(ever_paid, F.lit(PAID)).otherwise(F.col(c)).alias(c)
        if c == "subscription" else F.col(c)
        for c in df.columns
    ])


def _with_open(df: DataFrame, words: int) -> DataFrame:
    """``df`` and ``__open``: True on the rows that only a join can settle, those not paid yet
    of a user who may have paid."""
    paid = df.where(F.col("subscription") == F.lit(PAID))
    tested = with_membership(df, bloom_words(paid, "userId", words), "userId", "__may", words)
    open_ = F.col("__may") & ~F.col("subscription").eqNullSafe(F.lit(PAID))
    return tested.withColumn("__open", open_).drop("__may")


def relabel_ever_paid_filtered(df: DataFrame, max_hot_users: int = 100_000,
                               salt_buckets: int | None = None, words: int = WORDS) -> DataFrame:
    """`relabel_ever_paid`, moving only rows whose label can change.

    A Bloom filter of the users with a paid row is tested in the scan. Rows that are paid
    already, have no id, or fail the test keep their label where they are; only the others are
    counted per user and joined, hot users apart as in `relabel_ever_paid`. Reads ``df`` a few
    times to shuffle less of it; `rows_to_join` says how much less."""
    tested = _with_open(df, words)
    rest = tested.where("__open").drop("__open")
    counts = rest.groupBy("userId").agg(F.count(F.lit(1)).alias("__n"))
    per_user = counts.join(ever_paid_users(df).withColumn("__paid", F.lit(1)), "userId", "left").select(
        "userId", "__n", F.coalesce("__paid", F.lit(0)).alias("__paid"))
    return tested.where("NOT __open").drop("__open").unionByName(
        _relabel_by(rest, per_user, max_hot_users, salt_buckets))


def rows_to_join(df: DataFrame, words: int = WORDS) -> DataFrame:
    """One row: ``rows``, and ``joined``, those that `relabel_ever_paid_filtered` shuffles."""
    return _with_open(df, words).agg(F.count(F.lit(1)).alias("rows"),
                                     F.count(F.when(F.col("__open"), 1)).alias("joined"))


def _folded_with_ever_paid(df: DataFrame, *more_keys: str) -> DataFrame:
    """One row per (user[, more keys], year, month, level) with summed duration and
    the level relabelled to 'paid' for users who ever paid.

    ``month_name`` is a function of (year, month), so it stays out of the fold
    keys (smaller shuffle rows) and is derived again by the caller.
    """
    keys = ["userId", *more_keys, "year", "month", "subscription"]
    folded = df.groupBy(*keys).agg(F.sum("duration").alias("__dur"))
    paid_ever = F.max(F.when(F.col("subscription") == F.lit(PAID), 1).otherwise(0)) \
        .over(Window.partitionBy("userId"))
    return folded.withColumn(
        "subscription",
        F.when(F.col("userId").isNotNull() & (paid_ever == 1), F.lit(PAID))
        .otherwise(F.col("subscription")))


def month_name_of(year: str = "year", month: str = "month") -> "F.Column":
    """Full English month name from INT year and month columns."""
    return F.date_format(F.make_date(F.col(year), F.col(month), F.lit(1)), "MMMM")


def monthly_listening(df: DataFrame, state: str | None = None) -> DataFrame:
    """Minutes listened per month and level, users who ever paid counted as
    paid in every month (A11).

    The paid set is national and all-time even when a state is chosen: the
    relabel happens before the state filter, as in the original query.
    Columns ``year, month, month_name, subscription, total_duration``.
    """
    if is_national(state):
        relabeled = _folded_with_ever_paid(df)
    else:
        # rows out of scope only say whether their user ever paid: without a month they
        # fold to one row per (user, level), and the state is no fold key
        inside = F.coalesce(F.col("state") == F.lit(state), F.lit(False))
        flagged = df.select(
            "userId", "subscription", inside.alias("__in"),
            *[F.when(inside, F.col(c)).alias(c) for c in ("year", "month", "duration")])
        relabeled = _folded_with_ever_paid(flagged, "__in").where("__in")
    return (relabeled
            .groupBy("year", "month", "subscription")
            .agg((F.sum("__dur") / F.lit(60.0)).alias("total_duration"))
            .select("year", "month", month_name_of().alias("month_name"), "subscription",
                    "total_duration")
            .orderBy("year", "month", "subscription"))


def user_rows(df: DataFrame, user_id, col: str = "userId") -> DataFrame:
    """All rows of one user (F4 point lookup); a pushed-down equality filter."""
    return df.where(F.col(col) == F.lit(user_id))
