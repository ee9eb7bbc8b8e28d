"""Projections, cleaning and null audits of raw event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import repair_text
from ..functions.time import calendar_columns, epoch_millis_to_local, epoch_millis_to_ts
from ..sources.schemas import AUTH_COLUMNS, LISTEN_COLUMNS


def auth_view(df: DataFrame) -> DataFrame:
    """The 16 auth-event columns."""
    return df.select(*AUTH_COLUMNS)


def listen_view(df: DataFrame, level_as: str = "subscription") -> DataFrame:
    """The 19 listen columns with ``level`` renamed."""
    return df.select(*[F.col(c).alias(level_as) if c == "level" else F.col(c)
                       for c in LISTEN_COLUMNS])


def with_calendar(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Add ``year``, ``month``, ``month_name`` from a TIMESTAMP column."""
    return df.withColumns(calendar_columns(ts))


def clean(df: DataFrame, repair_mode: str = "intended",
          time_zone: str | None = None) -> DataFrame:
    """Raw listen events to the cleaned listen table.

    Repairs ``artist`` and ``song`` text, keeps the 19 listen columns with
    ``level`` as ``subscription``, turns epoch-ms ``ts`` into a timestamp and
    adds the calendar columns (``repair_mode='none'``: names are repaired already). With
    ``time_zone=None`` ``ts`` is a TIMESTAMP
    and the calendar follows the session time zone (pin it); with a zone name
    ``ts`` is that zone's wall-clock TIMESTAMP_NTZ and the calendar no longer
    depends on the session. One projection, all native expressions, so
    filters on untouched columns still reach the scan and unused columns are
    pruned. Persist or `materialize` the result when several queries share it.
    """
    cols = []
    for c in LISTEN_COLUMNS:
        if c in ("artist", "song"):
            cols.append(F.col(c) if repair_mode == "none"
                        else repair_text(F.col(c), repair_mode).alias(c))
        elif c == "level":
            cols.append(F.col(c).alias("subscription"))
        elif c == "ts":
            ts = (epoch_millis_to_ts(F.col(c)) if time_zone is None
                  else epoch_millis_to_local(F.col(c), time_zone))
            cols.append(ts.alias(c))
        else:
            cols.append(F.col(c))
    return with_calendar(df.select(*cols))


def _damaged(value: str) -> str:
    return value.encode("utf-8").decode("latin-1")


def where_clean_equals(raw: DataFrame, col: str, value: str,
                       repair_mode: str = "intended") -> DataFrame:
    """Rows of a raw table whose repaired ``col`` equals ``value`` (F4 on raw data).

    A filter on the repaired column cannot reach the scan, so a lookup such as
    ``artist_by_state(clean(raw), 'X')`` would read and repair every row. Any
    raw string that repairs to ``X`` is ``X`` itself or ``X`` damaged once or
    twice, so those three literals form a necessary ``IN`` filter on the raw
    column, which parquet pushes into the scan (row groups skipped by their
    statistics and dictionaries); the exact check on the repaired value stays
    on top. A compat-mode value holding U+FFFD has no finite set of sources
    and gets the exact check only.
    """
    exact = repair_text(F.col(col), repair_mode) == F.lit(value)
    if repair_mode == "compat" and "\ufffd" in value:
        return raw.where(exact)
    candidates = sorted({value, _damaged(value), _damaged(_damaged(value))})
    return raw.where(F.col(col).isin(*candidates) & exact)


def null_user_rows(df: DataFrame, user: str = "userId") -> DataFrame:
    """Rows without a user id (F1)."""
    return df.where(F.col(user).isNull())


def drop_null_users(df: DataFrame, user: str = "userId") -> DataFrame:
    """Rows with a user id (F2)."""
    return df.where(F.col(user).isNotNull())


def null_level_rows(df: DataFrame, level: str = "level", user: str = "userId") -> DataFrame:
    """Rows with a user id but no level."""
    return df.where(F.col(level).isNull() & F.col(user).isNotNull())


def null_audit(df: DataFrame, user: str = "userId", level: str = "level") -> DataFrame:
    """F1-F3 as counts, in one aggregate: rows without a user, rows with one,
    and rows with a user but no level."""
    u, lv = F.col(user), F.col(level)
    return df.agg(
        F.count(F.when(u.isNull(), 1)).alias("null_user_rows"),
        F.count(F.when(u.isNotNull(), 1)).alias("user_rows"),
        F.count(F.when(u.isNotNull() & lv.isNull(), 1)).alias("null_level_rows"),
    )


def complete_rows(df: DataFrame) -> DataFrame:
    """Rows with no NULL in any column."""
    return df.na.drop(how="any")
