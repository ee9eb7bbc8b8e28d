"""Time derivations.

Calendar parts use the session time zone; pin ``spark.sql.session.timeZone``
(UTC in our sessions) so a month boundary falls where the data says.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_millis_to_ts(c: Column | str) -> Column:
    """Epoch milliseconds to TIMESTAMP, exactly (no division through a double)."""
    col = F.col(c) if isinstance(c, str) else c
    return F.timestamp_millis(col.cast("long"))


EPOCH_NTZ = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def epoch_millis_to_local(c: Column | str, time_zone: str) -> Column:
    """Epoch milliseconds to the wall-clock TIMESTAMP_NTZ of ``time_zone``.

    Unlike `epoch_millis_to_ts`, the result and any calendar part taken from
    it do not depend on the session time zone.
    """
    col = F.col(c) if isinstance(c, str) else c
    utc = F.timestamp_add("MILLISECOND", col.cast("long"), F.expr(EPOCH_NTZ))
    if time_zone.upper() in ("UTC", "Z", "+00:00"):
        return utc
    return F.convert_timezone(F.lit("UTC"), F.lit(time_zone), utc)


def ntz_to_epoch_millis(c: Column | str) -> Column:
    """Wall-clock TIMESTAMP_NTZ read as UTC, to epoch milliseconds (zone-free)."""
    col = F.col(c) if isinstance(c, str) else c
    return F.timestamp_diff("MILLISECOND", F.expr(EPOCH_NTZ), col)


def calendar_columns(ts: Column | str) -> dict[str, Column]:
    """``year`` and ``month`` as INT, ``month_name`` as the full English name."""
    col = F.col(ts) if isinstance(ts, str) else ts
    return {
        "year": F.year(col),
        "month": F.month(col),
        "month_name": F.date_format(col, "MMMM"),
    }
