"""State scope (F5): ``None`` or ``'Nationwide'`` mean every row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NATIONWIDE = "Nationwide"


def is_national(state: str | None) -> bool:
    return state is None or state == NATIONWIDE


def in_scope(df: DataFrame, state: str | None = None, col: str = "state") -> DataFrame:
    """Rows of one state, or all rows. The filter reaches the scan when it can."""
    if is_national(state):
        return df
    return df.where(F.col(col) == F.lit(state))
