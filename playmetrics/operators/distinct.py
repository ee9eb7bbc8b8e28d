"""Distinct values, distinct counts and row counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """Distinct values of one column, NULL included."""
    return df.select(col).distinct()


def distinct_count_with_null(col: str) -> Column:
    """``select(col).distinct().count()`` as one aggregate expression: NULL counts
    as one more value (D2, D4). 0 on empty input."""
    return (F.count_distinct(F.col(col))
            + F.coalesce(F.max(F.when(F.col(col).isNull(), 1).otherwise(0)), F.lit(0))
            ).cast("long")


def distinct_count(df: DataFrame, col: str, include_null: bool = False,
                   alias: str = "n") -> DataFrame:
    """Number of distinct values of ``col``: with NULL as a value (D2) or not (D3)."""
    expr = distinct_count_with_null(col) if include_null else F.count_distinct(F.col(col))
    return df.agg(expr.alias(alias))


def states_list(df: DataFrame, col: str = "state") -> DataFrame:
    """Distinct states, ascending, NULL first."""
    return df.select(col).distinct().orderBy(F.asc_nulls_first(col))


def row_count(df: DataFrame, alias: str = "n") -> DataFrame:
    """Number of rows (A12) as a one-row DataFrame."""
    return df.agg(F.count(F.lit(1)).alias(alias))
