"""US state dimension (S6, S7) as a small literal DataFrame.

The dimension is a `LocalRelation` of 51 or 57 rows, so the planner knows its
size without running anything and may broadcast it wherever it is the build
side of a join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .schemas import US_STATES, US_TERRITORIES


def state_dim(spark: SparkSession, include_territories: bool = False,
              name_col: str = "NAME", code_col: str = "state") -> DataFrame:
    rows = US_STATES + (US_TERRITORIES if include_territories else [])
    return spark.createDataFrame(rows, f"{name_col} string, {code_col} string")
