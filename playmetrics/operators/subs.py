"""Free-versus-paid breakdown."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import percent_label
from .scope import in_scope


def subscription_breakdown(df: DataFrame, state: str | None = None) -> DataFrame:
    """Rows per subscription level in a scope, most first, with its share.

    ``percentage = count / total * 100`` (divide first, as the dashboard did).
    The share window runs over the aggregated table, one row per level, so its
    single partition holds a handful of rows. An empty scope gives no rows.
    """
    counts = (in_scope(df, state).groupBy("subscription")
              .agg(F.count(F.lit(1)).alias("count")))
    total = F.sum("count").over(Window.partitionBy())
    return (counts.withColumn("percentage",
                              F.col("count").cast("double") / total.cast("double") * F.lit(100.0))
            .orderBy(F.desc("count"), F.asc("subscription")))


def breakdown_labels(breakdown: DataFrame) -> DataFrame:
    """Display table: ``Subscription`` and ``Percentage`` as ``'12.3%'``."""
    return breakdown.select(F.col("subscription").alias("Subscription"),
                            percent_label(F.col("percentage")).alias("Percentage"))
