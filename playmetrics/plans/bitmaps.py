"""Distinct users of any scope from small mergeable rows.

A distinct count cannot be added up: the users of two months overlap, so every new scope is
another scan. Here each user gets a dense number once, and a cell (state, year, month) keeps
its users as bitmaps of 32,768 numbers each. The distinct users of any set of cells are the OR
of their bitmaps, bucket by bucket, then counted; nothing but bitmaps is read. Numbers grow
with the users: known ones stay, new ones come after, so bitmaps of old months stay valid and
those of new months are appended.

A NULL id is number 0, alone in bucket 0, so counts with and without it are one filter apart.

Scale: a hot user is one row per cell and task before any shuffle; numbering is a range
partitioning with an offset a partition, no global window; a bitmap is 4 KB, and the OR of a
bucket meets in partial aggregates, a row a bucket and task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.scope import NATIONWIDE
from ..operators.users import PAID
from .materialize import materialize

CELL = ("state", "year", "month")


def number_values(df: DataFrame, col: str = "userId", known: DataFrame | None = None) -> DataFrame:
    """(``col``, number): the distinct non-NULL values, numbered without gaps from 1.

    ``known``: such a table from before; its numbers stay and new values go on after them.
    """
    values = df.select(col).where(F.col(col).isNotNull()).distinct()
    if known is not None:
        values = values.join(known, col, "left_anti")
    # written, so that a value's partition is fixed before it counts
    dealt = materialize(values.repartitionByRange(col).withColumn(
        "__part", F.spark_partition_id()), "numbers-dealt")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("__n")).select(
        "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    rank = F.row_number().over(Window.partitionBy("__part").orderBy(col))
    last = F.lit(0) if known is None else F.coalesce(known.agg(F.max("number")).scalar(), F.lit(0))
    new = dealt.join(starts, "__part").select(
        col, (last + F.col("__start") + rank).cast("long").alias("number"))
    return materialize(new if known is None else known.select(col, "number").unionByName(new),
                       "numbers")


def user_bitmaps(df: DataFrame, numbers: DataFrame, by: tuple[str, ...] = CELL,
                 col: str = "userId") -> DataFrame:
    """(``by``, bucket, bits): the users of each cell; an id without a number is an error."""
    seen = df.select(col, *by).distinct()
    missing = F.raise_error(F.concat(F.lit("no number for id "), F.col(col).cast("string")))
    number = F.when(F.col(col).isNull(), F.lit(0)).otherwise(
        F.coalesce(F.col("number"), missing.cast("long"))).cast("long")
    return (seen.join(numbers, col, "left")
            .select(*by, number.alias("__no"))
            .groupBy(*by, F.bitmap_bucket_number("__no").alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("__no")).alias("bits")))


def users_by(bitmaps: DataFrame, by: tuple[str, ...] = (), include_null: bool = True,
             alias: str = "n_users") -> DataFrame:
    """(``by``, n_users): distinct users of the cells of each group; filter ``bitmaps`` for a scope.

    ``include_null``: whether rows without an id count as one user (D4) or not (D3)."""
    counted = bitmaps.groupBy(*by, "bucket").agg(
        F.bitmap_count(F.bitmap_or_agg("bits")).alias("__n"))
    if not include_null:
        # a group with NULL ids only keeps its row
        counted = counted.withColumn("__n", F.when(F.col("bucket") == 0, 0).otherwise(F.col("__n")))
    return counted.groupBy(*by).agg(F.coalesce(F.sum("__n"), F.lit(0)).cast("long").alias(alias))


def listen_sums(df: DataFrame, by: tuple[str, ...] = CELL) -> DataFrame:
    """(``by``, duration, n_duration, paid_duration): what adds up of the KPIs."""
    paid = F.when(F.col("subscription") == F.lit(PAID), F.col("duration"))
    return df.groupBy(*by).agg(F.sum("duration").alias("duration"),
                               F.count("duration").alias("n_duration"),
                               F.sum(paid).alias("paid_duration"))


def kpis_all_scopes_from_bitmaps(bitmaps: DataFrame, sums: DataFrame) -> DataFrame:
    """`kpis_all_scopes` from `user_bitmaps` and `listen_sums`; the events are not read."""
    g = "__g"
    ored = bitmaps.groupingSets([["bucket"], ["state", "bucket"]], "state", "bucket").agg(
        F.bitmap_count(F.bitmap_or_agg("bits")).alias("__n"), F.grouping("state").alias(g))
    users = ored.groupBy(F.col(g).alias("__gu"), F.col("state").alias("__su")).agg(
        F.sum("__n").alias("__users"))
    totals = sums.groupingSets([[], ["state"]], "state").agg(
        (F.sum("duration") / F.sum("n_duration")).alias("avg_duration"),
        F.sum("paid_duration").alias("paid_duration"), F.grouping("state").alias(g))
    same = (F.col(g) == F.col("__gu")) & F.col("state").eqNullSafe(F.col("__su"))
    scope = F.when(F.col(g) == 1, F.lit(NATIONWIDE)).otherwise(F.col("state"))
    return totals.join(users, same, "left").select(
        scope.alias("scope"), F.coalesce("__users", F.lit(0)).cast("long").alias("total_users"),
        "avg_duration", "paid_duration")
