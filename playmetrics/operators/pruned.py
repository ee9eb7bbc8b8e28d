"""Top-N without shuffling every name.

Counting all names to keep ten of them moves a row a name and task. Here a first pass counts
rows by a hash bucket of the name, at most ``buckets`` rows a task: a bucket's count is an upper
bound for each of its names. The names of the fullest buckets are counted exactly; the n-th
largest of those counts is a bar that the result's n-th is not below. Buckets under the bar
hold no name of the result, and only the names of the others are counted. Where the bound does
not separate, because many names are about as frequent, all buckets stay and the result is the
plain exact one, at the price of the first pass.

The result is exact either way, ties by name included. What is broadcast is bounded: bucket
numbers, ``buckets`` at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .artists import LISTENS, top_n
from .scope import in_scope

BUCKETS = 1 << 16


def _measure(weight: str | None):
    return F.count(F.lit(1)) if weight is None else F.sum(weight).cast("long")


def _steps(df: DataFrame, name: str, n: int, weight: str | None, buckets: int, first: int | None):
    """(rows, exact counts of the fullest buckets, buckets to count besides, all buckets)."""
    rows = df.select(name, *([weight] if weight else [])).withColumn(
        "__bucket", F.pmod(F.xxhash64(name), F.lit(buckets)).cast("int"))
    sizes = rows.groupBy("__bucket").agg(_measure(weight).alias("__size"))
    fullest = sizes.orderBy(F.desc("__size"), "__bucket").limit(
        first or max(4 * n, 1024)).select("__bucket")
    counted = _counted(rows, fullest, name, weight)
    bar = counted.orderBy(F.desc(LISTENS)).limit(n).agg(
        F.when(F.count(F.lit(1)) == n, F.min(LISTENS)).otherwise(F.lit(0)).alias("bar")).scalar()
    others = sizes.where(F.col("__size") >= bar).join(
        F.broadcast(fullest), "__bucket", "left_anti").select("__bucket")
    return rows, counted, others, sizes, fullest


def _counted(rows: DataFrame, kept: DataFrame, name: str, weight: str | None) -> DataFrame:
    return (rows.join(F.broadcast(kept), "__bucket", "left_semi")
            .groupBy(name).agg(_measure(weight).alias(LISTENS)))


def top_pruned(df: DataFrame, name: str, n: int, weight: str | None = None,
               buckets: int = BUCKETS, first: int | None = None) -> DataFrame:
    """(``name``, listens): the ``n`` most frequent, ties by name; NULL is a name.

    ``weight``: a column of counts, none negative, to sum in place of rows. ``first``: how many
    of the fullest buckets set the bar. If they settle it, adaptive execution finds nothing
    left to count and leaves the last pass out."""
    rows, counted, others, _, _ = _steps(df, name, n, weight, buckets, first)
    return top_n(counted.unionByName(_counted(rows, others, name, weight)), n, LISTENS, name)


def top_artists_pruned(df: DataFrame, state: str | None = None, n: int = 10, **how) -> DataFrame:
    """`top_artists` by `top_pruned`: the same rows."""
    return top_pruned(in_scope(df, state), "artist", n, **how)


def pruned_share(df: DataFrame, name: str, n: int, weight: str | None = None,
                 buckets: int = BUCKETS, first: int | None = None) -> DataFrame:
    """One row: ``rows`` seen (weights summed), ``left_out`` of them never counted by name."""
    _, _, others, sizes, fullest = _steps(df, name, n, weight, buckets, first)
    kept = F.broadcast(fullest.unionByName(others).withColumn("__kept", F.lit(True)))
    return sizes.join(kept, "__bucket", "left").agg(
        F.sum("__size").alias("rows"),
        F.coalesce(F.sum(F.when(F.col("__kept").isNull(), F.col("__size"))), F.lit(0)).alias("left_out"))
