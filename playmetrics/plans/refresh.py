"""When a stored tile is stale: an input fingerprint per month beside it.

A memo with a time limit is either stale or recomputed for nothing. Here the additive tables
behind the tiles (`listen_counts`, `user_month_fold`) are kept by month, each month with a
fingerprint of the rows it was folded from: their count, and the sum and exclusive or of their
hashes, which no order or partitioning changes. A refresh takes the fingerprints in one
aggregate, folds only the months whose fingerprint differs (late files in an old month, a month
that is new), forgets months that are gone, and commits the list of months last. Rows without
a timestamp are a month of their own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.commits import committed, next_name
from .materialize import _require_dir, tiles_of
from .rollups import listen_counts, user_month_fold

MONTH = ["year", "month"]
STATE = ("year int, month int, n bigint, hash_sum decimal(38,0), hash_xor bigint, version string")


def fingerprints(listens: DataFrame) -> DataFrame:
    """(year, month, n, hash_sum, hash_xor), a row a month."""
    h = F.xxhash64(*listens.columns)
    return listens.groupBy(*MONTH).agg(
        F.count(F.lit(1)).alias("n"), F.sum(h.cast("decimal(20,0)")).cast("decimal(38,0)").alias("hash_sum"),
        F.bit_xor(h).alias("hash_xor"))


def _in_months(months: list[tuple]):
    """A filter on the partition columns, year by year, that a folder scan can prune with."""
    by_year: dict = {}
    for y, m in months:
        by_year.setdefault(y, []).append(m)
    terms = []
    for y, ms in by_year.items():
        year = F.col("year").isNull() if y is None else F.col("year") == y
        known = [m for m in ms if m is not None]
        month = F.col("month").isin(known) if known else F.lit(False)
        terms.append(year & (month | F.col("month").isNull() if None in ms else month))
    return reduce(lambda a, b: a | b, terms)


def _base(spark: SparkSession, name: str) -> str:
    return f"{_require_dir(spark)}/playmetrics/{name}-fresh"


def _state(spark: SparkSession, base: str) -> DataFrame:
    done = committed(spark, f"{base}/state")
    return (spark.read.schema(STATE).parquet(f"{base}/state/{done[-1]}") if done
            else spark.createDataFrame([], STATE))


def refresh_parts(listens: DataFrame, name: str = "dashboard") -> list[tuple]:
    """Bring the parts of ``name`` up to ``listens``; the months that were folded."""
    spark = listens.sparkSession
    base = _base(spark, name)
    last = {(r["year"], r["month"]): r for r in _state(spark, base).collect()}  # a row a month
    now = {(r["year"], r["month"]): r for r in fingerprints(listens).collect()}
    mark = lambda r: (r["n"], r["hash_sum"], r["hash_xor"])
    stale = [m for m in now if m not in last or mark(now[m]) != mark(last[m])]
    if not stale and now.keys() == last.keys():
        return []
    version = next_name(spark, f"{base}/state")
    if stale:
        rows = listens.where(_in_months(stale))
        for table, part in ((listen_counts(rows), "counts"), (user_month_fold(rows), "fold")):
            table.write.parquet(f"{base}/{part}/{version}")
    state = [(*m, *mark(r), version if m in stale else last[m]["version"]) for m, r in now.items()]
    spark.createDataFrame(state, STATE).coalesce(1).write.parquet(f"{base}/state/{version}")
    return sorted(stale, key=lambda m: tuple((x is not None, x or 0) for x in m))


def fresh_parts(spark: SparkSession, name: str = "dashboard") -> dict[str, DataFrame]:
    """{counts, fold}: the additive tables of the last refresh, for the all-scope functions."""
    base = _base(spark, name)
    state = _state(spark, base).select(*[F.col(c).alias(f"__{c}") for c in (*MONTH, "version")])
    versions = [r[0] for r in state.select("__version").distinct().collect()]
    if not versions:
        raise ValueError(f"{name} holds no listens: refresh it first")
    out = {}
    for part in ("counts", "fold"):
        rows = spark.read.parquet(*[f"{base}/{part}/{v}" for v in sorted(versions)])
        of = F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)/[^/]+$", 1)
        rows = rows.withColumn("__of", of)
        # a row a month: the version that holds it
        same = ((F.col("__of") == F.col("__version")) & F.col("year").eqNullSafe(F.col("__year"))
                & F.col("month").eqNullSafe(F.col("__month")))
        out[part] = rows.join(F.broadcast(state), same, "left_semi").drop("__of")
    return out


def fresh_tiles(spark: SparkSession, name: str = "dashboard", n_artists: int = 10,
                n_songs: int = 5) -> dict[str, DataFrame]:
    """Every all-scope tile from the parts of the last refresh; the events are not read."""
    parts = fresh_parts(spark, name)
    return tiles_of(parts["counts"], parts["fold"], n_artists, n_songs)
