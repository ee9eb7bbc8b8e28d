"""Cutting lineage for tables several queries share.

The cleaned listen table feeds every tile. Recomputing it per tile re-reads
and re-repairs the raw events; caching only the handle (what a UI memo does)
saves nothing. Here it is written once, as parquet, under the shared folder
the cluster names in ``spark.checkpoint.dir``, and read back: the copy
survives lost executors, and later scans get column pruning, pushed filters
and (with ``partition_by``) partition pruning.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The session's checkpoint folder (``spark.checkpoint.dir`` or
    ``SparkContext.setCheckpointDir``), or None when neither is set."""
    try:
        d = spark.sparkContext.getCheckpointDir()
    except Exception:  # no SparkContext on the client (Spark Connect)
        d = None
    return d or spark.conf.get("spark.checkpoint.dir", None) or None


def _require_dir(spark: SparkSession) -> str:
    d = checkpoint_dir(spark)
    if not d:
        raise RuntimeError(
            "no checkpoint folder: set spark.checkpoint.dir to a shared location "
            "(HDFS, object store) before materializing")
    return d.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder of this application under the checkpoint folder; see `drop_scratch`."""
    app = spark.sparkContext.applicationId
    return f"{_require_dir(spark)}/playmetrics/{app}/{name}-{uuid.uuid4().hex}"


def drop_scratch(spark: SparkSession) -> bool:
    """Delete everything this application has materialized, for its end: tables read back from
    there are gone after it. Other applications' folders and tile parts stay."""
    path = spark._jvm.org.apache.hadoop.fs.Path(
        f"{_require_dir(spark)}/playmetrics/{spark.sparkContext.applicationId}")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as parquet under the checkpoint folder and read it back.

    With ``partition_by`` rows are first brought together by those columns (large groups are
    split, small ones joined), so there are about as many files as groups, not tasks x groups."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.parquet(path)


def reliable_checkpoint(df: DataFrame, eager: bool = True) -> DataFrame:
    """``df.checkpoint()`` into the shared folder (never a local checkpoint)."""
    _require_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def materialize_dashboard(clean_df: DataFrame, name: str = "dashboard",
                          n_artists: int = 10, n_songs: int = 5) -> dict[str, DataFrame]:
    """Write the cleaned table (partitioned by year and month) and every
    all-scope table under the checkpoint folder; return the written copies.
    A tile click then reads a small table instead of scanning the events."""
    from .rollups import dashboard_tables

    base = materialize(clean_df, f"{name}-listens", partition_by=["year", "month"])
    out = {"listens": base}
    for key, table in dashboard_tables(base, n_artists, n_songs).items():
        out[key] = materialize(table, f"{name}-{key}")
    return out


def _batch_of(listens: DataFrame) -> str:
    """A name from the rows without a month, the same whenever the same rows come."""
    undated = listens.where(F.col("year").isNull() | F.col("month").isNull())
    h = F.xxhash64(*listens.columns)
    r = undated.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(h), F.lit(0)),
                    F.coalesce(F.sum(h.cast("decimal(20,0)")), F.lit(0))).first()
    return f"{r[0]}-{r[1] & (2 ** 64 - 1):016x}-{int(r[2]) & (2 ** 64 - 1):016x}"


def append_tile_parts(new_listens: DataFrame, name: str = "dashboard",
                      batch: str | None = None) -> dict[str, str]:
    """Put the additive tables of a batch of cleaned listens, whole months, under
    ``<checkpoint dir>/playmetrics/<name>-parts/``; returns their paths.

    Each month of the batch replaces that month's partition, so running a batch again, also
    after a crash between the two tables, changes nothing else; other months stay. Rows without
    a month come in any batch, so they replace only those of the same ``batch``: by default a
    name made from those rows, so that the same batch run again counts once. Pass a name where
    two batches can bring the very same undated rows."""
    from .rollups import listen_counts, user_month_fold

    base = f"{_require_dir(new_listens.sparkSession)}/playmetrics/{name}-parts"
    paths = {"counts": f"{base}/listen_counts", "fold": f"{base}/user_month_fold"}
    own = f"undated-{batch or _batch_of(new_listens)}"
    undated = F.col("year").isNull() | F.col("month").isNull()
    for table, path in ((listen_counts(new_listens), paths["counts"]),
                        (user_month_fold(new_listens), paths["fold"])):
        (table.withColumn("batch", F.when(undated, F.lit(own)).otherwise(F.lit("months")))
         .hint("rebalance", "batch", "year", "month").write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("batch", "year", "month").parquet(path))
    return paths


def tiles_of(counts: DataFrame, fold: DataFrame, n_artists: int = 10,
             n_songs: int = 5) -> dict[str, DataFrame]:
    """Every all-scope tile from the additive tables."""
    from .rollups import (kpis_all_scopes_from_fold, monthly_listening_all_scopes,
                          subscription_breakdown_all_scopes, top_artists_all_scopes,
                          top_songs_all_scopes)

    return {
        "top_artists": top_artists_all_scopes(counts, n_artists, weight="listens"),
        "top_free_songs": top_songs_all_scopes(counts, "free", n_songs, weight="listens"),
        "top_paid_songs": top_songs_all_scopes(counts, "paid", n_songs, weight="listens"),
        "subscription_breakdown": subscription_breakdown_all_scopes(counts, weight="listens"),
        "kpis": kpis_all_scopes_from_fold(fold),
        "monthly_listening": monthly_listening_all_scopes(fold),
    }


def tiles_from_parts(spark: SparkSession, paths: dict[str, str], n_artists: int = 10,
                     n_songs: int = 5) -> dict[str, DataFrame]:
    """Every all-scope tile rebuilt from the appended additive tables; the
    events themselves are not read."""
    counts, fold = (spark.read.parquet(paths[k]).drop("batch") for k in ("counts", "fold"))
    return tiles_of(counts, fold, n_artists, n_songs)
