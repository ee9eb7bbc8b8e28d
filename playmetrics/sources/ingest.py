"""Which files of a feed are new: a manifest beside the table they went into.

A feed folder on an object store only grows, but files are also replaced, and a load may run
twice. The manifest holds (file, size, time) of every file taken in. A load lists the folder,
leaves out what the manifest has, reads the rest, writes their rows as a batch and commits the
batch's manifest last. A file listed again as it was is not read again; one that changed is
read anew and its old rows no longer count; a load that dies before its commit leaves rows that
no reader looks at. What a feed no longer lists stays in the table;
Spark lists no empty file, so a file emptied counts as gone.

Listing and comparing are tables; only the names of new files and of batches reach the driver,
where Spark's own reader keeps them as well.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .commits import committed, next_name

_FILE = ["__file", "__size", "__modified"]
MANIFEST = "file string, size bigint, modified timestamp, path string"


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(file, size, modified, path) of a folder and those below it; contents are not read."""
    found = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
             .option("pathGlobFilter", pattern).load(path))
    return found.select(F.col("_metadata.file_path").alias("file"), F.col("length").alias("size"),
                        F.col("modificationTime").alias("modified"), "path")


def manifest(spark: SparkSession, store: str) -> DataFrame:
    """(file, size, modified, path, batch) of every file taken in, replaced ones too."""
    batches = committed(spark, f"{store}/manifest")
    out = spark.createDataFrame([], MANIFEST + ", batch string")
    for b in [batches[i:i + 500] for i in range(0, len(batches), 500)]:
        part = spark.read.schema(MANIFEST).parquet(*[f"{store}/manifest/{x}" for x in b])
        name = F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)/[^/]+$", 1)
        out = out.unionByName(part.select("*", name.alias("batch")))
    return out


def _latest(known: DataFrame) -> DataFrame:
    return known.groupBy("file").agg(F.max("batch").alias("batch"))


def new_files(spark: SparkSession, path: str, store: str, pattern: str = "*") -> DataFrame:
    """The listed files whose name, size and time the manifest's last entry does not have."""
    known = manifest(spark, store)
    last = known.join(_latest(known), ["file", "batch"]).select("file", "size", "modified")
    return list_files(spark, path, pattern).join(last, ["file", "size", "modified"], "left_anti")


def ingest(spark: SparkSession, path: str, store: str,
           read: Callable[[SparkSession, list[str]], DataFrame], pattern: str = "*") -> str | None:
    """Take the new files of ``path`` into ``store``; the batch's name, or None with nothing new.

    ``read(spark, paths)`` reads files, straight from a Spark reader (rows keep their file)."""
    found = new_files(spark, path, store, pattern).collect()
    if not found:
        return None
    batch = next_name(spark, f"{store}/manifest")
    rows = read(spark, [r["path"] for r in found])
    rows.select("*", *[F.col(f"_metadata.{c}").alias(n) for c, n in zip(
        ("file_path", "file_size", "file_modification_time"), _FILE)]).write.parquet(f"{store}/rows/{batch}")
    listed = spark.createDataFrame([tuple(r[c] for c in ("file", "size", "modified", "path"))
                                    for r in found], MANIFEST)
    seen = spark.read.parquet(f"{store}/rows/{batch}").select(*_FILE).distinct()
    changed = seen.join(listed, [F.col(a) == F.col(b) for a, b in zip(
        _FILE, ("file", "size", "modified"))], "left_anti").limit(1).collect()
    if changed:
        raise RuntimeError(f"{changed[0][0]} changed while it was read; run the load again")
    listed.write.parquet(f"{store}/manifest/{batch}")
    return batch


def ingested(spark: SparkSession, store: str) -> DataFrame:
    """The table: rows of every file taken in, as it was last."""
    batches = committed(spark, f"{store}/manifest")
    if not batches:
        raise ValueError(f"{store} holds no batch")
    rows = spark.read.option("mergeSchema", True).parquet(*[f"{store}/rows/{b}" for b in batches])
    rows = rows.withColumn("__batch", F.regexp_extract(
        F.col("_metadata.file_path"), r"/([^/]+)/[^/]+$", 1))
    known = manifest(spark, store)
    # few as a rule: only what was replaced, so that nothing is joined to keep rows
    old = known.join(_latest(known), ["file", "batch"], "left_anti").select(
        F.col("file").alias("__file"), F.col("batch").alias("__batch"))
    return rows.join(old, ["__file", "__batch"], "left_anti").drop(*_FILE, "__batch")
