"""Helpers shared by the operators: tables, shared folder, row rules.

Rules that hold for every operator unless its docstring says otherwise:

* a null text is an empty text; an id is an integer and may be null; a null id
  counts as smaller than every other id;
* rows with the same id are separate documents, none smaller than the other;
* a text of any length is worked on whole, never a prefix of it; where a task
  takes a long one in parts, or apart from the others, results do not depend on it;
* input columns other than the id and the text are never read, so they may
  have any name;
* an empty table gives an empty result with the same columns.
"""

from __future__ import annotations

import tempfile
import uuid
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Stands for a null id in comparisons.
NULL_ID = -(2 ** 63)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only a local master gets a folder of its own when none is set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        found = spark.sparkContext.getCheckpointDir()
        folder = found.rsplit("/", 1)[0] if found else None
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="playmetrics-llm-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def own_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_dir(spark)}/playmetrics-llm/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, label: str) -> str:
    return f"{own_dir(spark)}/{label}-{uuid.uuid4().hex}"


def drop_scratch(spark: SparkSession) -> bool:
    """Delete all tables between steps of this application, for its end; results that still read
    them are gone after it, other applications' stay."""
    path = spark._jvm.org.apache.hadoop.fs.Path(own_dir(spark))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def write_table(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back.

    Cuts the lineage: a lost executor never makes Spark run what came before.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def fold_of(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % F.lit(folds)


def fold_number(doc_id, folds: int) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds


def ids_of(column) -> np.ndarray:
    """Arrow integer column to int64, null as ``NULL_ID``."""
    return column.fill_null(NULL_ID).to_numpy(zero_copy_only=False).astype(np.int64)


def null_back(ids, pa):
    """int64 to Arrow, ``NULL_ID`` as null."""
    ids = np.asarray(ids, dtype=np.int64)
    return pa.array(ids, mask=ids == NULL_ID)


def slices(batch, column: int, most: int):
    """``batch`` in slices of about ``most`` bytes of a binary column, so that memory is bounded."""
    start, held = 0, 0
    for i, text in enumerate(batch.column(column)):
        held += len(text.as_buffer())
        if held > most:
            yield batch.slice(start, i + 1 - start)
            start, held = i + 1, 0
    if start < len(batch):
        yield batch.slice(start)
