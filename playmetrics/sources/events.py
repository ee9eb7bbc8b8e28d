"""Readers for the event feeds and the map attribute table.

Every reader is a plain `spark.read` with a fixed schema, so executors split
the files among themselves; nothing is downloaded or parsed on the driver.
An object-store location (``s3a://``, ``gs://``, ``abfss://``) is just another
path here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from .schemas import AUTH_SCHEMA, BOUNDARY_SCHEMA, LISTEN_SCHEMA


def read_events(spark: SparkSession, path, schema: StructType | None = None,
                fmt: str = "json", **options) -> DataFrame:
    """Read one event feed (a folder of JSON lines, or parquet; ``path`` may be
    a list of folders).

    With ``schema=None`` the JSON reader infers one, which costs an extra pass;
    pass a schema whenever the columns are known. A missing path raises.
    ``options`` go to the reader, e.g. ``mode='DROPMALFORMED'`` to drop lines
    that are not valid JSON (by default they become rows of NULLs).
    """
    reader = spark.read.format(fmt).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path)


def read_listen_events(spark: SparkSession, path, fmt: str = "json", **options) -> DataFrame:
    return read_events(spark, path, LISTEN_SCHEMA, fmt, **options)


def read_auth_events(spark: SparkSession, path, fmt: str = "json", **options) -> DataFrame:
    return read_events(spark, path, AUTH_SCHEMA, fmt, **options)


def read_page_view_events(spark: SparkSession, path: str, schema: StructType | str,
                          fmt: str = "json") -> DataFrame:
    """Page-view feed; no column of it is used by any query, so the caller names the columns."""
    return read_events(spark, path, schema, fmt)


def read_status_change_events(spark: SparkSession, path: str, schema: StructType | str,
                              fmt: str = "json") -> DataFrame:
    """Status-change feed; no column of it is used by any query, so the caller names them."""
    return read_events(spark, path, schema, fmt)


def read_boundaries(spark: SparkSession, path: str, fmt: str = "parquet",
                    **options) -> DataFrame:
    """State boundary attributes (NAME, STUSPS, geometry as WKT), one row per state.

    ``options`` go to the reader (e.g. ``header=True`` for CSV)."""
    reader = spark.read.format(fmt).options(**options)
    if fmt != "parquet":
        reader = reader.schema(BOUNDARY_SCHEMA)
    return reader.load(path).select("NAME", "STUSPS", "geometry")
