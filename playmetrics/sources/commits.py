"""Numbered folders that count once they are complete: how the stores here commit.

A folder holds the marker that Spark's writer leaves last, or it does not count. So a job that
dies halfway leaves nothing that a reader sees, and running it again writes the next number.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import SparkSession


def committed(spark: SparkSession, folder: str) -> list[str]:
    """Names of the complete sub-folders of ``folder``, in order; none if it is not there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    child = spark._jvm.org.apache.hadoop.fs.Path
    return sorted(s.getPath().getName() for s in fs.listStatus(path)
                  if s.isDirectory() and fs.exists(child(s.getPath(), "_SUCCESS")))


def next_name(spark: SparkSession, folder: str) -> str:
    """A name after all complete ones; two jobs at once get different names."""
    last = max((int(re.match(r"\d+", n)[0]) for n in committed(spark, folder)), default=0)
    return f"{last + 1:08d}-{uuid.uuid4().hex[:8]}"
