"""Session helper for tests, the bench and local use.

Library functions never create a session; they take and return DataFrames.
A cluster job gets its session from its launcher, with the settings below
(or its own), and a shared ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# Settings every query here assumes or benefits from.
RECOMMENDED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


# Starting points for a large cluster (~1000 executors, ~100 TB of events);
# see the README for the reasoning. Pass to your launcher or to get_session(conf=...).
CLUSTER_CONF = {
    **RECOMMENDED_CONF,
    "spark.sql.files.maxPartitionBytes": "512m",
    "spark.sql.shuffle.partitions": "20000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1g",
    "spark.sql.autoBroadcastJoinThreshold": "64m",
    "spark.decommission.enabled": "true",
    "spark.storage.decommission.enabled": "true",
    "spark.storage.decommission.shuffleBlocks.enabled": "true",
}


def get_session(master: str = "local[*]", app: str = "playmetrics",
                shuffle_partitions: int = 8, conf: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app)
    settings = dict(RECOMMENDED_CONF)
    settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(conf or {})
    for k, v in settings.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    # Keep the cluster's checkpoint folder; only a bare local session gets one.
    if not spark.sparkContext.getCheckpointDir() and not spark.conf.get(
            "spark.checkpoint.dir", None):
        # of the session there is, which may be another than the one asked for
        running = spark.sparkContext.master
        if running != "local" and not running.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="playmetrics-ckpt-"))
    return spark
