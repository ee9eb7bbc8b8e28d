"""The listen feed as a stream: the same cleaning and counts, kept current.

The batch reader takes a folder of JSON lines; `read_listen_stream` takes the
same folder as a file stream, so new files are picked up as they land. The
live tiles reuse the batch operators unchanged (cleaning is stateless; the
counts are streaming aggregations whose state is keyed by the group).

Checkpoints of streaming queries go under the shared folder of
``spark.checkpoint.dir``, so a restarted query resumes where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.artists import top_artists
from ..operators.cleaning import clean
from ..plans.materialize import checkpoint_dir
from ..sources.schemas import LISTEN_SCHEMA


def read_listen_stream(spark: SparkSession, path: str, fmt: str = "json",
                       max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(LISTEN_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return reader.load(path)


def live_artist_state_listens(raw_stream: DataFrame) -> DataFrame:
    """Running listens per (artist, state) of the cleaned feed."""
    return (clean(raw_stream).groupBy("artist", "state")
            .agg(F.count(F.lit(1)).alias("listens")))


def live_subscription_counts(raw_stream: DataFrame) -> DataFrame:
    """Running listens per (state, subscription) of the cleaned feed."""
    return (clean(raw_stream).groupBy("state", "subscription")
            .agg(F.count(F.lit(1)).alias("count")))


def live_top_artists(raw_stream: DataFrame, state: str | None = None,
                     n: int = 10) -> DataFrame:
    """The top-``n`` artist tile kept current; run it in complete output mode
    (the only mode in which a stream may be sorted after its aggregation)."""
    return top_artists(clean(raw_stream), state, n)


def start_tile(live: DataFrame, name: str, sink: str, output_mode: str,
               path: str | None = None, available_now: bool = False) -> StreamingQuery:
    """Start a live tile; its checkpoint lives under the shared folder, so starting it again
    under the same name goes on where it stopped.

    The ``memory`` sink keeps its table on the driver and cannot go on: it is allowed in
    complete mode only (one bounded table, not every update), and starts anew each time.
    """
    if sink == "memory" and output_mode != "complete":
        raise ValueError("the memory sink would gather every update on the driver")
    spark = live.sparkSession
    base = checkpoint_dir(spark)
    if not base:
        raise RuntimeError("set spark.checkpoint.dir to a shared folder first")
    writer = live.writeStream.format(sink).outputMode(output_mode)
    if sink == "memory":
        writer = writer.queryName(name)
    else:
        writer = writer.option("checkpointLocation", f"{base.rstrip('/')}/streams/{name}")
    if path is not None:
        writer = writer.option("path", path)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def refresh_clean_table(spark: SparkSession, raw_path: str, table_path: str, name: str,
                        time_zone: str | None = "UTC", fmt: str = "json") -> StreamingQuery:
    """Bring the cleaned listen table at ``table_path`` up to date with the
    event files under ``raw_path``: only files not seen before are read,
    cleaned and appended (parquet, partitioned by year and month).

    Runs as an ``availableNow`` file stream, so it processes what is there and
    stops; the checkpoint under ``spark.checkpoint.dir`` records which files
    are done, and the parquet sink commits each batch exactly once, so a rerun
    after a failure neither loses nor repeats rows. Call ``awaitTermination()``
    on the returned query.
    """
    base = checkpoint_dir(spark)
    if not base:
        raise RuntimeError("set spark.checkpoint.dir to a shared folder first")
    cleaned = clean(read_listen_stream(spark, raw_path, fmt), time_zone=time_zone)
    return (cleaned.writeStream.format("parquet").outputMode("append")
            .partitionBy("year", "month")
            .option("path", table_path)
            .option("checkpointLocation", f"{base.rstrip('/')}/streams/{name}")
            .trigger(availableNow=True)
            .start())
