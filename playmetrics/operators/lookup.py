"""A left join of rows with a value per key that no hot key can slow down."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType


def attach(df: DataFrame, per_key: DataFrame, key: str, value: str, max_hot: int = 100_000,
           salt_buckets: int | None = None) -> DataFrame:
    """``df`` with ``value`` of its ``key``, NULL where ``per_key`` has none or ``key`` is NULL.

    ``per_key``: one row a key, with ``__n``, its rows in ``df``, and ``value``, not NULL. Keys
    holding more than 1/``max_hot`` of all those rows are hot; at most ``max_hot`` of them can
    exist, so their part has a proven size bound and is broadcast. Rows of hot keys and rows
    without a key are spread over ``salt_buckets`` join keys (a hash of the whole row, so a
    recomputed task salts identically) that match nothing; only the others are joined by key.
    """
    # from the per-key table; reading the value too makes its exchange the one used below,
    # so ``df`` is not computed again for the total
    total = per_key.agg(F.sum(F.when(F.col(value).isNotNull(), F.col("__n")))).scalar()
    is_hot = F.col("__n") * F.lit(max_hot) > total
    known = F.col(key).isNotNull()
    hot = per_key.where(known & is_hot).select(key, F.col(value).alias("__hot"))
    cold = per_key.where(known & ~is_hot).select(
        key, F.col(value).alias("__cold"), F.lit(0).cast("long").alias("__salt"))

    buckets = salt_buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tagged = df.join(F.broadcast(hot), on=key, how="left")
    spread = F.col(key).isNull() | F.col("__hot").isNotNull()
    hashable = [F.col(f.name) for f in df.schema.fields
                if not isinstance(f.dataType, MapType)]  # hashing a map is an error
    salt = F.when(spread, F.pmod(F.xxhash64(*hashable),
                                 F.lit(buckets)) + 1).otherwise(F.lit(0).cast("long"))
    joined = tagged.withColumn("__salt", salt).join(cold, on=[key, "__salt"], how="left")
    return joined.select(*df.columns, F.coalesce(F.col("__hot"), F.col("__cold")).alias(value))
