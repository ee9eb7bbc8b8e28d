"""Blocked Bloom filter of a column's values, built by aggregation, tested in the scan.

The filter is a table of 64-bit words. A value's hash names its word and up to ``PROBES`` bits
in it, so building is one ``bit_or`` a word (every task sends at most ``words`` rows) and testing
is one lookup: the words, of a size fixed by ``words`` whatever the data, are broadcast and the
scan's rows are joined to them where they are. A value of the set always passes; another passes
seldom, so rows that fail need no join on the value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 4 MB with the words' numbers; about three in a hundred others pass at a million values.
WORDS = 1 << 18
PROBES = 4


def _word(value: Column, words: int) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(words))


def _mask(value: Column) -> Column:
    h = F.xxhash64(value, F.lit(1))
    out = F.lit(0).cast("long")
    for i in range(PROBES):
        place = F.shiftright(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        out = out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), place))
    return out


def bloom_words(values: DataFrame, col: str, words: int = WORDS) -> DataFrame:
    """(word, mask), at most ``words`` rows: the filter of the non-NULL values."""
    value = F.col(col)
    return (values.where(value.isNotNull())
            .groupBy(_word(value, words).alias("word")).agg(F.bit_or(_mask(value)).alias("mask")))


def with_membership(df: DataFrame, filter_: DataFrame, col: str, alias: str,
                    words: int = WORDS) -> DataFrame:
    """``df`` and a boolean ``alias``: False only where ``col`` is certainly not among the
    values of ``filter_``, a result of `bloom_words` with the same ``words``; NULL is not."""
    found = filter_.select(F.col("word").alias("__word"), F.col("mask").alias("__mask"))
    mask = _mask(F.col(col))
    passes = F.col(col).isNotNull() & (F.col("__mask").bitwiseAND(mask) == mask)
    joined = df.withColumn("__at", _word(F.col(col), words)).join(
        F.broadcast(found), F.col("__at") == F.col("__word"), "left")
    return joined.withColumn(alias, F.coalesce(passes, F.lit(False))).drop("__at", "__word", "__mask")
