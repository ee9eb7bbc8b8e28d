"""Where a minimiser's strings go: buckets sized by the data, hot minimisers dealt over several."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, functions as F

from playmetrics.llm.common import shuffle_partitions, write_table

_MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Minimisers:
    """The hot minimisers, with how many buckets each is dealt over, and the number of buckets."""

    def __init__(self, hot: dict[int, int], buckets: int):
        self.buckets = buckets
        self.keys = np.array(sorted(hot), np.int64).view(np.uint64)
        order = np.argsort(self.keys)
        self.salts = np.array([hot[k] for k in sorted(hot)], np.uint64)[order]
        self.keys = self.keys[order]

    def bucket(self, least: np.ndarray) -> np.ndarray:
        return (mixed(least) % np.uint64(self.buckets)).astype(np.int64)

    def hot(self, least: np.ndarray) -> np.ndarray:
        """The place of each minimiser among the hot ones, -1 where it is not."""
        if not len(self.keys):
            return np.full(len(least), -1)
        at = np.minimum(np.searchsorted(self.keys, least), len(self.keys) - 1)
        return np.where(self.keys[at] == least, at, -1)

    def dealt(self, least: np.ndarray, which: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The bucket of each string of a hot minimiser; ``hashes`` are equal for equal strings."""
        salt = mixed(hashes) % self.salts[which]
        return self.bucket(least + _MIX * (salt + np.uint64(1)))


def sized(rows: DataFrame, counted: Callable[[DataFrame], DataFrame], sample: int, hot: int,
          bucket: int, buckets: int | None, growth: int = 1) -> Minimisers:
    """Buckets for ``rows`` (id, h, ...), estimated on one row in ``sample``, chosen by a hash.

    ``counted`` gives (least, n) of some rows: what they send for each minimiser. One with more
    than ``hot`` is dealt over so many buckets that each gets about ``hot``, where dealing makes
    ``growth`` times as much of it; there are as many
    buckets as hold ``bucket`` each, unless ``buckets`` says how many. Equal strings still meet
    whatever the estimate, so it decides where they go and never what is found.
    """
    some = rows.where(F.pmod(F.xxhash64("h", "id"), F.lit(sample)) == 0)
    found = write_table(counted(some).groupBy("least").agg(F.sum("n").alias("n")), "minimisers")
    total = (found.agg(F.sum("n")).first()[0] or 0) * sample
    # each has more than ``hot`` of all there is, which bounds their number
    many = {r["least"]: -(-r["n"] * sample * growth // hot) for r in found.where(
        F.col("n") * sample > hot).collect()}
    least = 4 * shuffle_partitions(rows.sparkSession)
    return Minimisers(many, buckets or max(least, -(-total // bucket)))
