"""Repair each name once: a growing dictionary in place of a repair a row.

A feed of many plays holds few names. The dictionary has every non-ASCII name seen (ASCII ones
repair to themselves) and its repaired form; a load adds the names that it does not have yet.
Cleaning then looks names up, only those that a repair changes. As many of them as `attach` calls
hot at most are broadcast whole, so that cleaning is one pass over rows that do not move. Of more
names the hot ones are broadcast and the others joined by name, a column at a time (`attach`);
there, too, rows whose names are all ASCII or NULL do not move.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import MAX_LAYERS, NON_ASCII, repair_text
from .cleaning import clean
from .lookup import attach

NAMES = ("artist", "song")


def _odd(c: str):
    return F.coalesce(F.col(c).rlike(NON_ASCII), F.lit(False))


def names_of(raw: DataFrame, cols: tuple[str, ...] = NAMES) -> DataFrame:
    """(name): the distinct non-ASCII values of the columns."""
    each = F.explode(F.array_distinct(F.array(*[F.when(_odd(c), F.col(c)) for c in cols])))
    return raw.where(reduce(lambda a, b: a | b, map(_odd, cols))).select(
        each.alias("name")).where("name IS NOT NULL").distinct()


def repair_dictionary(raw: DataFrame, known: DataFrame | None = None, cols: tuple[str, ...] = NAMES,
                      mode: str = "intended", layers: int = MAX_LAYERS) -> DataFrame:
    """(name, repaired) of ``known``, a dictionary from before, and of the names it lacks.

    Each new name is repaired once, however many rows have it. Write the result (`materialize`)
    and pass it as ``known`` next time."""
    new = names_of(raw, cols)
    if known is not None:
        new = new.join(known, "name", "left_anti")
    new = new.select("name", repair_text("name", mode, layers).alias("repaired"))
    return new if known is None else known.select("name", "repaired").unionByName(new)


def repair_by_dictionary(raw: DataFrame, dictionary: DataFrame, cols: tuple[str, ...] = NAMES,
                         max_hot: int = 100_000, salt_buckets: int | None = None) -> DataFrame:
    """``raw`` with the columns repaired; a name that the dictionary lacks stays.

    Counts the names that change, of ``dictionary`` as it is now: at most ``max_hot`` are broadcast.
    With more ``raw`` is read once for the rows that stay, once for the others, and once per column
    to count its names; pass a written table."""
    changed = dictionary.where(_odd("name") & (F.col("name") != F.col("repaired"))).select(
        "name", F.col("repaired").alias("__repaired"))
    if changed.count() <= max_hot:
        rows = raw
        for c in cols:
            found = rows.join(F.broadcast(changed.withColumnRenamed("name", c)), c, "left")
            rows = _put(found, c, raw.columns)
        return rows
    open_ = reduce(lambda a, b: a | b, map(_odd, cols))
    rows = raw.where(open_)
    for c in cols:
        # of raw, not of rows: these have gone through the lookups of the columns before
        counts = raw.where(_odd(c)).groupBy(c).agg(F.count(F.lit(1)).alias("__n"))
        per_name = counts.join(changed.withColumnRenamed("name", c), c).select(c, "__n", "__repaired")
        rows = _put(attach(rows, per_name, c, "__repaired", max_hot, salt_buckets), c, raw.columns)
    return raw.where(~open_).unionByName(rows)


def _put(found: DataFrame, c: str, columns: list[str]) -> DataFrame:
    """``columns`` of ``found``, ``c`` repaired where its name was found."""
    return found.select(*[F.coalesce("__repaired", c).alias(c) if x == c else F.col(x)
                          for x in columns])


def clean_by_dictionary(raw: DataFrame, dictionary: DataFrame, time_zone: str | None = None,
                        **how) -> DataFrame:
    """`clean`, its names looked up; ``how``: see `repair_by_dictionary`."""
    return clean(repair_by_dictionary(raw, dictionary, **how), "none", time_zone)
