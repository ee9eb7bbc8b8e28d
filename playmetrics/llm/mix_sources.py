"""Mixing sources to target weights, by weighted sampling without replacement.

Sources in code-point order, null last, have the weights of ``weights``, repeated, and share a
budget of words; a target stops at ``most`` times its source's size and the excess is shared
again by weight until no target is above. A target is reached by complete epochs first; what is
left is a sample: every document has the Efraimidis-Spirakis key -ln(u) / quality, u uniform
from a hash of seed, id and text, and a source's documents are taken by rising key until their
words fill the rest. The last one taken is cut where the budget ends, so that a source's taken
words are its target, rounded down.

DataFrame functions only. Texts are read once; what is sorted and shuffled is a narrow row a
document. The order within sources comes from a range partitioning over (source, key), so a
source with most rows spreads over many tasks, and prefix sums are two-level: within the part
of a source that lies in one partition, and over such parts. Numbering the sources uses the
same order; the level at which targets stop is found by Newton's method, one aggregate over
the sources a round. Nothing that grows with documents or sources reaches the driver.

A null or empty text has no words and takes none; rows with the same id, null ones too, are
separate documents, and equal rows are interchangeable; texts of any length count whole; with
no words at all every target is 0; no rows, no result. Only the id, text and source columns
are read, whatever the names of others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from playmetrics.llm.common import text_of, write_table

#: Names a part of a source: null flag and text (null as empty), in the order of sources.
SOURCE = ["none", "source"]


def words_of(text_col: str) -> Column:
    return F.regexp_count(text_of(text_col), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def letters_share(text_col: str) -> Column:
    """Quality weight above 0, 1 at most: the share of letters among the text's characters."""
    letters = F.char_length(F.regexp_replace(text_of(text_col), r"[^\p{L}]+", ""))
    return (letters + 1) / (F.char_length(text_of(text_col)) + 1)


def uniform(id_col: str, text_col: str, seed: int) -> Column:
    """Between 0 and 1, both excluded: 52 bits of a hash of seed, id and text."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"),
                                                               F.lit("")), F.md5(text_of(text_col))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(2 ** 52)


def water_level(sources: DataFrame, share: tuple[int, int], most: int) -> float:
    """The level v at which the sum of least(most * size, weight * v) is the budget.

    ``sources``: (size, weight); the budget is share[0] / share[1] of all sizes.
    """
    total = sources.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"]
    budget, level = total * share[0] / share[1], 0.0
    while total:
        full = F.col("size") * most <= F.col("weight") * F.lit(level)
        r = sources.agg(F.sum(F.when(full, F.col("size") * most).otherwise(0)).alias("fixed"),
                        F.sum(F.when(~full, F.col("weight")).otherwise(0)).alias("open")).first()
        found = (budget - r["fixed"]) / r["open"] if r["open"] else level
        if found <= level:
            break
        level = found
    return level


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1),
        share: tuple[int, int] = (3, 2), most: int = 2, quality: Column | None = None,
        seed: int = 42) -> DataFrame:
    """One row a document: ``id_col``, source, size, source_size, target, epochs, taken.

    ``share``: the budget as a fraction of all words, less than ``most``; ``quality``: a
    positive weight, `letters_share` by default. ``epochs``: how often the source is taken whole.
    """
    quality = letters_share(text_col) if quality is None else quality
    rows = write_table(docs.select(
        F.col(source_col).isNull().alias("none"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"),
        (-F.log(uniform(id_col, text_col, seed)) / quality).alias("key"),
        F.col(id_col).alias("id"), words_of(text_col).alias("size"),
        F.monotonically_increasing_id().alias("tie")), "mix-rows")
    order = ["key", "id", "size", "tie"]
    rows = write_table(rows.repartitionByRange(*SOURCE, *order).withColumn(
        "part", F.spark_partition_id()), "mix-ordered")
    parts = write_table(rows.groupBy(*SOURCE, "part").agg(F.sum("size").alias("size")), "mix-parts")

    sources = parts.groupBy(*SOURCE).agg(F.sum("size").alias("size"), F.min("part").alias("part"))
    starts = sources.groupBy("part").agg(F.count("*").alias("n"))  # a row a partition at most
    starts = starts.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(
        W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    number = F.col("before") + F.row_number().over(W.partitionBy("part").orderBy(*SOURCE)) - 1
    cycle = F.array(*[F.lit(w) for w in weights])
    sources = write_table(sources.join(starts, "part").select(
        *SOURCE, "size", F.element_at(cycle, (F.pmod(number, F.lit(len(weights))) + 1).cast("int"))
        .alias("weight")), "mix-sources")
    level = water_level(sources, share, most)
    goal = F.least((F.col("size") * most).cast("double"), F.col("weight") * F.lit(level))
    whole = F.when(F.col("size") > 0, F.floor(goal / F.col("size"))).otherwise(F.lit(0))
    goals = sources.select(*SOURCE, F.col("size").alias("source_size"), goal.alias("target"),
                           F.least(whole, F.lit(most)).cast("int").alias("epochs")).withColumn(
        "rest", F.floor("target") - F.col("epochs") * F.col("source_size"))
    before = W.partitionBy(*SOURCE).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.withColumn("base", F.coalesce(F.sum("size").over(before), F.lit(0))).drop(
        "size").join(goals, SOURCE)

    inside = W.partitionBy("part", *SOURCE).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    placed = rows.withColumn("ahead", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(
        parts, ["part", *SOURCE])
    room = F.col("rest") - F.col("base") - F.col("ahead")
    sampled = F.greatest(F.lit(0), F.least(F.col("size"), room))
    return placed.select(
        F.col("id").alias(id_col), F.when(~F.col("none"), F.col("source")).alias("source"), "size",
        "source_size", "target", "epochs",
        (F.col("epochs") * F.col("size") + sampled).cast("long").alias("taken"))
