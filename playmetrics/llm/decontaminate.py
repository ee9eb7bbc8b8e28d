"""Benchmark decontamination with a broadcast hash set, in DataFrame operations only.

Benchmark items become windows of ``width`` normalised words (an item of fewer
words is one window). Their hashes go to every task as a set, behind a check
of its size; each document tests all its windows against it, carries the
words of the windows that pass, and those are verified against the
benchmark's own words. Of a benchmark beyond the bound the tasks get a Bloom
filter of its hashes, of fixed size: windows that fail it stop there, those
that pass are joined by hash and then verified in the same way. The result is
the same on both sides of the bound.

Normalised: A-Z lower-cased, words of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``.
Null or empty texts have no words and no hits; null item ids can hit but are
not listed as items; repeated items count once, repeated documents each give
their own row.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, functions as F

from playmetrics.llm.common import text_of, write_table
from playmetrics.operators.membership import WORDS, bloom_words, with_membership

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same on a text that has not been lower-cased.
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    low = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(low, SEPARATORS, -1), "")


def benchmark_windows(benchmark: DataFrame, item_col: str, text_col: str,
                      width: int) -> DataFrame:
    """Distinct (item, len, gram, hash); ``hash`` is that of the array of words."""
    rows = benchmark.select(F.col(item_col).cast("string").alias("item"),
                            words_of(text_of(text_col)).alias("w"))
    rows = rows.where(F.size("w") > 0).select("item", "w", F.least(
        F.size("w"), F.lit(width)).alias("len"))
    rows = rows.select("item", "len", F.explode(F.expr(
        "transform(sequence(1, size(w) - len + 1), i -> slice(w, i, len))")).alias("g"))
    return rows.select("item", "len", F.array_join("g", " ").alias("gram"),
                       F.xxhash64("g").alias("hash")).distinct()


def _candidates(sets: dict[int, list[int]]) -> Column:
    """Array of (pos, len, gram) of column ``w``, of the windows whose hash is in a set."""
    found = []
    for n, hashes in sorted(sets.items()):
        test = f"xxhash64(slice(w, i, {n})) IN ({', '.join(f'{h}L' for h in hashes)})"
        found.append(F.expr(
            f"CASE WHEN size(w) >= {n} THEN transform(filter(sequence(1, size(w) - {n - 1}), "
            f"i -> {test}), i -> struct(i - 1 AS pos, {n} AS len, "
            f"array_join(slice(w, i, {n}), ' ') AS gram)) "
            "ELSE CAST(array() AS array<struct<pos:int,len:int,gram:string>>) END"))
    return F.concat(*found)


def _passed(rows: DataFrame, grams: DataFrame, bloom: int) -> DataFrame:
    """(row, pos, len, gram) of the windows of ``rows`` (row, w) that have a benchmark hash."""
    lengths = [r["len"] for r in grams.select("len").distinct().collect()]  # ``width`` at most
    windows = F.concat(*[F.expr(
        f"CASE WHEN size(w) >= {n} THEN transform(sequence(1, size(w) - {n - 1}), i -> struct("
        f"i - 1 AS pos, {n} AS len, xxhash64(slice(w, i, {n})) AS hash)) "
        "ELSE CAST(array() AS array<struct<pos:int,len:int,hash:bigint>>) END") for n in lengths])
    keys = grams.select("hash").distinct()
    tested = with_membership(rows.select("row", F.inline(windows)),
                             bloom_words(keys, "hash", bloom), "hash", "may", bloom)
    # few are left: their hashes are looked up, then their words are fetched
    met = tested.where("may").select("row", "pos", "len", "hash").join(keys, "hash", "left_semi")
    at = met.groupBy("row").agg(F.collect_list(F.struct("pos", "len")).alias("at"))
    return rows.join(at, "row").select("row", F.inline(F.transform("at", lambda x: F.struct(
        x["pos"].alias("pos"), x["len"].alias("len"),
        F.array_join(F.slice("w", x["pos"] + 1, x["len"]), " ").alias("gram")))))


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id",
                       text_col: str = "text", item_col: str = "item_id",
                       benchmark_text_col: str = "text", width: int = 13,
                       max_set: int = 200_000, bloom: int = WORDS) -> DataFrame:
    """One row per document: id, ``row`` (its number), ``n_words``, ``hit`` (positions), ``items``.

    ``max_set``: the most windows, counted with their items, that are sent to the tasks as a
    set; ``bloom``: 64-bit words of the filter beyond that (some 1.5 windows a word to be of use).
    """
    grams = write_table(benchmark_windows(benchmark, item_col, benchmark_text_col, width),
                        "benchmark-windows")
    small = grams.limit(max_set + 1).count() <= max_set
    rows = docs.select(F.col(id_col).alias("id"), words_of(text_of(text_col)).alias("w"))
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "id", "w",
                       F.size("w").cast("long").alias("n_words"))
    nothing = F.array().cast("array<struct<pos:int,len:int,gram:string>>")
    if small:
        keys = grams.select("len", "hash").distinct()
        listed = {r["len"]: r["h"] for r in keys.groupBy("len").agg(
            F.collect_list("hash").alias("h")).collect()}
        scanned = write_table(rows.select(
            "row", "id", "n_words", (_candidates(listed) if listed else nothing).alias("found")),
            "benchmark-scan")
        met = scanned.where(F.size("found") > 0).select("row", F.inline("found"))
        hits = met.join(F.broadcast(grams.select("item", "len", "gram")), ["len", "gram"])
    else:
        scanned = write_table(rows, "benchmark-scan")
        hits = _passed(scanned, grams, bloom).join(grams.select("item", "len", "gram"), ["len", "gram"])
    per_row = hits.groupBy("row").agg(
        F.collect_set(F.struct("pos", "len")).alias("at"), F.collect_set("item").alias("items"))
    per_row = per_row.select("row", "items", F.array_distinct(F.flatten(F.transform(
        "at", lambda x: F.sequence(x["pos"], x["pos"] + x["len"] - 1)))).alias("hit"))
    return scanned.select("row", "id", "n_words").join(per_row, "row", "left").select(
        F.col("id").alias(id_col), "row", "n_words",
        F.coalesce("hit", F.array().cast("array<int>")).alias("hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def verdict(found: DataFrame, share: int = 20) -> DataFrame:
    """Adds ``n_hit`` and ``contaminated``: a hit, and 1/``share`` of the words or more hit."""
    n_hit = F.size("hit").cast("long")
    return found.withColumn("n_hit", n_hit).withColumn(
        "contaminated", (n_hit > 0) & (n_hit * share >= F.col("n_words")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id",
                  text_col: str = "text", remove: str = "documents", share: int = 20,
                  **how) -> DataFrame:
    """``docs`` without what the benchmark contaminates; same columns.

    ``remove="documents"`` drops contaminated documents. ``remove="spans"`` keeps every row and
    takes each hit word out of its text, leaving what stands between words.
    """
    names = docs.columns
    numbered = write_table(docs.select(
        *[F.col(c).alias(f"c{i}") for i, c in enumerate(names)],
        F.monotonically_increasing_id().alias("n")), "decontaminate-docs")
    at = f"c{names.index(text_col)}"
    judged = verdict(find_contamination(numbered, benchmark, "n", at, **how), share)
    hit = judged.where("contaminated" if remove == "documents" else "n_hit > 0").select(
        "n", "hit")
    if remove == "documents":
        out = numbered.join(hit, "n", "left_anti")
    else:
        between = F.split(F.col(at), RAW_WORD, -1)
        words = F.regexp_extract_all(F.col(at), F.lit(RAW_WORD), F.lit(0))
        kept = F.transform(words, lambda w, i: F.when(F.array_contains("hit", i), F.lit(""))
                           .otherwise(w))
        text = F.array_join(F.zip_with(between, kept, lambda a, b: F.concat(
            a, F.coalesce(b, F.lit("")))), "")
        out = numbered.join(hit, "n", "left").withColumn(
            at, F.when(F.col("hit").isNull(), F.col(at)).otherwise(text))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
