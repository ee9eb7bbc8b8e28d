"""Quality rules: n-gram perplexity bands beside plain text rules.

Spark counts character 4-grams of all texts for each language and turns them into a modified
Kneser-Ney model (continuation counts below the highest order, three discounts for each order
and language): a table of every counted 4-gram, keyed by language and its 48-bit code (the
classes of its four characters, so no two share a key), with its log probability. Scoring
wants it in sorted hash arrays, of codes and of logs, for each language. As many of the most
frequent 4-grams as ``frequent`` allows are broadcast as such arrays; the 4-grams of a document that
are not among them go, with their count, to the table by a shuffle join on (language, code).
Both give the same probability, so ``frequent`` decides what moves and never a verdict. No
4-gram is unknown, since the model is made of the very texts it judges.

A document's perplexity is kept within a band of its language: the quartiles of
log perplexity over its distinct texts that pass the rules (copies count once),
widened on both sides by ``spread`` times their distance, ``FLOOR`` at least, and more for
short texts, whose means vary more: times sqrt(1 + ``slack_words`` / words).

Text rules, from whole texts: words ``[^\\x20\\x09-\\x0D]+``, code points in words,
symbols of ``#*$%&|<>``, repeated lines, words in repeated 8-word windows; a text fails
with under 20 words or over 30 % of its words in repeated windows.

Null and empty texts have no words and fail; they have no perplexity. Null
languages are a language of their own. Repeated rows count each, except in the quartiles. The characters of
an n-gram: white space runs are one space; code points beyond 3071 share 1023
classes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from playmetrics.llm.common import slices, text_of, write_table

ORDER, BITS = 4, 12
SYMBOLS = b"#*$%&|<>"
#: 4-grams that are broadcast at most, 16 bytes each.
FREQUENT = 1 << 20
#: Keys that the rows of one language are dealt to where they meet its discounts or band.
SALTS = 64
#: The least distance of a language's quartiles of log perplexity that its band is made of: a
#: language of few or nearly equal texts still has a band (one per cent of perplexity).
FLOOR = 0.01
#: Bytes of text that are worked on together.
CHUNK = 1_500_000
#: Entries that a task gathers before it merges them; it sends them on beyond four times that.
HELD = 1_000_000


def codes(text: bytes) -> np.ndarray:
    """Character classes 1..4095 of a text."""
    points = np.frombuffer(b" ".join(text.split()).decode("utf-8", "replace").encode("utf-32-le"),
                           np.uint32).astype(np.int64)
    return np.maximum(np.where(points < 3072, points, 3072 + points % 1023), 1)


def grams(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(key, text number) of every character and of each end, after its ORDER - 1 predecessors."""
    pad = np.zeros(ORDER - 1, np.int64)
    flat = np.concatenate([x for t in texts for x in (pad, t, pad[:1])])
    lens = np.array([len(t) + 1 for t in texts])
    keys = np.zeros(len(flat) - ORDER + 1, np.int64)
    for j in range(ORDER):
        keys = (keys << BITS) | flat[j:len(flat) - ORDER + 1 + j]
    # a text's grams start at its pad; those that start later reach into the next text
    starts = np.cumsum(lens + ORDER - 1) - lens - ORDER + 1
    at = np.arange(lens.sum()) + np.repeat(starts - np.cumsum(lens) + lens, lens)
    return keys[at], np.repeat(np.arange(len(texts)), lens)


def _by_language(langs, texts):
    """Row numbers of the texts of each language that are not empty."""
    groups: dict[str, list[int]] = {}
    for i, (lang, text) in enumerate(zip(langs, texts)):
        if len(text):
            groups.setdefault(lang, []).append(i)
    return groups.items()


def _count(batches):
    total: dict[str, list] = {}

    def merged(parts):
        keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        return keys, np.bincount(at, np.concatenate([n for _, n in parts])).astype(np.int64)

    def out(lang, parts):
        keys, n = merged(parts)
        for a in range(0, len(keys), 100_000):
            k = keys[a:a + 100_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(k), pa.string()), pa.array(k), pa.array(n[a:a + 100_000])],
                ["lang", "key", "n"])

    for b in (part for batch in batches for part in slices(batch, 1, CHUNK)):
        texts = [codes(t.as_py()) for t in b.column(1)]
        for lang, rows in _by_language(b.column(0).to_pylist(), texts):
            parts = total.setdefault(lang, [])
            parts.append(np.unique(grams([texts[i] for i in rows])[0], return_counts=True))
            if sum(len(k) for k, _ in parts[1:]) > HELD:
                total[lang] = [merged(parts)]
                if len(total[lang][0][0]) > 4 * HELD:
                    yield from out(lang, total.pop(lang))
    for lang, parts in total.items():
        yield from out(lang, parts)


def on_every_salt(df: DataFrame) -> DataFrame:
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def kneser_ney(counts: DataFrame) -> DataFrame:
    """(lang, key, n, log) from (lang, key, n): the natural logarithm of each 4-gram's last
    character given those before."""
    levels = [counts.select(F.lit(ORDER).alias("k"), "lang", "key", "n")]
    for k in range(ORDER - 1, 0, -1):  # continuation counts: how many characters come before
        levels.insert(0, levels[0].groupBy(
            "lang", F.col("key").bitwiseAND(F.lit((1 << BITS * k) - 1)).alias("key")).agg(
                F.count("*").alias("n")).select(F.lit(k).alias("k"), "lang", "key", "n"))
    every = levels[0]
    for more in levels[1:]:
        every = every.unionByName(more)
    every = write_table(every, "perplexity-counts")
    n1, n2, n3, n4 = (F.count(F.when(F.col("n") == i, 1)).alias(f"n{i}") for i in range(1, 5))
    y = F.expr("n1 / (n1 + 2 * n2)")
    usual = F.expr("n1 > 0 AND n2 > 0 AND n3 > 0 AND n4 > 0")
    discounts = every.groupBy("k", "lang").agg(n1, n2, n3, n4).select(
        "k", "lang", *[F.when(usual, F.greatest(F.lit(0.1), F.least(
            F.lit(i - 0.1), F.lit(i) - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}"))))
            .otherwise(F.lit(i / 2)).alias(f"d{i}") for i in (1, 2, 3)])
    # an order and language may hold a third of the rows
    part = every.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")).join(
        on_every_salt(discounts), ["k", "lang", "salt"]).select(
        "k", "lang", "key", F.shiftright("key", BITS).alias("ctx"), "n",
        F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2"))
        .otherwise(F.col("d3")).alias("d"))
    # a context has a row for each character after it at most, 4095 as there are classes
    contexts = part.groupBy("k", "lang", "ctx").agg(
        F.sum("n").alias("total"), (F.sum("d") / F.sum("n")).alias("down"))
    shares = write_table(part.join(contexts, ["k", "lang", "ctx"]).select(
        "k", "lang", "key", "n", ((F.col("n") - F.col("d")) / F.col("total")).alias("share"),
        "down"), "perplexity-shares")
    # order by order: an n-gram's share, and what its context passes down to its last n - 1
    known = shares.where("k = 1").groupBy("lang").agg((1 / (F.count("*") + 1)).alias("p")).select(
        "lang", F.lit(0).cast("long").alias("tail"), "p")
    for k in range(1, ORDER + 1):
        tail = F.col("key").bitwiseAND(F.lit((1 << BITS * (k - 1)) - 1))
        level = shares.where(F.col("k") == k).withColumn("tail", tail)
        p = (F.col("share") + F.col("down") * F.col("p")).alias("p")
        # a tail likewise has a row for each character before it at most
        known = level.join(known, ["lang", "tail"]).select("lang", F.col("key").alias("tail"), "n", p)
        known = known if k == ORDER else known.drop("n")
    return known.select("lang", F.col("tail").alias("key"), "n", F.log("p").alias("log"))


def frequent_arrays(model: DataFrame, frequent: int = FREQUENT) -> tuple[dict, bool]:
    """({language: (sorted codes, logs)}, whether that is all of ``model``).

    The 4-grams found 2 ** e times or more, for the least e that leaves ``frequent`` at most."""
    by_size = model.groupBy(F.floor(F.log2("n")).cast("int").alias("e")).count().collect()
    total, least, sizes = 0, None, dict((r["e"], r["count"]) for r in by_size)
    for e in sorted(sizes, reverse=True):
        if total + sizes[e] > frequent:
            break
        total, least = total + sizes[e], e
    out: dict[str, tuple] = {}
    if least is not None:
        rows = model.where(F.col("n") >= F.lit(2 ** least)).select("lang", "key", "log").toArrow()
        langs = rows.column("lang").combine_chunks().dictionary_encode()
        langs = langs.combine_chunks() if isinstance(langs, pa.ChunkedArray) else langs
        of, keys = langs.indices.to_numpy(), rows.column("key").to_numpy()
        logs = rows.column("log").to_numpy()
        for i, lang in enumerate(langs.dictionary.to_pylist()):
            at = np.flatnonzero(of == i)
            at = at[np.argsort(keys[at])]
            out[lang] = keys[at], logs[at]
    return out, total == sum(sizes.values())


def look(arrays: dict, lang: str, keys: np.ndarray) -> np.ndarray:
    """Logs of the codes, NaN where the arrays lack them."""
    have, logs = arrays.get(lang, (np.zeros(0, np.int64), np.zeros(0)))
    if not len(have):
        return np.full(len(keys), np.nan)
    at = np.minimum(np.searchsorted(have, keys), len(have) - 1)
    return np.where(have[at] == keys, logs[at], np.nan)


def repeated_window_words(words: list[bytes], width: int = 8) -> int:
    """Words in windows found twice or more; ``width`` a power of two."""
    n = len(words)
    if n <= width:
        return 0
    number: dict[bytes, int] = {}
    x = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    if len(number) == n:
        return 0
    step = 1
    while step < width:  # numbers of windows of 2, 4, 8 words: exact, not hashes
        pairs = x[:-step] * (x.max() + 1) + x[step:]
        kinds, x, count = np.unique(pairs, return_inverse=True, return_counts=True)
        if len(kinds) == len(pairs):
            return 0
        step *= 2
    found = np.zeros(n + 1, np.int64)
    twice = np.flatnonzero(count[x] > 1)
    found[twice] += 1
    found[twice + width] -= 1
    return int((np.cumsum(found[:-1]) > 0).sum())


def text_rules(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()] if b"\n" in text else []
    chars = b"".join(words).decode("utf-8", "replace")
    return (len(words), len(chars), sum(text.count(bytes([s])) for s in SYMBOLS),
            len(lines) - len(set(lines)), repeated_window_words(words))


def _score(arrays):
    names = ["id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
             "n_grams", "log_sum", "rare", "text_hash"]
    rare_type = pa.list_(pa.struct([("key", pa.int64()), ("n", pa.int64())]))

    def run(batches):
        import xxhash

        for b in (part for batch in batches for part in slices(batch, 2, CHUNK)):
            raw = [t.as_py() for t in b.column(2)]
            rules = list(zip(*map(text_rules, raw))) if raw else [[]] * 5
            texts, langs = [codes(t) for t in raw], b.column(1).to_pylist()
            n_grams, log_sum = np.zeros(len(raw), np.int64), np.zeros(len(raw))
            rare: list[list] = [[] for _ in raw]
            for lang, rows in _by_language(langs, texts):
                keys, of = grams([texts[i] for i in rows])
                kinds, at = np.unique(keys, return_inverse=True)
                logs = look(arrays.value, lang, kinds)
                lacking = np.isnan(logs)
                n_grams[rows] = np.bincount(of)
                log_sum[rows] = np.bincount(of, np.nan_to_num(logs)[at])
                if lacking.any():
                    far = np.flatnonzero(lacking[at])
                    pairs, count = np.unique(np.stack([of[far], at[far]]), axis=1, return_counts=True)
                    for (i, kind), n in zip(pairs.T, count):
                        rare[rows[i]].append({"key": int(kinds[kind]), "n": int(n)})
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), *(pa.array(c, pa.int64()) for c in rules),
                 pa.array(n_grams), pa.array(log_sum), pa.array(rare, rare_type),
                 pa.array(map(xxhash.xxh3_128_digest, raw), pa.binary())], names)

    return run


def _with_rare(scored: DataFrame, model: DataFrame) -> DataFrame:
    """``scored`` with the logs of the 4-grams that the arrays lack added to ``log_sum``."""
    asked = scored.where(F.size("rare") > 0).select("row", "lang", F.inline("rare"))
    found = asked.withColumnRenamed("n", "times").join(model, ["lang", "key"]).groupBy("row").agg(
        F.sum(F.col("times") * F.col("log")).alias("more"))
    return scored.join(found, "row", "left").withColumn(
        "log_sum", F.col("log_sum") + F.coalesce("more", F.lit(0.0))).drop("more")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          spread: float = 5.0, slack_words: int = 50, frequent: int = FREQUENT) -> DataFrame:
    """One row per document: ``id_col``, the text rules, base_failed, log_perplexity, the band
    (low, high) and kept. ``frequent``: 4-grams that are broadcast at most."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(lang_col).cast("string"),
                                                             F.lit("")).alias("lang"),
                       text_of(text_col).cast("binary").alias("text"))
    counts = rows.select("lang", "text").mapInArrow(_count, "lang string, key long, n long")
    counts = write_table(counts.groupBy("lang", "key").agg(F.sum("n").alias("n")),
                         "perplexity-grams")
    model = write_table(kneser_ney(counts), "perplexity-model")
    arrays, complete = frequent_arrays(model, frequent)
    kind = rows.schema["id"].dataType.simpleString()
    scored = write_table(rows.mapInArrow(
        _score(spark.sparkContext.broadcast(arrays)),
        f"id {kind}, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
        "n_repeat_words long, n_grams long, log_sum double, rare array<struct<key:long,n:long>>, "
        "text_hash binary").withColumn("row", F.monotonically_increasing_id()).withColumn(
            "salt", F.pmod("row", F.lit(SALTS)).cast("int")), "perplexity-scored")
    if not complete:
        scored = write_table(_with_rare(scored, model), "perplexity-summed")
    # a text of no characters has no perplexity
    scored = scored.withColumn("log_perplexity", F.when(
        F.col("n_grams") > 0, -F.col("log_sum") / F.col("n_grams"))).drop(
        "row", "rare", "log_sum", "n_grams")
    scored = scored.withColumn("base_failed", F.expr(
        "n_words < 20 OR 100 * n_repeat_words > 30 * n_words"))
    distinct = scored.where("NOT base_failed").groupBy("lang", "text_hash").agg(
        F.min("log_perplexity").alias("log_perplexity"))
    bands = distinct.groupBy("lang").agg(F.percentile_approx(
        "log_perplexity", [0.25, 0.75], 10_000).alias("q"))
    room = F.greatest(F.col("q")[1] - F.col("q")[0], F.lit(FLOOR)) * spread * F.sqrt(
        1 + F.lit(slack_words) / F.greatest("n_words", F.lit(1)))
    inside = F.expr("NOT base_failed AND log_perplexity BETWEEN low AND high")
    return scored.join(on_every_salt(bands), ["lang", "salt"], "left").withColumn(
        "low", F.col("q")[0] - room).withColumn("high", F.col("q")[1] + room).withColumn(
            "kept", F.coalesce(inside, F.lit(False))).drop(
                "lang", "q", "salt", "text_hash").withColumnRenamed("id", id_col)
