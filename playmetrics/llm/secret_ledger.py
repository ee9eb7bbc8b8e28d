"""Secret scans over an incremental blob ledger, in DataFrame operations only.

A version of a document is a (path, text) row. Its text is addressed by its
SHA-256. The ledger, a Parquet table, holds for every blob the rules and rule
versions that have been run on it and the spans they found, so a later run
scans only (blob, rule version) pairs it has not seen, whatever paths the
blob turns up under; findings go back to all paths by a join on the blob id.

One row per blob is picked by (blob, smallest path), a key that a hot group
of copies does not concentrate, so the text is joined without a skewed key.

Spans count code points, end exclusive. Positions come from the gaps between
matches: ``split`` gives the text between them and ``regexp_extract_all`` the
matches, so the running sum of both lengths is each match's end.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from playmetrics.llm.common import new_path, text_of, write_table


@dataclass(frozen=True)
class Rule:
    """``pattern`` in Java syntax; a match counts if group ``group`` has ``least`` characters."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1


BASE_RULES = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?"""
                      r"""([A-Za-z0-9+/_.=-]+)""", 2, 8),
    # a maximal run of 12 or more is the run of one or more that passes the length test
    Rule("access", 1, "AKIA[A-Z0-9]{12,}"),
    Rule("hex", 1, "[0-9a-f]{32,}"),
)
#: Kinds beside the base ones; they add spans.
MORE_RULES = (
    Rule("pem", 1, "-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("forge", 1, "gh[pousr]_[A-Za-z0-9]{36,}"),
)
RULES = BASE_RULES + MORE_RULES

_SPANS = "array<struct<start:int,end:int>>"
_SCANS = f"array<struct<kind:string,version:int,spans:{_SPANS}>>"
LEDGER_SCHEMA = f"blob binary, scans {_SCANS}"


def running_sums(a: Column, block: int = 256) -> Column:
    """Running sums of an int array, in blocks so that long arrays stay cheap."""
    def sums(x: Column) -> Column:
        start = F.struct(F.array().cast("array<int>").alias("acc"), F.lit(0).alias("s"))
        return F.aggregate(x, start, lambda st, v: F.struct(
            F.concat(st["acc"], F.array(st["s"] + v)).alias("acc"), (st["s"] + v).alias("s")),
            lambda st: st["acc"])

    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(a) - 1) / block).cast("int")),
        lambda i: sums(F.slice(a, i * block + 1, F.lit(block))))
    start = F.struct(F.array().cast("array<array<int>>").alias("acc"), F.lit(0).alias("s"))
    shifted = F.aggregate(blocks, start, lambda st, b: F.struct(
        F.concat(st["acc"], F.array(F.transform(b, lambda v: v + st["s"]))).alias("acc"),
        (st["s"] + F.element_at(b, -1)).alias("s")), lambda st: st["acc"])
    return F.when(F.size(a) > 0, F.flatten(shifted)).otherwise(F.array().cast("array<int>"))


def _spans(text: Column, rule: Rule) -> Column:
    pattern = F.lit(rule.pattern)
    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    values = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else hits
    steps = F.zip_with(F.split(text, rule.pattern, -1), hits,
                       lambda gap, hit: F.length(gap) + F.length(hit))
    # split gives one part more than there are hits: the last step is null
    ends = running_sums(F.slice(steps, F.lit(1), F.size(hits)))
    found = F.zip_with(ends, F.zip_with(hits, values, lambda h, v: F.struct(
        F.length(h).alias("n"), F.length(v).alias("v"))), lambda e, h: F.struct(
        (e - h["n"]).alias("start"), e.alias("end"), h["v"].alias("v")))
    kept = F.transform(F.filter(found, lambda s: s["v"] >= rule.least),
                       lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    return F.when(text.rlike(rule.pattern), kept).otherwise(F.array().cast(_SPANS)).cast(_SPANS)


def _pair(rule: Rule) -> Column:
    return F.struct(F.lit(rule.kind).alias("kind"), F.lit(rule.version).alias("version"))


def update_ledger(versions: DataFrame, path_col: str, text_col: str, rules=RULES,
                  ledger: str | None = None) -> str:
    """Scan what ``ledger`` (a folder; None: a new one) has not seen; returns the folder.

    Null text: empty. Null or repeated paths, repeated rows: the blob is scanned once for
    the ledger. No rows: nothing is added. Running the same versions again adds nothing.
    """
    spark = versions.sparkSession
    known = None
    if ledger is None:
        ledger = new_path(spark, "secret-ledger")
        spark.createDataFrame([], LEDGER_SCHEMA).write.parquet(ledger)
    else:
        known = read_ledger(spark, ledger)
    rows = versions.select(F.col(path_col).alias("path"), text_of(text_col).alias("text"))
    rows = rows.select("path", "text", F.unhex(F.sha2("text", 256)).alias("blob"))
    every = F.array(*[_pair(r) for r in rules])
    pending = rows.groupBy("blob").agg(F.min("path").alias("rep"))
    if known is None:
        pending = pending.select("blob", "rep", every.alias("todo"))
    else:
        seen = known.select("blob", F.transform("scans", lambda s: F.struct(
            s["kind"].alias("kind"), s["version"].alias("version"))).alias("seen"))
        pending = pending.join(seen, "blob", "left").select(
            "blob", "rep", F.array_except(every, F.coalesce("seen", F.array().cast(
                "array<struct<kind:string,version:int>>"))).alias("todo")).where(F.size("todo") > 0)
    texts = rows.alias("r").join(
        pending.alias("p"), (F.col("r.blob") == F.col("p.blob"))
        & F.col("r.path").eqNullSafe(F.col("p.rep"))).select("r.blob", "text", "todo")
    # names of its own, so that no later step can run a pattern twice on a text
    found = texts.select("blob", "todo", *[
        F.when(F.array_contains("todo", _pair(r)), _spans(F.col("text"), r)).alias(f"s{i}")
        for i, r in enumerate(rules)])
    scans = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"),
                               F.col(f"s{i}").alias("spans")) for i, r in enumerate(rules)])
    fresh = found.select("blob", F.filter(scans, lambda s: s["spans"].isNotNull()).alias("scans"))
    fresh = fresh.groupBy("blob").agg(F.first("scans").alias("scans"))  # repeated rows
    fresh.select("blob", F.col("scans").cast(_SCANS).alias("scans")).write.mode("append").parquet(
        ledger)
    return ledger


def read_ledger(spark, ledger: str) -> DataFrame:
    """One row per blob: all scans of it, each rule version once.

    A blob gets a new row for each run that added to it; two runs at a time may both have
    scanned it, with the same spans. Equal scans are one before a blob's rows meet."""
    rows = spark.read.schema(LEDGER_SCHEMA).parquet(ledger)
    return rows.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_set("scans"))).alias("scans"))


def findings(versions: DataFrame, path_col: str, text_col: str, ledger: str,
             rules=RULES, keep=()) -> DataFrame:
    """Every version row with its spans of ``rules``, by start, then rule as listed.

    Columns: ``path_col``, ``keep``, and ``spans``: array of (start, rank, end, kind). A version
    whose blob the ledger lacks has null spans.
    """
    spark = versions.sparkSession
    current = {(r.kind, r.version): i for i, r in enumerate(rules)}
    listed = F.flatten(F.transform("scans", lambda s: F.transform(s["spans"], lambda x: F.struct(
        x["start"].alias("start"),
        F.coalesce(*[F.when((s["kind"] == k) & (s["version"] == v), F.lit(i))
                     for (k, v), i in current.items()]).alias("rank"),
        x["end"].alias("end"), s["kind"].alias("kind")))))
    known = write_table(read_ledger(spark, ledger).select("blob", F.array_sort(F.filter(
        listed, lambda x: x["rank"].isNotNull())).alias("spans")), "secret-findings")
    rows = versions.select(path_col, *keep, F.unhex(F.sha2(text_of(text_col), 256)).alias("__blob"))
    return rows.join(known.select(F.col("blob").alias("__blob"), F.col("spans").alias("__spans")),
                     "__blob", "left").select(
        path_col, *keep, F.col("__spans").alias("spans"))


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with every span (sorted by start) replaced by ``mark``, overlapping ones as one."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    def add(st: Column, s: Column) -> Column:
        gap = F.when(s["start"] >= st["at"], F.concat(F.substr(
            text, st["at"] + 1, s["start"] - st["at"]), F.lit(mark))).otherwise(F.lit(""))
        return F.struct(F.greatest(st["at"], s["end"]).alias("at"),
                        F.concat(st["out"], F.array(gap)).alias("out"))
    whole = F.aggregate(spans, start, add, lambda st: F.concat(
        F.array_join(st["out"], ""), F.substr(text, st["at"] + 1)))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def redact_secrets(docs: DataFrame, id_col: str, text_col: str, rules=RULES,
                   ledger: str | None = None) -> DataFrame:
    """``docs`` with the same columns and rows; secrets in ``text_col`` become a mark.

    A null text stays null; a text without secrets stays as it is.
    """
    ledger = update_ledger(docs, id_col, text_col, rules, ledger)
    names = docs.columns
    inner = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(names)])
    at = f"c{names.index(text_col)}"
    found = findings(inner, at, at, ledger, rules,
                     keep=[f"c{i}" for i in range(len(names)) if f"c{i}" != at])
    return found.select(*[(redacted(F.col(f"c{i}"), F.col("spans")) if f"c{i}" == at
                           else F.col(f"c{i}")).alias(c) for i, c in enumerate(names)])
