"""Event feeds with bad lines: good rows typed, bad lines kept with reason and place.

A permissive read turns a bad line into NULLs, a strict one ends the job; here a line is either
a typed row or a quarantined line, and blank lines are neither, so the three add up to the
lines of the feed. A line is bad if it is not JSON, not one object, has a value that its
column's type does not take, or has text after the object (which a plain read drops unseen).

A bad line's place is its file and the byte where it starts. Text splits begin mid-line, so the
byte is a two-level sum: over the lines before in the split, and over the file's splits before.
Only splits that hold bad lines are numbered inside, and there only line lengths move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .schemas import AUTH_SCHEMA, LISTEN_SCHEMA

_RAW, _ROW = "__raw", "__row"
NOT_JSON, NOT_OBJECT, WRONG_TYPE, MORE_TEXT = (
    "not JSON", "not an object", "wrong type", "text after the object")


def _text_follows(line: Column) -> Column:
    """True where the first object of a parsable line is not all of it."""
    bare = F.regexp_replace(line, r'"(?:[^"\\]|\\.)*"', "")
    steps = F.transform(F.regexp_extract_all(bare, F.lit(r"[\{\}\[\]]"), F.lit(0)),
                        lambda b: F.when(b.isin("{", "["), F.lit(1)).otherwise(F.lit(-1)))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("closed"))
    end = F.aggregate(steps, start, lambda s, d: F.struct(
        (s["depth"] + d).alias("depth"),
        (s["closed"] + F.when(s["depth"] + d == 0, 1).otherwise(0)).alias("closed")))
    # only a bracket that opens after one has closed can begin something else
    several = F.when(line.rlike(r"[\}\]][^\{\[]*[\{\[]"), end["closed"] > 1).otherwise(F.lit(False))
    return several | ~F.rtrim(F.regexp_replace(line, r"[\t\r]+$", "")).endswith("}")


def _judged(lines: DataFrame, col: str, schema: StructType) -> DataFrame:
    """``lines`` with the parsed row and, on bad lines, the reason; blank and NULL lines go."""
    with_raw = StructType([*schema.fields, StructField(_RAW, StringType())])
    line = F.col(col)
    kind = F.expr(f"schema_of_variant(try_parse_json(`{col}`))")
    found = lines.where(F.coalesce(line.rlike(r"\S"), F.lit(False))).withColumn(
        _ROW, F.from_json(line, with_raw, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _RAW}))
    return found.withColumn("reason", F.when(F.col(f"{_ROW}.{_RAW}").isNotNull(), F.when(
        kind.isNull(), NOT_JSON).when(~kind.startswith("OBJECT"), NOT_OBJECT).otherwise(WRONG_TYPE))
        .when(_text_follows(line), MORE_TEXT))


def _schema(schema: StructType | str) -> StructType:
    return StructType.fromDDL(schema) if isinstance(schema, str) else schema


def split_json(df: DataFrame, col: str, schema: StructType | str,
               keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(good, bad) of JSON text in a column: good rows have ``keep`` and the schema's columns,
    bad ones ``keep``, ``reason`` and ``line``. Each is a pass of its own over ``df``."""
    schema = _schema(schema)
    judged = _judged(df.select(*keep, F.col(col).alias("line")), "line", schema)
    good = judged.where("reason IS NULL").select(
        *keep, *[F.col(_ROW)[f.name].alias(f.name) for f in schema.fields])
    return good, judged.where("reason IS NOT NULL").select(*keep, "reason", "line")


def _lines(spark: SparkSession, path, **options) -> DataFrame:
    # with the separator fixed, a line's bytes and one more are its share of the file
    return spark.read.options(**options).option("lineSep", "\n").text(path).select(
        F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"))


def read_events_checked(spark: SparkSession, path, schema: StructType | str,
                        **options) -> tuple[DataFrame, DataFrame]:
    """(good, bad) of a folder of JSON lines: the typed rows, and file, offset, reason, line.

    ``offset``: the byte of the (unpacked) file where the line starts."""
    schema = _schema(schema)
    lines = _lines(spark, path, **options)
    good, _ = split_json(lines, "line", schema)

    numbered = _judged(lines.withColumn("seq", F.monotonically_increasing_id()), "line", schema)
    bad = numbered.where("reason IS NOT NULL").select("file", "block", "seq", "reason", "line")
    size = (F.octet_length("line") + 1).cast("long")
    sizes = lines.withColumn("seq", F.monotonically_increasing_id()).select(
        "file", "block", "seq", size.alias("size"))
    blocks = sizes.groupBy("file", "block").agg(F.sum("size").alias("size"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = blocks.select("file", "block", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("file", "block").orderBy("seq").rowsBetween(
        Window.unboundedPreceding, -1)
    touched = bad.select("file", "block").distinct()
    places = sizes.join(touched, ["file", "block"], "left_semi").withColumn(
        "at", F.coalesce(F.sum("size").over(inside), F.lit(0))).drop("size")
    placed = bad.join(places, ["file", "block", "seq"]).join(bases, ["file", "block"])
    return good, placed.select("file", (F.col("base") + F.col("at")).alias("offset"), "reason", "line")


def read_listen_events_checked(spark: SparkSession, path, **options) -> tuple[DataFrame, DataFrame]:
    return read_events_checked(spark, path, LISTEN_SCHEMA, **options)


def read_auth_events_checked(spark: SparkSession, path, **options) -> tuple[DataFrame, DataFrame]:
    return read_events_checked(spark, path, AUTH_SCHEMA, **options)


def line_counts(spark: SparkSession, path, **options) -> DataFrame:
    """One row: ``lines`` of the feed and how many of them are ``blank``."""
    return _lines(spark, path, **options).agg(
        F.count(F.lit(1)).alias("lines"),
        F.count(F.when(~F.col("line").rlike(r"\S"), 1)).alias("blank"))
