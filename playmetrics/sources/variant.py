"""Feeds of which no column is known: one pass finds the columns, then they are typed.

Inference that reads a sample misses rare columns, and reading every value as text loses their
types. Lines are parsed to VARIANT, their schemas are merged by an aggregate (partial per task;
what reaches the driver is one schema), and each top-level field becomes a column of the
merged type. Numbers that are sometimes fractions are DOUBLE, objects and arrays STRUCT and
ARRAY; a field that is always null, or whose values agree on no type, is STRING, holding such
values as JSON text. No value is lost: the schema comes from all lines.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_V = "__variant"


def _fields(schema: str) -> list[tuple[str, str]]:
    """[(name, type)] of the text ``OBJECT<name: type, ...>``."""
    inner, out, depth, start, quoted = schema[len("OBJECT<"):-1], [], 0, 0, False
    for i, c in enumerate(inner + ","):
        if c == "`":
            quoted = not quoted
        elif quoted:
            continue
        elif c in "<(":
            depth += 1
        elif c in ">)":
            depth -= 1
        elif c == "," and not depth and i > start:
            name, kind = re.fullmatch(r"\s*(`(?:[^`]|``)*`|[^:]*): (.*)", inner[start:i], re.S).groups()
            out.append((name[1:-1].replace("``", "`") if name.startswith("`") else name, kind))
            start = i + 1
    return out


def _type(kind: str) -> str:
    """The column type of a variant's type."""
    if kind.startswith("OBJECT<"):
        parts = [f"`{n.replace('`', '``')}`: {_type(k)}" for n, k in _fields(kind)]
        # an object without a field that differs only by case has a struct
        if not parts or len({n.lower() for n, _ in _fields(kind)}) < len(parts):
            return "STRING"
        return f"STRUCT<{', '.join(parts)}>"
    if kind.startswith("ARRAY<"):
        return f"ARRAY<{_type(kind[6:-1])}>"
    if kind.startswith("DECIMAL"):
        return "DOUBLE" if not kind.endswith(",0)") else kind
    return "STRING" if kind in ("VOID", "VARIANT") else kind


def infer_fields(df: DataFrame, col: str) -> list[tuple[str, str]]:
    """[(field, type)] of the JSON objects in a text column, by one pass over all rows."""
    merged = df.select(F.expr(f"try_parse_json(`{col}`)").alias(_V)).where(
        F.expr(f"schema_of_variant({_V}) LIKE 'OBJECT<%'")).agg(
        F.expr(f"schema_of_variant_agg({_V})").alias("s")).first()["s"]
    return [(n, _type(k)) for n, k in _fields(merged)] if merged and merged.startswith("OBJECT<") else []


def _field(name: str, kind: str):
    quote = "'" if "'" not in name else '"'
    if quote not in name:
        return F.try_variant_get(_V, f"$[{quote}{name}{quote}]", kind)
    # a path cannot hold both quotes
    one = F.col(_V).cast("map<string, variant>")[name]
    return F.try_variant_get(one, "$", kind)


def column_names(fields: list[tuple[str, str]], taken: tuple[str, ...] = ()) -> list[str]:
    """The fields' names as columns; one that differs only by case from one before, or from
    ``taken``, gets a number."""
    seen, out = {t.lower() for t in taken}, []
    for name, _ in fields:
        new, k = name, 2
        while new.lower() in seen:
            new, k = f"{name}_{k}", k + 1
        seen.add(new.lower())
        out.append(new)
    return out


def typed_columns(df: DataFrame, col: str, fields: list[tuple[str, str]] | None = None,
                  keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(rows, bad): ``keep`` and a column for each field; ``keep`` and the text of rows that are
    not a JSON object. ``fields``: from `infer_fields`, by default of all rows."""
    fields = infer_fields(df, col) if fields is None else fields
    parsed = df.select(*keep, F.col(col).alias("line"), F.expr(f"try_parse_json(`{col}`)").alias(_V))
    good = F.coalesce(F.expr(f"schema_of_variant({_V}) LIKE 'OBJECT<%'"), F.lit(False))
    columns = [_field(name, kind).alias(new)
               for (name, kind), new in zip(fields, column_names(fields, keep))]
    blank = ~F.coalesce(F.col("line").rlike(r"\S"), F.lit(False))
    return parsed.where(good).select(*keep, *columns), parsed.where(~good & ~blank).select(*keep, "line")


def read_events_inferred(spark: SparkSession, path, **options) -> tuple[DataFrame, DataFrame]:
    """(rows, bad) of a folder of JSON lines of unknown columns; two passes over the files."""
    lines = spark.read.options(**options).text(path).withColumnRenamed("value", "line")
    return typed_columns(lines, "line")
