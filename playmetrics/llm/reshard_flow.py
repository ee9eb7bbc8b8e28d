"""Resharding by minimum-cost flow: the block transfers that move the fewest bytes.

Old shard sizes are supplies, new capacities are demands, keeping a byte where it is costs
nothing and moving it costs its price; the flow is solved on the driver over shards only (their
number squared, not the data). A layout is a manifest, {shard: files}. The flow cuts each old
shard's files, in order, into one range a transfer: the first stays, the last ones move. A file
that lies wholly in one range changes its shard in the manifest and is not touched; only files
that a cut crosses are rewritten, each task writing the rows it reads to their shards, so no
text is shuffled. In a cut file the rows above a ``LARGE``-th of its bytes are dealt one by one,
the largest first, to the piece that lacks most; the others follow in file order, up to what
each piece then lacks. So a cut is off by half a small row, unless no dealing of rows can meet it.

The driver holds the list of files with a size each, as Spark's own reader does, and the at
most ``LARGE`` large rows of each cut file, of which there are no more than transfers. Row
offsets are summed inside cut files only, narrow rows, a file at a time; a very long text is
one row, never split. Null texts have size ``extra``; repeated rows are rows each; columns may have
any name; no files, no layout. Nothing is overwritten, so a job that dies leaves the old layout
whole.
"""

from __future__ import annotations

import heapq
import re
from typing import NamedTuple
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from playmetrics.llm.common import new_path, text_of


def min_cost_flow(supply: dict[int, int], capacity: dict[int, int], price=None) -> dict:
    """{(old, new): bytes} of least total price; the sums of both sides are equal.

    ``price(old, new)`` per byte, default 0 for old == new and 1 otherwise. Successive
    shortest paths in the residual graph, with potentials so that Dijkstra serves.
    """
    if sum(supply.values()) != sum(capacity.values()):
        raise ValueError("supplies and capacities differ in total")
    price = price or (lambda old, new: int(old != new))
    left, room, flow = dict(supply), dict(capacity), {}
    high = {("s", i): 0 for i in supply} | {("t", j): 0 for j in capacity}
    while any(left.values()):
        dist = {("s", i): 0 for i in left if left[i]}
        came, heap, done = {}, [(0, n) for n in dist], set()
        heapq.heapify(heap)
        while heap:
            d, node = heapq.heappop(heap)
            if node in done:
                continue
            done.add(node)
            side, k = node
            edges = ([(("t", j), price(k, j)) for j in capacity] if side == "s" else
                     [(("s", i), -price(i, k)) for i in supply if flow.get((i, k))])
            for other, cost in edges:
                # a first round has no potentials yet, and prices are not negative
                to = d + cost + high[node] - high[other]
                if to < dist.get(other, float("inf")):
                    dist[other], came[other] = to, node
                    heapq.heappush(heap, (to, other))
        far = max(dist.values())
        for n in high:
            high[n] += dist.get(n, far)
        end = min((n for n in dist if n[0] == "t" and room[n[1]]), key=lambda n: (high[n], n))
        path = [end]
        while path[-1] in came:
            path.append(came[path[-1]])
        path.reverse()
        back = [flow[(b[1], a[1])] for a, b in zip(path, path[1:]) if a[0] == "t"]
        amount = min([left[path[0][1]], room[end[1]], *back])
        for a, b in zip(path, path[1:]):
            key = (a[1], b[1]) if a[0] == "s" else (b[1], a[1])
            flow[key] = flow.get(key, 0) + (amount if a[0] == "s" else -amount)
        left[path[0][1]] -= amount
        room[end[1]] -= amount
    return {k: v for k, v in flow.items() if v}


def equal_capacities(total: int, shards: int) -> dict[int, int]:
    return {j: total // shards + (j < total % shards) for j in range(shards)}


def size_of(text_col: str, extra: int = 1) -> Column:
    return (F.octet_length(text_of(text_col)) + F.lit(extra)).cast("long")


Layout = dict[int, list[str]]
#: Rows above this fraction of their file's bytes are dealt one by one.
LARGE = 1000


class Resharded(NamedTuple):
    layout: Layout
    flow: dict
    #: The old files that were read and written anew; all others are in the new layout as they are.
    rewritten: list[str]


def _file() -> Column:
    return F.col("_metadata.file_path")


def _plain(path: str) -> str:
    return re.sub("^file:/+", "/", path)


def _named(reported: str) -> str:
    """A file's name in a layout, from what Spark reports (its escapes undone)."""
    return _plain(unquote(reported))


def _free_name(columns: list[str], name: str = "shard") -> str:
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def write_layout(rows: DataFrame, shard: Column, out: str | None = None) -> Layout:
    """``rows`` in Parquet files of ``out`` (the shared folder), none with rows of two shards.

    ``shard``: an integer, not null. Every task writes the rows it reads: nothing is shuffled."""
    spark, name = rows.sparkSession, _free_name(rows.columns)
    out = out or new_path(spark, "layout")
    rows.select("*", shard.cast("int").alias(name)).write.partitionBy(name).parquet(out)
    return _listed(spark, out, rows.schema, name)


def _listed(spark: SparkSession, folder: str, schema: StructType, name: str) -> Layout:
    """The files below ``folder`` by the partition column ``name``."""
    rows = spark.read.schema(StructType([*schema.fields, StructField(name, IntegerType())])).parquet(folder)
    layout: Layout = {}
    for r in rows.select(F.col(name).alias("s"), _file().alias("f")).distinct().orderBy("s", "f").collect():
        layout.setdefault(r["s"], []).append(_named(r["f"]))
    return layout


def _read(spark: SparkSession, files: list[str], schema=None) -> DataFrame:
    """(doc, file, row) of Parquet files; ``doc`` holds a row's own columns, whatever their names."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    # files of one folder: what its name says is no column
    return reader.option("recursiveFileLookup", True).parquet(*files).select(
        F.struct("*").alias("doc"), _file().alias("file"), F.col("_metadata.row_index").alias("row"))


def read_layout(spark: SparkSession, layout: Layout, schema) -> DataFrame:
    """(doc, shard, slot) of every row: ``doc`` a struct of ``schema``, ``slot`` gapless from 0
    in each shard, by file and row. Rows are not shuffled: a file's first slot is joined to them."""
    files = {_plain(f): j for j, fs in layout.items() for f in fs}
    if not files:
        return spark.createDataFrame([], schema).select(
            F.struct("*").alias("doc"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    rows = _read(spark, list(files), schema)
    counted = {_named(r["file"]): r for r in rows.groupBy("file").agg(F.count("*").alias("n")).collect()}
    starts, at = [], {}
    for f, j in files.items():
        if f in counted:
            starts.append((counted[f]["file"], j, at.get(j, 0)))
            at[j] = at.get(j, 0) + counted[f]["n"]
    table = spark.createDataFrame(starts, "file string, shard int, start long")
    return rows.join(F.broadcast(table), "file").select(  # a row a file
        "doc", "shard", (F.col("start") + F.col("row")).alias("slot"))


def _pieces(sizes: dict[int, list[tuple[str, int]]], flow: dict) -> tuple[dict, dict]:
    """({file: shard} of files in one range, {file: [(shard, bytes)]} of those that are cut)."""
    whole, cut = {}, {}
    for i, files in sizes.items():
        parts = sorted(([j, n] for (k, j), n in flow.items() if k == i), key=lambda x: (x[0] != i, x[0]))
        for f, size in files:
            got = []
            while size and parts:
                take = min(size, parts[0][1])
                got.append((parts[0][0], take))
                size, parts[0][1] = size - take, parts[0][1] - take
                if not parts[0][1]:
                    parts.pop(0)
            if len(got) > 1:
                cut[f] = got
            else:
                whole[f] = got[0][0] if got else i
    return whole, cut


def _deal(rows: list[tuple[int, int]], pieces: list[tuple[int, int]]) -> tuple[dict, list]:
    """({row: shard} of large ``rows`` (row, size), [(shard, bytes)] that the pieces still lack)."""
    heap = [(-n, k) for k, (_, n) in enumerate(pieces)]
    heapq.heapify(heap)
    out = {}
    for row, size in sorted(rows, key=lambda x: (-x[1], x[0])):
        n, k = heapq.heappop(heap)
        out[row] = pieces[k][0]
        heapq.heappush(heap, (n + size, k))
    lacks = {k: max(0, -n) for n, k in heap}
    return out, [(j, lacks[k]) for k, (j, _) in enumerate(pieces)]


def rewrite_affected(spark: SparkSession, layout: Layout, text_col: str, out: str, capacities=None,
                     shards: int = 16, price=None, schema=None) -> Resharded:
    """Reshard Parquet files; only those that a cut crosses are written anew, below ``out``.

    ``capacities``: {shard: bytes}, default equal ones for shards 0 to ``shards`` - 1."""
    layout = {j: [_plain(f) for f in layout[j]] for j in sorted(layout)}
    files = [f for fs in layout.values() for f in fs]
    if not files:
        return Resharded({}, {}, [])
    rows = _read(spark, files, schema)
    sized = rows.select("file", "row", size_of(f"doc.`{text_col}`").alias("size"))
    names = {r["file"]: r["b"] for r in sized.groupBy("file").agg(F.sum("size").alias("b")).orderBy(
        "file").collect()}
    total = {_named(n): b for n, b in names.items()}
    if not total.keys() <= set(files):
        raise ValueError("name files as Spark reports them, with their scheme and authority")
    sizes = {j: [(f, total[f]) for f in fs if f in total] for j, fs in layout.items()}
    supply = {j: sum(b for _, b in fs) for j, fs in sizes.items()}
    flow = min_cost_flow(supply, capacities or equal_capacities(sum(supply.values()), shards), price)
    whole, cut = _pieces(sizes, flow)
    new: Layout = {}
    for f, j in whole.items():
        new.setdefault(j, []).append(f)
    if cut:
        again = _read(spark, list(cut), rows.schema["doc"].dataType)
        size = size_of(f"doc.`{text_col}`")
        # names as the reader gives them, a row a cut file
        least = spark.createDataFrame(
            [(n, total[_named(n)] // LARGE) for n in names if _named(n) in cut], "of string, least long")
        sized = again.select("file", "row", size.alias("size")).join(
            F.broadcast(least), F.col("file") == F.col("of")).drop("of")
        large: dict = {}
        for r in sized.where("size > least").collect():
            large.setdefault(r["file"], []).append((r["row"], r["size"]))
        alone, ranges = [], []
        for n in (n for n in names if _named(n) in cut):
            dealt, lacks = _deal(large.get(n, []), cut[_named(n)])
            alone += [(n, row, j) for row, j in dealt.items()]
            at = 0
            for j, b in lacks:
                ranges.append((n, at, at + b, j))
                at += b
            ranges[-1] = (n, ranges[-1][1], 2 ** 62, ranges[-1][3])
        # at most LARGE rows, and a row a piece, for each cut file
        alone = F.broadcast(spark.createDataFrame(alone, "lf string, lrow long, lshard int"))
        ranges = F.broadcast(spark.createDataFrame(ranges, "rf string, lo long, hi long, rshard int"))
        inside = W.partitionBy("file").orderBy("row").rowsBetween(W.unboundedPreceding, -1)
        middle = F.coalesce(F.sum("size").over(inside), F.lit(0)) + F.floor(F.col("size") / 2)
        ends = sized.where("size <= least").withColumn("middle", middle).join(
            ranges, (F.col("file") == F.col("rf")) & (F.col("middle") >= F.col("lo"))
            & (F.col("middle") < F.col("hi"))).groupBy("rf", "lo", "rshard").agg(
            F.min("row").alias("first"), F.max("row").alias("last"))
        ends = F.broadcast(spark.createDataFrame(
            ends.select("rf", "rshard", "first", "last").collect(),
            "rf string, rshard int, first long, last long"))
        found = again.join(alone, (F.col("file") == F.col("lf")) & (F.col("row") == F.col("lrow")), "left")
        small = F.col("lshard").isNull() & (F.col("file") == F.col("rf")) & F.col("row").between(
            F.col("first"), F.col("last"))
        placed = found.join(ends, small, "left").select(
            "doc", F.coalesce("lshard", "rshard").alias("shard"))
        own = placed.select("doc.*").columns
        target = _free_name(own)
        placed.select("doc.*", F.col("shard").alias(target)).write.partitionBy(target).parquet(out)
        for j, fs in _listed(spark, out, rows.schema["doc"].dataType, target).items():
            new.setdefault(j, []).extend(fs)
    return Resharded({j: new[j] for j in sorted(new)}, flow, list(cut))
