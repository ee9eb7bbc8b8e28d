"""SimHash near-duplicates through pivot distance tables.

Each fingerprint gets its Hamming distances to reference fingerprints (pivots).
By the triangle inequality two fingerprints at distance d differ by at most d in
every coordinate, so a pair whose largest coordinate difference exceeds the
limit is discarded and the survivors are verified bit by bit.

The table also deals the work out. Beside a first pivot, the pivots come in
``limit + 1`` groups; those of a group differ from the first only inside the
group's own block of bits, so the differences of their distances to the first
distance depend on that block alone. Fingerprints within ``limit`` bits agree on
a whole block, hence on a group's differences: these are the bucket keys. A
bucket of more than ``max_bucket`` fingerprints is dealt again in the same way by
the bits that its members may still differ in, until none is left.

Only distinct fingerprints take part; buckets give spanning links, not pairs;
components come from min-label hooking and pointer jumping over tables.

Null and empty texts have fingerprint 0. Null ids join a group but never name it
unless all its ids are null. Repeated rows get a row each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from playmetrics.llm.common import text_of, write_table

#: Fixed seed of the pivots.
SEED = 42
PER_GROUP = 8
SMALL = 16
MAX_BUCKET = 20_000


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 (seed 42) of the ``width``-word shingles of A-Z lower-cased ``text``."""
    import xxhash

    words = text.lower().split()  # bytes: ASCII letters and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[:len(words) - width + 1].tolist()
    ends = (ends[width - 1:] - 1).tolist()
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(joined[a:b], 42) for a, b in zip(starts, ends)), np.uint64, len(ends))


def simhash(text: bytes, width: int) -> int:
    """A bit is 1 if it is set in over half the shingles."""
    hashes, ones = shingle_hashes(text, width), np.zeros(64, np.int64)
    for a in range(0, len(hashes), 1 << 16):  # long texts: bounded memory
        part = hashes[a:a + (1 << 16)].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(
            0, dtype=np.int64)
    bits = ones * 2 > len(hashes)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, width: int = 3,
                 keep=()) -> DataFrame:
    """(id, fp, keep...): ``fp`` as a signed long."""
    rows = docs.select(F.col(id_col).alias("id"), *keep, text_of(text_col).cast("binary")
                       .alias("text"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, " + "".join(
        f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in keep) + "fp long"

    def scan(batches):
        for b in batches:
            texts = b.column(b.num_columns - 1)
            fps = pa.array([simhash(t.as_py(), width) for t in texts], type=pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], fps], ["id", *keep, "fp"])

    return rows.mapInArrow(scan, schema)


def blocks_of(bits: list[int], n: int) -> list[list[int]]:
    return [list(map(int, x)) for x in np.array_split(bits, n)]


def mask_of(bits) -> int:
    return sum(1 << b for b in bits)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def pivots(limit: int) -> list[list[int]]:
    """[[first], group 0, group 1, ...]; each group's pivots flip bits of its block only."""
    rng = np.random.default_rng(SEED)
    first = int(rng.integers(0, 1 << 63)) * 2 + 1
    out = [[first]]
    for block in blocks_of(range(64), limit + 1):
        group = []
        for _ in range(PER_GROUP):
            chosen = [b for b in block if rng.random() < 0.5] or block[:1]
            group.append(first ^ mask_of(chosen))
        out.append(group)
    return out


def _bucket_keys(fp: Column, limit: int) -> Column:
    """Array of (path, key): the group and its differences."""
    (first,), *groups = pivots(limit)
    far = lambda p: F.bit_count(fp.bitwiseXOR(F.lit(signed(p))))
    keys = []
    for g, group in enumerate(groups):
        key = F.lit(0).cast("long")
        for p in group:  # a difference lies in -64..64
            key = F.shiftleft(key, 8).bitwiseOR((far(p) - far(first) + 64).cast("long"))
        keys.append(F.struct(F.lit(str(g)).alias("path"), key.alias("key")))
    return F.array(*keys)


def _rest(path: str, limit: int) -> list[int]:
    """The bits that members of a bucket with this path may differ in."""
    bits = list(range(64))
    for g in path.split("."):
        gone = set(blocks_of(bits, limit + 1)[int(g)])
        bits = [b for b in bits if b not in gone]
    return bits


def _dealt_again(hot: DataFrame, paths: list[str], limit: int) -> DataFrame:
    """Rows of too large buckets, by the blocks of the bits they may still differ in."""
    # the bits of a block: distances to the references that have one of them each
    masks = hot.sparkSession.createDataFrame(
        [(path, f"{path}.{g}", signed(mask_of(block))) for path in paths
         for g, block in enumerate(blocks_of(_rest(path, limit), limit + 1))],
        "path string, next string, mask long")
    # limit + 1 rows a path, and paths are as many as the dealing is deep
    return hot.join(F.broadcast(masks), "path").select("fp", F.col("next").alias("path"), F.xxhash64(
        "key", F.col("fp").bitwiseAND(F.col("mask"))).alias("key"))


def bucket_links(fps: np.ndarray, table: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Spanning links of one bucket: (index, index). ``table``: a row of distances for each."""
    order = np.argsort(table[:, 0], kind="stable")
    fps, table = fps[order], table[order]
    n = len(fps)
    label, links = np.arange(n), []

    def root(x):
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    ends = np.searchsorted(table[:, 0], table[:, 0] + limit, side="right")
    for a in range(0, n, 256):
        b = min(n, a + 256)
        hi = ends[b - 1]
        near = np.abs(table[a:b, None, 0] - table[None, a:hi, 0]) <= limit
        i, j = np.nonzero(np.triu(near, 1))
        i, j = i + a, j + a
        for c in range(1, table.shape[1]):
            ok = np.abs(table[i, c] - table[j, c]) <= limit
            i, j = i[ok], j[ok]
        ok = np.bitwise_count(fps[i] ^ fps[j]) <= limit
        i, j = i[ok], j[ok]
        while len(i):
            flat = label
            while True:  # labels to roots, all at once
                up = flat[flat]
                if (up == flat).all():
                    break
                flat = up
            label = flat
            differ = label[i] != label[j]
            i, j = i[differ], j[differ]
            if not len(i):
                break
            _, one = np.unique(np.minimum(label[i], label[j]) * n + np.maximum(
                label[i], label[j]), return_index=True)
            for x, y in zip(i[one].tolist(), j[one].tolist()):
                p, q = root(x), root(y)
                if p != q:
                    label[max(p, q)] = min(p, q)
                    links.append((int(order[x]), int(order[y])))
    return links


def _link_buckets(limit: int):
    flat = np.array([p for group in pivots(limit) for p in group], dtype=np.uint64)

    def bucket(fps):
        table = np.bitwise_count(fps[:, None] ^ flat[None, :]).astype(np.int8)
        return [(fps[i], fps[j]) for i, j in bucket_links(fps, table, limit)]

    def run(batches):
        held_key, held = None, []
        for b in batches:  # sorted by bucket; one may go on in the next batch
            fps = b.column(0).to_numpy().view(np.uint64)
            keys = b.column(2).to_numpy()
            paths = b.column(1).dictionary_encode()
            path = paths.indices.to_numpy()
            starts = np.flatnonzero(np.concatenate((
                [True], (keys[1:] != keys[:-1]) | (path[1:] != path[:-1])))).tolist()
            names, out = paths.dictionary.to_pylist(), []
            for a, z in zip(starts, [*starts[1:], len(fps)]):
                here = (names[path[a]], keys[a])
                if here != held_key:
                    if sum(map(len, held)) > 1:
                        out += bucket(np.concatenate(held))
                    held_key, held = here, []
                held.append(fps[a:z])
            if out:
                yield _links_batch(out)
        if sum(map(len, held)) > 1 and (out := bucket(np.concatenate(held))):
            yield _links_batch(out)

    return run


def _links_batch(links):
    a, b = (np.array(x, dtype=np.uint64).view(np.int64) for x in zip(*links))
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def links(fps: DataFrame, limit: int = 2, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """Distinct fingerprints (column ``fp``) to links (a, b) that span each component.

    Buckets of more than ``max_bucket`` are dealt again (never those of ``SMALL`` or fewer, whose
    pairs are sooner compared than dealt)."""
    max_bucket = max(max_bucket, SMALL)
    rows = fps.select("fp", F.explode(_bucket_keys(F.col("fp"), limit)).alias("b")).select(
        "fp", "b.path", "b.key")
    done = None
    while True:
        hot = write_table(rows.groupBy("path", "key").count().where(
            F.col("count") > max_bucket).select("path", "key"), "simhash-hot")
        paths = [r["path"] for r in hot.select("path").distinct().collect()]
        # a path with ``limit`` bits left or fewer cannot be dealt again: its buckets stay as they are
        paths = [p for p in paths if len(_rest(p, limit)) > limit]
        hot = hot.where(F.col("path").isin(paths))
        cool = rows.join(hot, ["path", "key"], "left_anti") if paths else rows
        done = cool if done is None else done.unionByName(cool)
        if not paths:
            break
        rows = write_table(_dealt_again(rows.join(hot, ["path", "key"], "left_semi"), paths,
                                        limit), "simhash-dealt")
    done = done.select("fp", "path", "key").repartition("path", "key").sortWithinPartitions(
        "path", "key")
    return done.mapInArrow(_link_buckets(limit), "a long, b long").distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each component of the links (a, b).

    Each round a node and its label take the smallest label next to them, then labels jump to
    their labels' labels; rounds grow with the logarithm of the longest path.
    """
    both = write_table(edges.select("a", "b").union(edges.select("b", "a")), "links")
    labels = write_table(both.select(F.col("a").alias("node")).distinct().withColumn(
        "label", F.col("node")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(
            F.min("label").alias("near")).withColumnRenamed("a", "node")
        met = labels.join(near, "node").withColumn("to", F.least("label", "near"))
        hooked = met.select("node", "to").union(met.select("label", "to")).groupBy("node").agg(
            F.min("to").alias("label"))
        hooked = write_table(hooked, "labels")
        jumped = hooked.join(hooked.select(F.col("node").alias("label"), F.col("label").alias(
            "up")), "label").select("node", F.col("up").alias("label"))
        after = write_table(jumped, "labels")
        changed = after.join(labels.withColumnRenamed("label", "was"), "node").where(
            "label <> was").limit(1).count()
        labels = after
        if not changed:
            return labels


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3,
               limit: int = 2, max_bucket: int = MAX_BUCKET, keep=()) -> DataFrame:
    """One row per document: ``id_col``, ``keep``, ``fp``, ``component`` (its smallest id) and
    ``group`` (the same for a component's documents, also where all ids are null)."""
    marked = write_table(fingerprints(docs, id_col, text_col, width, keep), "simhash")
    fps = write_table(marked.groupBy("fp").agg(F.min("id").alias("first")), "simhash-distinct")
    labels = connected(links(fps, limit, max_bucket))
    named = fps.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "label", F.coalesce("label", "fp"))
    smallest = named.groupBy("label").agg(F.min("first").alias("component"))
    named = write_table(named.join(smallest, "label").select(
        "fp", "component", F.col("label").alias("group")), "simhash-components")
    return marked.join(named, "fp").select(
        F.col("id").alias(id_col), *keep, "fp", "component", "group")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                         width: int = 3, limit: int = 2) -> DataFrame:
    """``docs`` with one row of each component, that of the smallest id (then any one row)."""
    names = docs.columns
    numbered = write_table(docs.select(
        *[F.col(c).alias(f"c{i}") for i, c in enumerate(names)],
        F.monotonically_increasing_id().alias("n")), "simhash-docs")
    at, key = f"c{names.index(text_col)}", f"c{names.index(id_col)}"
    found = components(numbered, key, at, width, limit, keep=("n",))
    first = found.groupBy("group").agg(F.min(F.struct(
        F.col(key).isNull().alias("no"), F.col(key).alias("id"), "n")).alias("m"))
    return numbered.join(first.select(F.col("m.n").alias("n")), "n", "left_semi").select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
