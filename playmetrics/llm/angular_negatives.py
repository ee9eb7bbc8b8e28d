"""Hard negatives of anchor rows, found by integer scores behind angular bounds.

Vector components c become integers floor(scale * c); a row's score is its integer inner
product with the anchor, higher scores first, ties by smaller id. Each row stores its angles to
a few reference directions. The triangle inequality of angles gives an interval for the angle
of anchor and row, hence for their cosine; multiplied by both norms and widened by more than
all rounding can do, that is an interval for the score. Only rows whose interval overlaps what
an anchor looks for are scored: for positives, scores from its last positive so far upwards; for
negatives, the hull of its windows, each from its last negative so far upwards. The scores are
exact, so the references (of a bounded sample of ``sample`` rows, each far from those before)
decide what is skipped and never the result.

Anchors and rows are packed into blocks and chunks and meet in the cells of a grid, each of
bounded bytes: a chunk is copied to every group of blocks, a block to every slot of chunks.
A cell returns its best few rows for each anchor; the best of those over all cells are ranked
per anchor. No label, vector or id is a key, so none can be hot, and nothing but the sample
reaches the driver. Blocks and chunks are tables of their own, so a lost executor repeats a
step at most.

Rows with a null id, label or vector, or a null or non-finite component take no part. Shorter
vectors end in zeros; a vector of zeros scores 0. Rows are told apart by id: an anchor's other
rows are those of another id, and rows that share an id count each. No anchors, no rows or no
second label: no result. A score beyond a long is an error. Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from playmetrics.llm import vectors as vec
from playmetrics.llm.common import shuffle_partitions, write_table

#: Anchors in a block and rows in a chunk, at most; entries of a pair are worked on at once.
BLOCK, CHUNK = 512, 2048
#: Bytes of chunks, and of blocks, in a cell.
CELL = 64 << 20
#: Where fewer pairs than this share are left, they are scored one by one.
SPARSE = 0.05


def reference_directions(rows: DataFrame, id_col: str, vector_col: str, dims: int, scale: int,
                         count: int, sample: int) -> np.ndarray:
    """Unit rows: vectors of a sample, each the farthest in angle from those before."""
    picked = rows.orderBy(F.xxhash64(id_col), id_col).limit(sample).select(vector_col).collect()
    x = np.zeros((len(picked), dims))
    for i, r in enumerate(picked):
        x[i, :len(r[0])] = r[0]
    x = np.floor(scale * x)
    norms = np.linalg.norm(x, axis=1)
    x = x[norms > 0] / norms[norms > 0, None]
    out = []
    nearest = np.full(len(x), -np.inf)
    for _ in range(min(count, len(x))):
        k = int(nearest.argmin()) if out else 0
        if out and nearest[k] > 1 - 1e-12:
            break
        out.append(x[k])
        nearest = np.maximum(nearest, np.abs(x @ x[k]))  # an opposite says as little as a copy
    return np.array(out).reshape(len(out), dims)


class Rows:
    """A block or chunk: ids, labels, integer vectors, norms, angles (reference, row)."""

    def __init__(self, ids, labels, x, references):
        self.ids, self.labels, self.x = ids, labels, x
        y = x.astype(np.float64)
        self.norms = np.linalg.norm(y, axis=1)
        cosines = y @ references.T / np.maximum(self.norms, 1.0)[:, None]
        angles = np.arccos(np.clip(cosines, -1, 1))
        angles[self.norms == 0] = 0.0
        self.angles = np.ascontiguousarray(angles.T.astype(np.float32))

    FIELDS = "ids binary, labels binary, x binary, width int, norms binary, angles binary"

    def fields(self) -> list:
        """Values of ``FIELDS``."""
        size = int(np.abs(self.x).max(initial=0))
        width = next(w for w in (2, 4, 8) if w == 8 or size < 2 ** (8 * w - 1))
        return [self.ids.tobytes(), self.labels.tobytes(), self.x.astype(f"<i{width}").tobytes(),
                width, self.norms.tobytes(), self.angles.tobytes()]

    @classmethod
    def of(cls, row: dict, dims: int) -> Rows:
        out = cls.__new__(cls)
        out.ids = np.frombuffer(row["ids"], np.int64)
        n = len(out.ids)
        out.labels = np.frombuffer(row["labels"], np.int64)
        out.x = np.frombuffer(row["x"], f"<i{row['width']}").reshape(n, dims)
        out.norms = np.frombuffer(row["norms"], np.float64)
        out.angles = np.frombuffer(row["angles"], np.float32).reshape(-1, n)
        return out

    def part(self, at) -> Rows:
        out = Rows.__new__(Rows)
        out.ids, out.labels, out.x = self.ids[at], self.labels[at], self.x[at]
        out.norms, out.angles = self.norms[at], self.angles[:, at]
        return out


def pack(rows: DataFrame, dims: int, scale: int, references: np.ndarray, most: int,
         label: str) -> DataFrame:
    """(key, n, bytes, `Rows.FIELDS`) of ``rows`` (id, label, vector), ``most`` rows in each."""
    def run(batches):
        for whole in batches:
            step = min(most, max(1, vec.SLICE // max(dims, 1)))
            for i in range(0, len(whole), step):
                b = whole.slice(i, step)
                x = vec.floors(vec.matrix(b.column(2), dims), scale)
                got = Rows(b.column(0).to_numpy(), b.column(1).to_numpy(), x, references).fields()
                size = sum(len(f) for f in got if isinstance(f, bytes))
                yield pa.RecordBatch.from_pylist([dict(zip(
                    ["n", "bytes", "ids", "labels", "x", "width", "norms", "angles"],
                    [len(b), size, *got]))], schema)

    schema = pa.schema([("n", pa.int64()), ("bytes", pa.int64()), ("ids", pa.binary()),
                        ("labels", pa.binary()), ("x", pa.binary()), ("width", pa.int32()),
                        ("norms", pa.binary()), ("angles", pa.binary())])
    out = rows.mapInArrow(run, "n long, bytes long, " + Rows.FIELDS)
    return write_table(out.select(F.monotonically_increasing_id().alias("key"), "*"), label)


def score_bounds(a: Rows, b: Rows, dims: int):
    """(low, high), float32: no score of a pair lies outside."""
    shape = (len(a.ids), len(b.ids))
    near, far = np.zeros(shape, np.float32), np.full(shape, np.pi, np.float32)
    work = np.empty(shape, np.float32)
    for s, t in zip(a.angles, b.angles):
        np.subtract(s[:, None], t[None], out=work)
        np.abs(work, out=work)
        np.maximum(near, work, out=near)
        np.add(s[:, None], t[None] - np.float32(np.pi), out=work)
        np.abs(work, out=work)
        np.subtract(np.float32(np.pi), work, out=work)
        np.minimum(far, work, out=far)
    # arccos near 0, single precision of angles and cosines
    slack = np.float32(1e-5 + 4 * math.sqrt(2 * (dims + 8) * np.finfo(np.float64).eps))
    near -= slack
    far += slack
    np.clip(near, 0, np.pi, out=near)
    np.clip(far, 0, np.pi, out=far)
    np.cos(near, out=near)
    np.cos(far, out=far)
    norms = (a.norms[:, None] * b.norms[None]).astype(np.float32)
    margin = norms * np.float32(1e-5) + 1
    near *= norms
    near += margin
    far *= norms
    far -= margin
    return far, near


def exact_scores(a: np.ndarray, b: np.ndarray, norms: float) -> np.ndarray:
    """All inner products of integer rows; ``norms``: the largest product of two norms."""
    if norms < 2.0 ** 52:  # no sum on the way reaches 2 ** 53
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if norms < 2.0 ** 62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    out = a.astype(object) @ b.astype(object).T
    if abs(out).max() >= 2 ** 63:
        raise OverflowError("a score does not fit a long")
    return out.astype(np.int64)


def scored(a: Rows, b: Rows, left: np.ndarray):
    """(i, j, score) of the pairs marked in ``left``."""
    i, j = np.nonzero(left)
    if not len(i):
        return i, j, np.zeros(0, np.int64)
    norms = float(a.norms.max() * b.norms.max())
    if len(i) > SPARSE * left.size or norms >= 2.0 ** 62:
        rows, columns = np.flatnonzero(left.any(1)), np.flatnonzero(left.any(0))
        all_of = exact_scores(a.x[rows], b.x[columns], norms)
        return i, j, all_of[np.searchsorted(rows, i), np.searchsorted(columns, j)]
    out = [(a.x[i[k:k + 8192]].astype(np.int64) * b.x[j[k:k + 8192]]).sum(1)
           for k in range(0, len(i), 8192)]
    return i, j, np.concatenate(out)


class Best:
    """The best ``k`` (score, id) for each of so many slots: high scores, then small ids."""

    def __init__(self, slots: int, k: int):
        self.k, self.held = k, [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * slots
        self.bar = np.full(slots, -np.inf)  # scores below cannot enter

    def add(self, slot: int, scores: np.ndarray, ids: np.ndarray) -> None:
        s, d = (np.concatenate(x) for x in zip(self.held[slot], (scores, ids)))
        order = np.lexsort((d, -s))[:self.k]
        self.held[slot] = s[order], d[order]
        if len(order) == self.k:
            self.bar[slot] = s[order[-1]]


def _runs(i: np.ndarray):
    """(value, start, end) of the runs of a sorted array."""
    if len(i):
        cuts = np.flatnonzero(np.diff(i)) + 1
        for start, end in zip([0, *cuts], [*cuts, len(i)]):
            yield int(i[start]), start, end


def _positives(a: Rows, chunks: list[Rows], dims: int, k: int, tally: list):
    """Best of the other rows with the anchor's label; ``tally``: pairs seen, pairs scored."""
    best = Best(len(a.ids), k)
    groups = [(label, np.flatnonzero(a.labels == label)) for label in np.unique(a.labels)]
    for b in chunks:
        for label, at in groups:
            columns = np.flatnonzero(b.labels == label)
            if not len(columns):
                continue
            some, others = a.part(at), b.part(columns)
            _, high = score_bounds(some, others, dims)
            left = high >= best.bar[at][:, None]
            left &= some.ids[:, None] != others.ids[None]
            i, j, s = scored(some, others, left)
            tally[0] += left.size
            tally[1] += len(i)
            keep = s >= best.bar[at][i]
            i, j, s = i[keep], j[keep], s[keep]
            for row, x, y in _runs(i):
                best.add(int(at[row]), s[x:y], others.ids[j[x:y]])
    return best


def _negatives(a: Rows, windows: np.ndarray, chunks: list[Rows], dims: int, k: int, tally: list):
    """Best rows of other labels in each window; ``windows``: (anchor, low, high) by anchor."""
    best = Best(len(windows), k)
    own = {row: (x, y) for row, x, y in _runs(windows[:, 0])}
    low, high = windows[:, 1], windows[:, 2]
    bottom, top = np.full(len(a.ids), np.inf), np.full(len(a.ids), -np.inf)
    for b in chunks:
        lows = np.maximum(low.astype(np.float64), best.bar)  # a window from its last row so far
        for row, (x, y) in own.items():
            bottom[row], top[row] = lows[x:y].min(), high[x:y].max()
        least, most = score_bounds(a, b, dims)
        left = (most >= bottom[:, None]) & (least <= top[:, None])
        left &= a.labels[:, None] != b.labels[None]
        i, j, s = scored(a, b, left)
        tally[0] += left.size
        tally[1] += len(i)
        keep = (s >= bottom[i]) & (s <= top[i])
        i, j, s = i[keep], j[keep], s[keep]
        for row, x, y in _runs(i):
            scores, ids = s[x:y], b.ids[j[x:y]]
            for w in range(*own[row]):
                fits = (scores >= low[w]) & (scores <= high[w]) & (scores >= best.bar[w])
                if fits.any():
                    best.add(w, scores[fits], ids[fits])
    return best


class Grid:
    """Cells where each block meets each chunk once."""

    def __init__(self, blocks: DataFrame, chunks: DataFrame, dims: int):
        a, b = (t.agg(F.count("*").alias("n"), F.sum("bytes").alias("b")).first()
                for t in (blocks, chunks))
        self.blocks, self.chunks, self.dims = blocks, chunks, dims
        self.empty = not a["n"] or not b["n"]
        if self.empty:
            return
        wanted = shuffle_partitions(blocks.sparkSession)
        self.groups = min(a["n"], -(-a["b"] // CELL))
        self.slots = min(b["n"], max(-(-b["b"] // CELL), -(-wanted // self.groups)))

    def apply(self, blocks: DataFrame, work, schema: str) -> DataFrame:
        """``work(block row, Rows, [Rows of chunks])`` yields rows of ``schema``."""
        dims, cells = self.dims, self.groups * self.slots
        left = blocks.select("*", F.pmod(F.xxhash64("key"), F.lit(self.groups)).alias("g"), F.explode(
            F.sequence(F.lit(0), F.lit(self.slots - 1))).alias("s"))
        right = self.chunks.select("*", F.pmod(F.xxhash64("key"), F.lit(self.slots)).alias("s"), F.explode(
            F.sequence(F.lit(0), F.lit(self.groups - 1))).alias("g"))
        cell = (F.col("g") * self.slots + F.col("s")).alias("cell")
        # a number of partitions of our own: a few bytes of vectors are much work
        left, right = (t.select(cell, "*").drop("g", "s").repartition(cells, "cell")
                       for t in (left, right))

        def run(block_table, chunk_table):
            chunks = [Rows.of(r, dims) for r in chunk_table.to_pylist()]
            out = [x for r in block_table.to_pylist() for x in work(r, Rows.of(r, dims), chunks)
                   ] if chunks else []
            names = [f.split()[0] for f in schema.split(", ")]
            kinds = {"int": pa.int32(), "long": pa.int64()}
            return pa.table([pa.array([x[k] for x in out], kinds[f.split()[1]])
                             for k, f in enumerate(schema.split(", "))], names)

        return left.groupBy("cell").cogroup(right.groupBy("cell")).applyInArrow(run, schema)


def mine(rows: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding",
         label_col: str = "label", positives: int = 5, negatives: int = 3, low: int = 50,
         high: int = 95, scale: int = 256, references: int = 8, sample: int = 1024) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows where ``anchor`` holds. For each of an anchor's first ``positives``
    other rows of its label, the first ``negatives`` rows of other labels whose score lies
    between ``low`` and ``high`` hundredths of the positive's, both included.
    """
    valid = rows.where(vec.whole(vector_col) & F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    some = valid.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"),
                        F.col(vector_col).alias("vector"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    dims = vec.longest(some, "vector")
    directions = reference_directions(some, "id", "vector", dims, scale, references, sample)
    chunks = pack(some.drop("anchor"), dims, scale, directions, CHUNK, "negatives-chunks")
    blocks = pack(some.where("anchor").drop("anchor"), dims, scale, directions, BLOCK, "negatives-blocks")
    grid = Grid(blocks, chunks, dims)
    if grid.empty:
        return rows.sparkSession.createDataFrame(
            [], "anchor_id long, positive_id long, rank int, negative_id long, "
                "positive_score long, negative_score long")

    def nearest(row, a, others):
        best = _positives(a, others, dims, positives, [0, 0])
        for i, (scores, ids) in enumerate(best.held):
            for s, d in zip(scores, ids):
                yield row["key"], i, int(a.ids[i]), int(d), int(s)

    found = grid.apply(blocks, nearest, "key long, pos int, anchor_id long, positive_id long, score long")
    first = W.partitionBy("key", "pos").orderBy(F.desc("score"), "positive_id")
    found = write_table(found.withColumn("k", F.row_number().over(first)).where(
        F.col("k") <= positives), "negatives-positives")
    # at most BLOCK x positives windows a block
    wanted = found.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("pos", "k", "score"))).alias("w"))

    def between(row, a, others):
        w = row["w"]
        windows = np.array([(x["pos"], -(-low * x["score"] // 100), high * x["score"] // 100)
                            for x in w])
        best = _negatives(a, windows, others, dims, negatives, [0, 0])
        for x, (scores, ids) in zip(w, best.held):
            for s, d in zip(scores, ids):
                yield row["key"], x["pos"], x["k"], int(d), int(s)

    hard = grid.apply(blocks.join(wanted, "key"), between,
                      "key long, pos int, k int, negative_id long, negative_score long")
    first = W.partitionBy("key", "pos", "k").orderBy(F.desc("negative_score"), "negative_id")
    hard = hard.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= negatives)
    return hard.join(found, ["key", "pos", "k"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", F.col("score").alias("positive_score"),
        "negative_score")
