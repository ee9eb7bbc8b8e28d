"""Document quality from random Fourier features of document statistics.

Each text gives a vector of statistics (character classes, words, lines,
repetition). Random Fourier features approximate a Gaussian kernel over the
standardised vectors; each partition sums its part of the normal equations,
ridge scores solve them, and isotonic regression on other labelled rows
calibrates the scores to probabilities.

Labelled rows fall into four folds by crc32 of the id as text: 0 and 1 fit, 3
calibrates, 2 is held out. ``max_train`` bounds the labelled rows used (beyond
it an even share by a hash of the id); everything else covers all rows. Only
statistics of the text enter a score.

Null and empty texts have the vector of an empty text. Rows with null ids are
scored but never match a label; null labels are left out; a repeated row or
label counts as often as it occurs. Without labels all scores are 0.5.
"""

from __future__ import annotations

import math
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from playmetrics.llm.common import fold_of, text_of, write_table

FOLDS, HELD_OUT, CALIBRATE = 4, 2, 3
#: Character groups counted on their own.
GROUPS = (b"!", b"|", b"#*$%&", b"<>/\\=", b".", b",;:", b"?", b"\"'()[]{}", b"-_+@~^`")
N_STATS = 23


def statistics(text: bytes) -> list[float]:
    """Shares as square roots, so that small ones count; sizes as logarithms."""
    n = len(text)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256) if n else np.zeros(256)
    of = max(n, 1)
    p = counts[counts > 0] / of
    words = text.split()
    w = len(words)
    wn = max(w, 1)
    lines = text.split(b"\n")
    full = [x for x in lines if x.strip()]
    lens = np.fromiter(map(len, words), np.int64, w)
    shares = [
        counts[65:91].sum() / of, counts[97:123].sum() / of, counts[48:58].sum() / of,
        counts[128:].sum() / of, counts[10] / of,
        *(counts[list(g)].sum() / of for g in GROUPS),
        sum(map(eq, words, words[1:])) / wn, sum(map(bytes.isupper, words)) / wn,
        len(set(words)) / wn, 1 - len(set(full)) / max(len(full), 1),
    ]
    return [math.sqrt(max(float(s), 0.0)) for s in shares] + [
        float(-(p * np.log(p)).sum()) if n else 0.0, math.log1p(w), math.log1p(len(full)),
        math.log1p(lens.mean()) if w else 0.0, math.log1p(lens.std()) if w else 0.0]


class Model:
    """Standardisation, random features, ridge weights, calibration points."""

    def __init__(self, mean, std, features: int, width: float, seed: int):
        rng = np.random.default_rng(seed)
        self.mean, self.std = mean, std
        self.directions = rng.normal(0, 1 / width, (len(mean), features))
        self.phase = rng.uniform(0, 2 * np.pi, features)
        self.weights = np.zeros(features + 1)
        self.at, self.value = np.array([0.0]), np.array([0.5])

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.std, -8, 8)
        z = np.sqrt(2 / len(self.phase)) * np.cos(z @ self.directions + self.phase)
        return np.hstack([z, np.ones((len(z), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.at, self.value)


def isotonic(x, y, weight):
    """Pool adjacent violators; (centre, value) of the pooled blocks."""
    blocks = []
    for a, b, w in zip(x, y, weight):
        blocks.append([a * w, b * w, w])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last)]
    return (np.array([s / w for s, _, w in blocks]), np.array([v / w for _, v, w in blocks]))


def _vectors(column) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1).astype(np.float64)


def describe(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, fold, x): the statistics of every text."""
    rows = docs.select(F.col(id_col).alias("id"), fold_of(id_col, FOLDS).cast("int").alias("fold"),
                       text_of(text_col).cast("binary").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            x = pa.array([statistics(t.as_py()) for t in b.column(2)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), x], ["id", "fold", "x"])

    return rows.mapInArrow(run, f"id {kind}, fold int, x array<double>")


def _equations(model: Model):
    """Rows (i, values) of this partition's Z'Z and Z'y."""
    def run(batches):
        size = len(model.weights)
        total = np.zeros((size, size + 1))
        for b in batches:
            z = model.features(_vectors(b.column(0)))
            y = b.column(1).to_numpy(zero_copy_only=False).astype(np.float64)
            total += z.T @ np.hstack([z, y[:, None]])
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(size), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))],
            ["i", "v"])

    return run


def _bins(model: Model, per_unit: int = 512):
    def run(batches):
        for b in batches:
            raw = np.clip(model.raw(_vectors(b.column(0))), -1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.round(raw * per_unit).astype(np.int32)), b.column(1)], ["bin", "y"])

    return run


def fit(described: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality",
        features: int = 256, ridge: float = 1e-4, seed: int = 42, max_train: int = 1_000_000,
        partitions: int = 16) -> Model:
    """``described`` from `describe`; labels are 0 or 1."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y"))
    known = described.where(F.col("fold") != HELD_OUT).join(
        known.where("id IS NOT NULL AND y IS NOT NULL"), "id")
    n = known.count()
    if n > max_train:
        share = int(1_000_000 * max_train / n)
        known = known.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1_000_000)) < share)
    # bounded rows; a fixed number of partitions bounds what is summed
    known = write_table(known.repartition(partitions, "id"), "quality-labelled")
    moments = known.where(F.col("fold") != CALIBRATE).select(F.posexplode("x")).groupBy("pos").agg(
        F.avg("col").alias("m"), F.stddev_pop("col").alias("s")).orderBy("pos").collect()
    if not moments:
        return Model(np.zeros(N_STATS), np.ones(N_STATS), features, 1.0, seed)
    model = Model(np.array([r["m"] for r in moments]),
                  np.array([max(r["s"], 1e-3) for r in moments]), features,
                  math.sqrt(len(moments)), seed)
    rows = known.where(F.col("fold") != CALIBRATE).select("x", "y").mapInArrow(
        _equations(model), "i int, v array<double>").collect()
    total = np.zeros((features + 1, features + 2))
    for r in rows:
        total[r["i"]] += r["v"]
    a, b = total[:, :-1], total[:, -1]
    model.weights = np.linalg.solve(a + ridge * a[-1, -1] * np.eye(len(a)), b)
    bins = known.where(F.col("fold") == CALIBRATE).select("x", "y").mapInArrow(
        _bins(model), "bin int, y double").groupBy("bin").agg(
            F.avg("y").alias("y"), F.count("*").alias("n")).orderBy("bin").collect()
    if bins:
        model.at, model.value = isotonic([r["bin"] / 512 for r in bins], [r["y"] for r in bins],
                                         [r["n"] for r in bins])
    return model


def score(described: DataFrame, model: Model) -> DataFrame:
    """(id, fold, score) for every row of ``described``."""
    def run(batches):
        for b in batches:
            scores = model.score(_vectors(b.column(2))) if len(b) else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(scores)], ["id", "fold", "score"])

    kind = described.schema["id"].dataType.simpleString()
    return described.mapInArrow(run, f"id {kind}, fold int, score double")


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id",
                    text_col: str = "text", label_col: str = "quality", **how) -> DataFrame:
    """One row per document: ``id_col``, held_out, score."""
    described = write_table(describe(docs, id_col, text_col), "quality-statistics")
    model = fit(described, labels, id_col, label_col, **how)
    return score(described, model).select(
        F.col("id").alias(id_col), (F.col("fold") == HELD_OUT).alias("held_out"), "score")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              label_col: str = "quality", least: float = 0.7, **how) -> DataFrame:
    """The rows of ``docs`` that score ``least`` or more; same columns."""
    names = docs.columns
    model = fit(write_table(describe(docs, id_col, text_col), "quality-statistics"), labels,
                id_col, label_col, **how)
    inner = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(names)],
                        text_of(text_col).cast("binary").alias("text"))

    def run(batches):
        for b in batches:
            x = np.array([statistics(t.as_py()) for t in b.column(b.num_columns - 1)])
            good = model.score(x) >= least if len(x) else np.zeros(0, bool)
            yield b.select(range(b.num_columns - 1)).filter(pa.array(good))

    out = inner.mapInArrow(run, inner.drop("text").schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
