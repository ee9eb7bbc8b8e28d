"""Whitening of embeddings: centred covariance, leading components, projection of every row.

Components c become integers floor(scale * c); the model is fitted on each distinct integer
vector once. Two passes over those give exact sums and, centred on the rounded means, exact
sums of products (integers throughout, so neither the dealing of rows nor a repeated task
changes a digit); only dimension-by-dimension sums meet in a shuffle and reach the driver. The
driver reduces the covariance to tridiagonal form and finds its leading eigenvalues and
vectors (`symmetric_eigen`); mean and components, a few rows of the vectors' length, go with
the tasks that project all rows.

Rows whose vector is null or has a null or non-finite component take no part; a null id stays.
Repeated rows are projected each. Vectors shorter than the longest end in zeros. Components
whose eigenvalue is no more than ``LEAST`` of the largest cannot be scaled to variance 1 in
double precision and are left out: equal vectors only, or an empty table, give no rows. A
component too large for a long, or a deviation beyond one, is an error, not a wrong number.
Other columns are not read.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from playmetrics.llm import symmetric_eigen, vectors as vec
from playmetrics.llm.common import write_table

LEAST = 1e-9
EXACT = pa.decimal128(38, 0)


def _numbers(values) -> pa.Array:
    return pa.array([Decimal(int(v)) for v in values], EXACT)


def _safe(x: np.ndarray, bound: int) -> np.ndarray:
    """``x`` as Python integers if numbers up to ``bound`` do not fit int64."""
    return x if bound < 2 ** 62 else x.astype(object)


def _largest(x: np.ndarray) -> int:
    return max(int(x.max(initial=0)), -int(x.min(initial=0)))


def _sums(dims: int):
    """(pos, v) of this partition: rows at -1, then the sum of each dimension."""
    def run(batches):
        n, total = 0, np.zeros(dims, object)
        for whole in batches:
            for b in vec.pieces(whole, dims):
                x = vec.unpacked(b.column(0).to_pylist(), dims)
                n += len(x)
                total += _safe(x, _largest(x) * len(x)).sum(0).astype(object)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(-1, dims), pa.int32()), _numbers([n, *total])], ["pos", "v"])

    return run


def _products(centre: np.ndarray):
    """(i, j, v) of this partition, i <= j: sums of products of centred vectors, exact."""
    dims = len(centre)

    def run(batches):
        total, n, held = np.zeros((dims, dims), np.int64), 0, 0
        for whole in batches:
            for b in vec.pieces(whole, dims):
                x = vec.unpacked(b.column(0).to_pylist(), dims)
                far = _largest(x) + _largest(centre)
                x = _safe(x, far) - centre
                bound = far ** 2 * len(x)
                # a product of doubles is exact while its sums stay below 2 ** 53
                x = x.astype(np.float64) if bound < 2 ** 53 else _safe(x, bound)
                product = x.T @ x
                held += bound
                total = _safe(total, held)
                total += product.astype(total.dtype)
                n += len(x)
        for i in range(dims if n else 0):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(dims - i, i, np.int32)), pa.array(np.arange(i, dims, dtype=np.int32)),
                 _numbers(total[i, i:])], ["i", "j", "v"])

    return run


class Model:
    """Row count and sums of the fit list, eigenvalues, components as rows, trace."""

    def __init__(self, n: int, sums: list[int], products: dict, centre: list[int], keep: int):
        dims = len(sums)
        self.n, self.sums = n, np.array(sums, object)
        rest = [s - n * c for s, c in zip(sums, centre)]
        cov = np.zeros((dims, dims))
        for (i, j), m in products.items():
            # one rounding, of the exact quotient
            cov[i, j] = cov[j, i] = (n * m - rest[i] * rest[j]) / (n * n)
        self.covariance = cov
        self.trace = sum(n * products.get((i, i), 0) - rest[i] ** 2 for i in range(dims)) / (n * n)
        values, rows = symmetric_eigen.leading(cov, keep)
        fine = values > LEAST * max(values.max(initial=0.0), 0.0)
        self.values, self.components = values[fine], rows[fine]
        self.identity_error = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, exact."""
        bound = self.n * _largest(x) + max((abs(s) for s in self.sums), default=0)
        if bound < 2 ** 62:
            return self.n * x - self.sums.astype(np.int64)
        return self.n * x.astype(object) - self.sums

    def whitened(self, far: np.ndarray) -> np.ndarray:
        """``far``: from `centred`."""
        return far.astype(np.float64) / self.n @ self.components.T / np.sqrt(self.values)


def deviations(far: np.ndarray) -> list[int]:
    far = _safe(far, _largest(far) ** 2 * max(far.shape[1], 1))
    return (far * far).sum(1).tolist()


def _second_moments(model: Model, dims: int):
    """(pos, v): sums of whitened values, then of their products, of this partition."""
    def run(batches):
        k = len(model.values)
        total = np.zeros(k + k * k)
        for whole in batches:
            for b in vec.pieces(whole, dims):
                w = model.whitened(model.centred(vec.unpacked(b.column(0).to_pylist(), dims)))
                total[:k] += w.sum(0)
                total[k:] += (w.T @ w).ravel()
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["pos", "v"])

    return run


def integers(rows: DataFrame, vector_col: str, dims: int, scale: int) -> DataFrame:
    """(x): the packed integers of each row that takes part."""
    def run(batches):
        for whole in batches:
            for b in vec.pieces(whole, dims):
                x = vec.floors(vec.matrix(b.column(0), dims), scale)
                yield pa.RecordBatch.from_arrays([pa.array(vec.packed(x), pa.binary())], ["x"])

    return rows.where(vec.whole(vector_col)).select(vector_col).mapInArrow(run, "x binary")


def fit(rows: DataFrame, vector_col: str, dims: int, scale: int = 64, keep: int = 16) -> Model | None:
    """None where no row takes part."""
    # equal vectors meet in their task first, so a common one travels once a task
    distinct = write_table(integers(rows, vector_col, dims, scale).distinct(), "whiten-distinct")
    found = {r["pos"]: int(r["v"]) for r in distinct.mapInArrow(
        _sums(dims), "pos int, v decimal(38,0)").groupBy("pos").agg(F.sum("v").alias("v")).collect()}
    n = found.get(-1, 0)
    if not n:
        return None
    sums = [found[i] for i in range(dims)]
    centre = [(2 * s + n) // (2 * n) for s in sums]
    at = np.array(centre, object)
    at = at.astype(np.int64) if max(map(abs, centre), default=0) < 2 ** 61 else at
    products = {(r["i"], r["j"]): int(r["v"]) for r in distinct.mapInArrow(
        _products(at), "i int, j int, v decimal(38,0)").groupBy("i", "j").agg(
            F.sum("v").alias("v")).collect()}
    model = Model(n, sums, products, centre, keep)
    k = len(model.values)
    if k:
        moments = np.zeros(k + k * k)
        for r in distinct.mapInArrow(_second_moments(model, dims), "pos int, v double").groupBy(
                "pos").agg(F.sum("v").alias("v")).collect():
            moments[r["pos"]] = r["v"] / n
        mean = moments[:k]
        error = moments[k:].reshape(k, k) - np.outer(mean, mean) - np.eye(k)
        model.identity_error = float(np.abs(error).max())
    return model


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
           scale: int = 64, keep: int = 16) -> DataFrame:
    """One row a vector and component: ``id_col``, component, n, deviation, whitened, explained,
    identity_error."""
    kind = rows.schema[id_col].dataType.simpleString()
    schema = (f"id {kind}, component int, n long, deviation long, whitened double, "
              "explained double, identity_error double")
    valid = rows.where(vec.whole(vector_col))
    dims = vec.longest(valid, vector_col)
    model = fit(rows, vector_col, dims, scale, keep) if dims else None
    if model is None:
        return rows.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col)

    def run(batches):
        k = len(model.values)
        explained = model.values / model.trace if k else model.values
        for whole in batches:
            for b in vec.pieces(whole, dims):
                far = model.centred(vec.floors(vec.matrix(b.column(1), dims), scale))
                each = pa.array(np.repeat(np.arange(len(b)), k))
                size = len(b) * k
                yield pa.RecordBatch.from_arrays([
                    b.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(b))),
                    pa.array(np.full(size, model.n)), pa.array(deviations(far), pa.int64()).take(each),
                    pa.array(model.whitened(far).ravel()), pa.array(np.tile(explained, len(b))),
                    pa.array(np.full(size, model.identity_error))],
                    ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return valid.select(F.col(id_col).alias("id"), vector_col).mapInArrow(
        run, schema).withColumnRenamed("id", id_col)
