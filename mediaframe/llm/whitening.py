"""Whitening of embeddings by a tiled covariance.

Entries become whole numbers, floor(64 c) + 1000000, so sums and products over rows are exact. Rows are cut into
blocks and a block's columns into column blocks; column blocks are shuffled by row block, pairs of them are multiplied
(a tile), tiles are summed entry by entry, first in each task, and the assembled matrix is decomposed. The same tiles over the
whitened rows measure how far their covariance is from the identity. Before rows are multiplied the nearest whole mean is
taken off them, and what is left of the mean afterwards, so nothing is lost to large means.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaframe.llm.common import bound_batches

SCALE, SHIFT = 64, 1_000_000
#: Columns of a column block; entries of a row block.
TILE, BLOCK_ENTRIES = 32, 1 << 18
#: An entry of this size or more counts as not finite: sums of products of larger ones would not fit 38 digits.
LARGEST = 2.0**34
#: Entries of the covariances of one table, of each length of its vectors one: the driver assembles and decomposes them.
MOST_ENTRIES = 1 << 22
MOST_COMPONENTS = 32
EXACT = pa.decimal128(38, 0)
WHOLE = "decimal(38,0)"


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, vector (array<double>) and size of the vectors that are not null and hold entries, none of them null, not finite or of 2^34 and more."""
    bound_batches(vectors.sparkSession)
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    fine = F.forall("vector", lambda c: c.isNotNull() & (F.abs(c) < LARGEST))  # false for NaN too: it is above all numbers
    return v.where(F.coalesce(fine, F.lit(False)) & (F.size("vector") > 0)).withColumn("size", F.size("vector"))


def _by_size(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The rows of a batch (size, vector) by length: the length, places in the batch, and the vectors as a matrix."""
    sizes, values = batch.column("size").to_numpy(), batch.column("vector").flatten().to_numpy()
    first = np.cumsum(sizes) - sizes
    for d in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == d)
        yield d, at, values[first[at][:, None] + np.arange(d)]


def whole(vectors: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * vectors).astype(np.int64) + SHIFT


def _decimals(values: np.ndarray) -> pa.Array:
    if values.dtype == np.int64:
        return pa.array(values).cast(EXACT)
    return pa.array([Decimal(int(v)) for v in values], EXACT)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a' b of whole numbers, exactly: in doubles or 64-bit numbers where every sum fits, else in numbers of any size."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, len(a))
    if most < 2.0**52:
        return (a.T.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    return a.T @ b if most < 2.0**62 else a.T.astype(object) @ b.astype(object)


def sums(vectors: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """For each length its rows and the sums of their whole numbers by dimension; one number for each dimension goes to the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for batch in batches:
            for d, at, v in _by_size(batch):
                n, s = total.get(d, (0, np.zeros(d, object)))
                total[d] = n + len(at), s + whole(v).astype(object).sum(axis=0) if np.abs(v).max() * SCALE * len(at) > 2.0**60 else s + whole(v).sum(axis=0).astype(object)
        for d, (n, s) in total.items():
            yield pa.record_batch([pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), _decimals(s)], names=["size", "at", "n", "s"])

    found = vectors.select("size", "vector").mapInArrow(add, f"size int, at int, n long, s {WHOLE}").groupBy("size", "at").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    entries = vectors.select(F.col("size").cast("long").alias("d")).distinct().agg(F.sum(F.col("d") * F.col("d"))).first()[0] or 0
    if entries > MOST_ENTRIES:
        raise ValueError(f"covariances of {entries} entries; the driver takes {MOST_ENTRIES}")
    out: dict[int, tuple[int, list[int]]] = {}
    for r in found.orderBy("size", "at").collect():
        out.setdefault(r["size"], (r["n"], []))[1].append(int(r["s"]))
    return out


def tiles(rows: DataFrame, centre: dict[int, np.ndarray], exact: bool) -> dict[int, np.ndarray]:
    """For each length the matrix of sums of products of rows (size, vector) less their centre: of their whole numbers, exactly, or of doubles."""
    kind = WHOLE if exact else "double"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, count = TaskContext.get().partitionId(), 0
        for batch in batches:
            for d, at, v in _by_size(batch):
                y = whole(v) - centre[d] if exact else v - centre[d]
                step = max(1, BLOCK_ENTRIES // d)
                for lo in range(0, len(at), step):
                    parts = [np.ascontiguousarray(y[lo : lo + step, c : c + TILE]) for c in range(0, d, TILE)]
                    key = (task << 32) + count
                    count += 1
                    yield pa.record_batch([pa.array([key] * len(parts), pa.int64()), pa.array([d] * len(parts), pa.int32()), pa.array(range(len(parts)), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["row_block", "size", "column_block", "data"])

    def multiply(table: pa.Table) -> pa.Table:
        table = table.sort_by("column_block")
        d = table["size"][0].as_py()
        parts = [np.frombuffer(data, np.int64 if exact else np.float64).reshape(-1, min(TILE, d - TILE * k)) for k, data in enumerate(table["data"].to_pylist())]
        out = []
        for i, a in enumerate(parts):
            for j in range(i, len(parts)):
                entries = (_product(a, parts[j]) if exact else a.T @ parts[j]).reshape(-1)
                out.append((d, i, j, _decimals(entries) if exact else pa.array(entries)))
        return pa.table([pa.array([x[k] for x in out], pa.int32()) for k in range(3)] + [pa.array([x[3].to_pylist() for x in out], pa.list_(EXACT if exact else pa.float64()))], names=["size", "i", "j", "entries"])

    blocks = rows.select("size", "vector").mapInArrow(cut, "row_block long, size int, column_block int, data binary")
    made = blocks.groupBy("row_block").applyInArrow(multiply, f"size int, i int, j int, entries array<{kind}>")
    summed = made.select("size", "i", "j", F.posexplode("entries").alias("at", "v")).groupBy("size", "i", "j", "at").agg(F.sum("v").alias("v"))
    together = summed.groupBy("size", "i", "j").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda x: x["v"]).alias("entries"))
    out: dict[int, np.ndarray] = {}
    for r in together.toLocalIterator():
        d, i, j = r["size"], r["i"] * TILE, r["j"] * TILE
        m = out.setdefault(d, np.zeros((d, d), object if exact else np.float64))
        tile = np.array([int(v) for v in r["entries"]] if exact else r["entries"], object if exact else np.float64).reshape(min(TILE, d - i), -1)
        m[i : i + TILE, j : j + TILE] = tile
        m[j : j + TILE, i : i + TILE] = tile.T
    return out


class Model:
    """The fit of vectors of one length: n, the sums S, and components (as rows) by falling eigenvalue, 32 at most, with eigenvalues and the trace of the covariance."""

    def __init__(self, n: int, total: list[int], products: np.ndarray, centre: list[int]):
        rest = np.array([s - n * c for s, c in zip(total, centre, strict=True)], object)  # sums of what is left of the mean
        covariance = np.array((products * n - rest[:, None] * rest[None, :]) / (n * n), np.float64)
        values, vectors = np.linalg.eigh(covariance)
        order = np.argsort(-values, kind="stable")[:MOST_COMPONENTS]
        self.n, self.total, self.trace = n, total, float(np.trace(covariance))
        self.values, self.components = np.maximum(values[order], 0.0), np.ascontiguousarray(vectors[:, order].T)
        self.varies = self.values > max(self.trace, 0.0) * len(total) * np.finfo(float).eps  # the others are zero but for rounding

    def whiten(self, vectors: np.ndarray) -> np.ndarray:
        """Whitened rows; components without variance give NaN."""
        off = self.away(whole(vectors)).astype(np.float64) / self.n
        scale = np.where(self.varies, np.sqrt(np.where(self.varies, self.values, 1.0)), np.nan)
        return off @ self.components.T / scale

    def away(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exactly."""
        fits = self.n * (float(np.abs(x).max(initial=0)) + SHIFT) < 2.0**61
        return self.n * x - np.array(self.total, np.int64) if fits else self.n * x.astype(object) - np.array(self.total, object)

    def deviation(self, vectors: np.ndarray) -> pa.Array:
        """The sum of squares of n x - S, exactly; null beyond 38 digits."""
        away = self.away(whole(vectors))
        if away.dtype == np.int64 and float(np.abs(away).max(initial=0)) ** 2 * away.shape[1] < 2.0**62:
            return _decimals((away * away).sum(axis=1))
        squares = [sum(v * v for v in row) for row in away.tolist()]
        return pa.array([Decimal(s) if s < 10**38 else None for s in squares], EXACT)


def fit(vectors: DataFrame) -> dict[int, Model]:
    """A model for each length of the vectors (id, vector, size, as usable() has them)."""
    total = sums(vectors)
    centre = {d: [s // n for s in part] for d, (n, part) in total.items()}
    products = tiles(vectors, {d: np.array(c, np.int64) for d, c in centre.items()}, True)
    return {d: Model(n, part, products[d], centre[d]) for d, (n, part) in total.items()}


def whiten(vectors: DataFrame, models: dict[int, Model]) -> DataFrame:
    """id, size, deviation (decimal) and whitened (an array, NaN where a component has no variance) of every vector."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, at, v in _by_size(batch):
                made = models[d].whiten(v)
                flat = pa.array(made.reshape(-1))
                rows = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * made.shape[1]), flat)
                yield pa.record_batch([batch.column("id").take(pa.array(at)), pa.array([d] * len(at), pa.int32()), models[d].deviation(v), rows], names=["id", "size", "deviation", "whitened"])

    return vectors.select("id", "size", "vector").mapInArrow(apply, f"id long, size int, deviation {WHOLE}, whitened array<double>")


def identity_errors(vectors: DataFrame, models: dict[int, Model]) -> dict[int, float]:
    """For each length of vector the largest absolute entry of the whitened rows' covariance less the identity, over components with variance."""
    rows = whiten(vectors, models).select(F.col("size").alias("of"), F.filter("whitened", lambda x: ~F.isnan(x)).alias("vector"))
    tagged = rows.where(F.size("vector") > 0).select("of", F.size("vector").alias("size"), "vector")
    out = {}
    for d in models:  # lengths are few
        own = tagged.where(F.col("of") == d)
        k = int(models[d].varies.sum())
        if k:
            mean = np.array(own.select(*(F.avg(F.get("vector", F.lit(i))) for i in range(k))).first(), np.float64)
            products = tiles(own, {k: mean}, False)[k]
            out[d] = float(np.abs(products / models[d].n - np.eye(k)).max())
    return out


def components(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For each usable vector and component (numbered from 1, 32 at most): vec_id, component, n, deviation (decimal), whitened, explained, identity_error.

    Vectors that are null or empty, or hold null, not finite or very large entries (2^34 and more), are left out; ids may be null and
    repeat. Vectors of different lengths are fitted each with their own. Components without variance (of one row, or of equal ones) have a
    null for whitened; without any variance explained and identity_error are null too. An empty table gives no rows. Covariances of more than 2^22 entries (2,048 dimensions) raise an error."""
    rows = usable(vectors, id_col, vector_col)
    models = fit(rows)
    errors = identity_errors(rows, models)
    facts = [(d, m.n, k + 1, float(e / m.trace) if m.trace > 0 else None, errors.get(d)) for d, m in models.items() for k, e in enumerate(m.values.tolist())]
    known = rows.sparkSession.createDataFrame(facts, "size int, n long, component int, explained double, identity_error double")
    each = whiten(rows, models).select("id", "size", "deviation", F.posexplode("whitened").alias("k", "w"))
    met = each.join(F.broadcast(known), (each["size"] == known["size"]) & (F.col("k") + 1 == F.col("component")))
    return met.select(F.col("id").alias("vec_id"), "component", "n", "deviation", F.when(~F.isnan("w"), F.col("w")).alias("whitened"), "explained", "identity_error")
