"""Whitening of embedding vectors by Golub-Kahan-Lanczos bidiagonalisation.

The centred rows X are multiplied alternately: left vectors u = Xv, right vectors Xᵀu, each made orthogonal to all
before it, twice. The vectors go in blocks of eight, so that a space of d dimensions needs at most d/8 rounds of two
passes over the rows, and equal singular values are no obstacle. The left vectors have a row each, so they are never
held: every one is X times a d-vector, and that d-vector is kept. A pass sums what the driver needs (at most d x d
doubles) per partition and then by one small shuffle. The SVD of the small block-bidiagonal matrix gives the
components and deviations.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muster.runtime import arrow_batches, materialize

SCALE, SHIFT = 1024, 100_000
LARGEST = 2.0**33  # an entry at or beyond it counts as not finite: its sums would pass 64 bits
BLOCK = 8  # vectors multiplied in one pass
BLOCK_ROWS = 4096  # vectors stored together
TOLERANCE = 1e-14  # residual of the wanted components, as a share of the largest singular value
TINY = 1e-12  # a direction below this share of the largest singular value has no deviation


@dataclass
class Whitening:
    """What a fit gives: exact sums, components as columns, eigenvalues, the covariance's trace."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    rounds: int = 0
    identity_error: float = 0.0

    @property
    def base(self) -> tuple[np.ndarray, np.ndarray]:
        """Whole and fractional part of the means: rows minus the first stay exact in integers."""
        whole = [s // self.n for s in self.sums]
        return np.array(whole, np.int64), np.array([(s - w * self.n) / self.n for s, w in zip(self.sums, whole)])

    def projections(self) -> np.ndarray:
        return self.components / np.sqrt(self.eigenvalues)


def usable(vector: Column) -> Column:
    """Not null, not empty, and every entry a finite number below ``LARGEST``."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) >= LARGEST))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & ~bad, F.lit(False))


def whole_numbers(vector: Column) -> Column:
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE) + F.lit(SHIFT))


def _matrix(column: pa.ListArray) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _blocks(x: DataFrame) -> DataFrame:
    """Vectors packed as blocks of ``BLOCK_ROWS`` with their column sums, so that a pass reads plain matrices."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out():
            m = np.concatenate(held)
            held.clear()
            return pa.RecordBatch.from_pydict({"n": pa.array([len(m)], pa.int64()), "x": pa.array([m.tobytes()], pa.binary())})

        for b in batches:
            if len(b):
                held.append(_matrix(b.column(0)))
                if sum(map(len, held)) >= BLOCK_ROWS:
                    yield out()
        if held:
            yield out()

    return materialize(x.select("x").mapInArrow(pack, "n long, x binary"), "vectors")


def _summed(parts: DataFrame, size: int) -> np.ndarray:
    """Sums of ``parts(k, v)`` over partitions."""
    found = np.zeros(size)
    for r in parts.groupBy("k").agg(F.sum("v").alias("v")).collect():
        found[r["k"]] = r["v"]
    return found


def _column_sums(blocks: DataFrame, d: int) -> list[int]:
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column(0).to_pylist():
                s = np.frombuffer(raw, np.int64).reshape(-1, d).sum(0)
                yield pa.RecordBatch.from_pydict({"k": pa.array(range(d), pa.int32()), "v": pa.array(s)})

    parts = blocks.select("x").mapInArrow(sums, "k int, v long")
    found = parts.groupBy("k").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()
    return [int(v) for _, v in sorted((r["k"], r["v"]) for r in found)]


def _products(blocks: DataFrame, fit: Whitening, w: np.ndarray, y: np.ndarray) -> tuple:
    """One pass with U = Xw and L = Xy: UᵀU, LᵀU, XᵀU, the sums of U, and the sum of squares of X."""
    d, b, k = len(w), w.shape[1], y.shape[1]
    shared = blocks.sparkSession.sparkContext.broadcast((*fit.base, w, y))
    size = b * b + k * b + d * b + b + 1

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, part, right, left = shared.value
        total = np.zeros(size)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                x = (np.frombuffer(raw, np.int64).reshape(-1, d) - whole).astype(np.float64) - part
                u = x @ right
                pieces = (u.T @ u, (x @ left).T @ u, x.T @ u, u.sum(0), np.array([np.einsum("ij,ij->", x, x)]))
                total += np.concatenate([p.ravel() for p in pieces])
        yield pa.RecordBatch.from_pydict({"k": pa.array(np.arange(size, dtype=np.int32)), "v": pa.array(total)})

    got = _summed(blocks.select("x").mapInArrow(multiply, "k int, v double"), size)
    shared.unpersist()
    cuts = np.cumsum([b * b, k * b, d * b, b])
    gram, cross, back, sums, squares = np.split(got, cuts)
    return gram.reshape(b, b), cross.reshape(k, b), back.reshape(d, b), sums, float(squares[0])


def _scaled(gram: np.ndarray, floor: float) -> np.ndarray:
    """Q with QᵀGQ = 1; directions of length ``floor`` or less are left out."""
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    keep = values > floor**2
    return vectors[:, keep] / np.sqrt(values[keep])


def _orthogonal(block: np.ndarray, basis: np.ndarray, floor: float) -> np.ndarray:
    """An orthonormal basis of ``block`` outside ``basis``; directions of length ``floor`` or less are left out."""
    for _ in range(2):
        block = block - basis @ (basis.T @ block)
    u, s, _ = np.linalg.svd(block, full_matrices=False)
    u = u[:, s > floor]
    u = u - basis @ (basis.T @ u)
    return np.linalg.qr(u)[0] if u.shape[1] else u


def fit_whitening(vectors: DataFrame, components: int = 8) -> Whitening | None:
    """Fit on ``vectors(x array<long>)`` of one length. None for an empty table.

    Directions without deviation give no component, so there may be fewer than ``components``.
    """
    arrow_batches(vectors.sparkSession)
    first = vectors.select(F.size("x").alias("d")).first()
    if first is None:
        return None
    d = first["d"]
    blocks = _blocks(vectors)
    n = blocks.agg(F.sum("n")).first()[0]
    fit = Whitening(n, _column_sums(blocks, d), np.zeros((d, 0)), np.zeros(0), 0.0)
    random = np.random.default_rng(42)
    right, left, back = np.zeros((d, 0)), np.zeros((d, 0)), np.zeros((d, 0))  # V, Y with U = XY, and XᵀU
    block = np.linalg.qr(random.standard_normal((d, min(BLOCK, d))))[0]
    top = 0.0
    while True:
        fit.rounds += 1
        gram, cross, _, _, squares = _products(blocks, fit, block, left)
        if squares == 0:
            return fit
        fit.trace, top = squares / n, max(top, float(np.sqrt(max(np.linalg.eigvalsh((gram + gram.T) / 2)[-1], 0))))
        w = (block - left @ cross) @ _scaled(gram - cross.T @ cross, TINY * top)
        right = np.concatenate([right, block], axis=1)
        made = 0
        if w.shape[1]:  # the second pass takes out what rounding left of the earlier vectors
            gram, cross, z, _, _ = _products(blocks, fit, w, left)
            q = _scaled(gram - cross.T @ cross, 1e-3)
            w, z = (w - left @ cross) @ q, (z - back @ cross) @ q
            left, back, made = np.concatenate([left, w], axis=1), np.concatenate([back, z], axis=1), w.shape[1]
        small_u, sigma, small_v = np.linalg.svd(back.T @ right, full_matrices=False)
        wanted = min(components, len(sigma))
        if right.shape[1] >= d:
            break
        rest = back[:, back.shape[1] - made :]
        rest = rest - right @ (right.T @ rest)
        if made and len(sigma) > components:
            residual = np.linalg.norm(rest @ small_u[len(small_u) - made :, :wanted], axis=0)
            if residual.max() <= TOLERANCE * sigma[0]:
                break
        block = _orthogonal(rest, right, TINY * max(top, 1e-300)) if made else rest[:, :0]
        room = min(BLOCK, d - right.shape[1])
        if block.shape[1] < room:  # equal singular values or an end of the space: go on with new directions
            spare = random.standard_normal((d, room - block.shape[1]))
            block = np.concatenate([block, _orthogonal(spare, np.concatenate([right, block], axis=1), 1e-8)], axis=1)
    keep = sigma[:wanted] > TINY * sigma[0]
    found = right @ small_v[:wanted].T[:, keep]
    found = found / np.linalg.norm(found, axis=0)
    fit.components = found * np.sign(found[np.abs(found).argmax(0), np.arange(found.shape[1])])
    fit.eigenvalues = sigma[:wanted][keep] ** 2 / n
    gram, _, _, sums, _ = _products(blocks, fit, fit.projections(), np.zeros((d, 0)))
    mean = sums / n
    fit.identity_error = float(np.abs(gram / n - np.outer(mean, mean) - np.eye(len(mean))).max())
    return fit


def squared_distances(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Exact sums of (n*x-S)² a row; in 64 bits where they can't be passed, else in Python's integers."""
    whole = [s // n for s in sums]
    off = x - np.array(whole, np.int64)
    rest = [s - w * n for s, w in zip(sums, whole)]
    most = (int(np.abs(off).max(initial=0)) + 1) * n
    if most * most * x.shape[1] < 2**63:
        t = n * off - np.array(rest, np.int64)
        return np.einsum("ij,ij->i", t, t).tolist()
    t = n * off.astype(object) - np.array(rest, object)
    return (t * t).sum(1).tolist()


def whitened_column(x: Column, fit: Whitening, spark) -> Column:
    """Struct ``(deviation long, values array<double>)``: values are the row's whitened components in order.

    A deviation beyond 64 bits is null.
    """
    arrow_batches(spark)
    shared = spark.sparkContext.broadcast(fit)

    @F.pandas_udf("deviation long, values array<double>")
    def whitened(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = shared.value
        (whole, part), right = own.base, own.projections()
        for rows in batches:
            m = np.stack(rows.to_list()) if len(rows) else np.zeros((0, len(whole)), np.int64)
            far = [v if v < 2**63 else None for v in squared_distances(m, own.n, own.sums)]
            values = ((m - whole).astype(np.float64) - part) @ right
            yield pd.DataFrame({"deviation": pd.array(far, dtype="Int64"), "values": list(values)})

    return whitened(x)


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 8) -> DataFrame:
    """One row a usable vector and component: key, component, n, deviation, whitened, explained, identity_error.

    Vectors that are null, empty, or hold a null, a non-finite number or one beyond ``LARGEST`` are dropped, as are those
    whose length isn't the table's commonest (the longer of two as common). Null and repeated keys stay as rows of
    their own. A table without deviation, or without vectors, gives no rows. Other columns play no part.
    """
    spark = df.sparkSession
    e = F.col(f"`{vector}`")
    x = df.where(usable(e)).select(F.col(f"`{key}`").alias(key), whole_numbers(e).alias("x"))
    common = x.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    x = x.where(F.size("x") == (common["d"] if common else 0))
    fit = fit_whitening(x, components)
    if fit is None or not len(fit.eigenvalues):
        fit = Whitening(1, [0] * (common["d"] if common else 1), np.zeros((common["d"] if common else 1, 0)), np.zeros(0), 1.0)
    shares = F.array(*[F.lit(float(v)) for v in fit.eigenvalues / fit.trace]) if len(fit.eigenvalues) else F.array().cast("array<double>")
    rows = x.select(key, whitened_column(F.col("x"), fit, spark).alias("w"))
    rows = rows.select(key, F.col("w.deviation").alias("deviation"), F.posexplode("w.values").alias("at", "whitened"))
    return rows.select(
        key, (F.col("at") + 1).cast("int").alias("component"), F.lit(fit.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("at")).alias("explained"), F.lit(fit.identity_error).alias("identity_error"),
    )


def op12_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
