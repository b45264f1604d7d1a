"""Embedding whitening by matrix-free block Lanczos: the covariance is only ever applied, by distributed passes over the rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import map_arrow

#: Fixed values of the contract: entries become floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000

#: Scaled entries beyond this count as it, so that they are exact as doubles and as longs.
FAR = 1 << 52

#: Columns of a Lanczos block, and how small a residual must be against the largest eigenvalue.
BLOCK, TOLERANCE = 16, 1e-13

#: An eigenvalue below this share of the largest is none.
NOTHING = 1e-12


class Model(NamedTuple):
    """What the rows are centred and projected with; sums are those of the scaled entries without the shift, which nothing depends on."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    passes: int


def usable(df: DataFrame, column: str, *kept: str) -> DataFrame:
    """Rows whose vector is there and has finite entries only, with the vector as ``__v``."""
    bad = F.exists("__v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return df.select(*kept, F.col(column).cast("array<double>").alias("__v")).where(F.col("__v").isNotNull() & ~bad)


def scaled(column: pa.Array, width: int) -> np.ndarray:
    """floor(64 * c) of each vector as a row of ``width`` longs; what a short vector lacks counts as 0."""
    flat = np.floor(np.asarray(column.flatten(), np.float64) * SCALE)
    flat = np.clip(flat, -FAR, FAR).astype(np.int64)
    sizes = np.asarray(column.value_lengths(), np.int64)
    if (sizes == width).all():
        return flat.reshape(len(column), width)
    out = np.zeros((len(column), width), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def sums_of(rows: DataFrame) -> tuple[int, list[int]]:
    """The number of rows and the exact sum of each dimension: each task sends a number for each dimension, which are summed by dimension."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(0, object)
        for batch in batches:
            column = batch.column("__v")
            if not len(column):
                continue
            y = scaled(column, max(len(total), int(np.asarray(column.value_lengths()).max())))
            total = np.concatenate([total, np.zeros(y.shape[1] - len(total), object)])
            for at in range(0, len(y), 1024):  # 1024 * 2**52 is a long
                total = total + y[at : at + 1024].sum(axis=0).astype(object)
            n += len(y)
        if n:
            dims = [-1, *range(len(total))]
            yield pa.RecordBatch.from_arrays([pa.array(dims, pa.int32()), pa.array([Decimal(n), *(Decimal(int(x)) for x in total)], pa.decimal128(38, 0))], names=["dim", "s"])

    found = {r["dim"]: int(r["s"]) for r in map_arrow(rows.select("__v"), run, "dim int, s decimal(38,0)").groupBy("dim").agg(F.sum("s").cast("decimal(38,0)").alias("s")).collect()}
    return found.pop(-1, 0), [found[k] for k in range(len(found))]


def centre(sums: list[int], n: int) -> np.ndarray:
    return np.array([float(Fraction(s, n)) for s in sums])


def applied(rows: DataFrame, mean: np.ndarray, n: int) -> Callable[[np.ndarray], np.ndarray]:
    """The covariance as a function of a block of columns: each call is one pass in which a task sends Z'(Z v) of its centred rows Z, a row
    for each dimension, and those are summed by dimension."""
    width = len(mean)

    def apply(block: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(block.shape)
            for batch in batches:
                z = scaled(batch.column("__v"), width) - mean
                total += z.T @ (z @ block)
            yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["dim", "p"])

        parts = map_arrow(rows.select("__v"), run, "dim int, p array<double>")
        found = parts.groupBy("dim").agg(*(F.sum(F.get("p", F.lit(k))).alias(f"p{k}") for k in range(block.shape[1]))).collect()
        out = np.zeros(block.shape)
        for r in found:
            out[r["dim"]] = r[1:]
        return out / n

    return apply


def orthonormal(block: np.ndarray, basis: np.ndarray, width: int, rng: np.random.Generator) -> np.ndarray:
    """``width`` orthonormal columns, orthogonal to ``basis``, that span what ``block`` adds to it. A column that adds nothing, as the
    basis holds it already, is a breakdown: a random one takes its place."""
    out = basis
    k = basis.shape[1]
    for j in range(width):
        x = block[:, j] if j < block.shape[1] else rng.standard_normal(basis.shape[0])
        while True:
            before = np.linalg.norm(x)
            for _ in range(3):  # full reorthogonalisation, repeated for double precision
                x = x - out @ (out.T @ x)
            after = np.linalg.norm(x)
            if before > 0 and after > 1e-10 * before:
                break
            x = rng.standard_normal(basis.shape[0])
        x = x / after
        for _ in range(2):
            x = x - out @ (out.T @ x)
            x = x / np.linalg.norm(x)
        out = np.column_stack([out, x])
    return out[:, k:]


def block_lanczos(apply: Callable[[np.ndarray], np.ndarray], width: int, wanted: int, block: int = BLOCK, tolerance: float = TOLERANCE, seed: int = 0) -> tuple[np.ndarray, np.ndarray, int]:
    """The ``wanted`` largest eigenvalues of a symmetric positive map of ``width`` dimensions, unit eigenvectors, and passes taken.

    Blocks are images of the blocks before, orthogonal to all of them. It ends when each wanted pair's true residual is within
    ``tolerance`` of the largest eigenvalue, and stays so, the values too, through one block from random columns (an eigenvalue that comes
    more often than a block has columns would else be missed), or when the basis spans everything. The driver holds the basis and its images.
    """
    rng = np.random.default_rng(seed)
    wanted = min(wanted, width)
    basis, images, passes, confirmed = np.zeros((width, 0)), np.zeros((width, 0)), 0, None
    following = rng.standard_normal((width, min(block, width)))
    while True:
        fresh = orthonormal(following, basis, min(block, width - basis.shape[1]), rng)
        image = apply(fresh)
        passes += 1
        basis, images = np.column_stack([basis, fresh]), np.column_stack([images, image])
        small = basis.T @ images
        values, vectors = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(-values)[:wanted]
        values, vectors = values[order], vectors[:, order]
        ritz = basis @ vectors
        residuals = np.linalg.norm(images @ vectors - ritz * values, axis=0)
        largest = max(abs(values[0]), np.finfo(float).tiny)
        if basis.shape[1] == width:
            break
        following = image
        if len(values) == wanted and (residuals <= tolerance * largest).all():
            if confirmed is not None and (abs(confirmed - values) <= 10 * tolerance * largest).all():
                break
            confirmed, following = values, np.zeros((width, 0))
        else:
            confirmed = None
    return values, ritz / np.linalg.norm(ritz, axis=0), passes


def fit(rows: DataFrame, components: int = 32, block: int = BLOCK) -> Model:
    """Sums by one pass, eigenpairs by a few; no rows, or rows that are all equal, give no components."""
    n, sums = sums_of(rows)
    if not n or not sums:
        return Model(n, sums, np.zeros(0), np.zeros((len(sums), 0)), 1)
    values, vectors, passes = block_lanczos(applied(rows, centre(sums, n), n), len(sums), components, block)
    kept = values > NOTHING * max(values[0], 0)
    return Model(n, sums, values[kept], vectors[:, kept], passes + 1)


def deviations(y: np.ndarray, sums: list[int], n: int) -> list[int]:
    """Sum over dimensions of (n * x - S)**2 of each row, exact."""
    if max(1, int(np.abs(y).max(initial=0))) * n < 1 << 61 and all(abs(s) < 1 << 61 for s in sums):
        d = n * y - np.array(sums, np.int64)
        if int(np.abs(d).max(initial=0)) ** 2 * max(1, d.shape[1]) < 1 << 63:
            return (d * d).sum(axis=1).tolist()
    d = n * y.astype(object) - np.array(sums, object)
    return (d * d).sum(axis=1).tolist()


def whiten(df: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", components: int = 32, block: int = BLOCK) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error, deviation_exact: a row for each usable row and component.

    Entries become floor(64 * c); rows are centred, projected on the unit eigenvectors of their covariance (divisor n) by falling eigenvalue and
    divided by its root. explained is the eigenvalue's share of the trace, which is the sum of all deviations over n cubed; identity_error is
    the largest entry of the whitened rows' covariance less the identity. Rows whose vector is null or has null or non-finite entries
    go, repeated rows and null ids are rows like others; vectors of fewer dimensions than the longest have zeros there, scaled entries
    beyond 2**52 count as that. Eigenvalues that are nothing against the largest have no component, so one row or equal rows give none, and
    neither does an empty table. deviation is null where it exceeds a long, deviation_exact has it up to 38 digits. Other columns are not read.

    Tasks send sums of theirs, one row a dimension; the driver holds the basis, dimensions squared at most, whatever the rows.
    """
    rows = usable(df, vector_column, F.col(id_column).cast("long").alias("vec_id"))
    model = fit(rows, components, block)
    n, sums, width, found = model.n, model.sums, len(model.sums), len(model.values)
    shape = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact decimal(38,0)"
    if not found:
        return df.sparkSession.createDataFrame([], shape)
    mean, onto = centre(sums, n), model.vectors / np.sqrt(model.values)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, deviation = np.zeros((found, found)), 0
        for batch in batches:
            y = scaled(batch.column("__v"), width)
            w = (y - mean) @ onto
            gram += w.T @ w
            deviation += sum(deviations(y, sums, n))
        # In two halves, as a sum over all rows may have more than 38 digits.
        high, low = divmod(deviation, 10**30)
        columns = [pa.array(range(found), pa.int32()), pa.array(list(gram), pa.list_(pa.float64())), *(pa.array([Decimal(x)] + [None] * (found - 1), pa.decimal128(38, 0)) for x in (high, low))]
        yield pa.RecordBatch.from_arrays(columns, names=["i", "g", "high", "low"])

    parts = map_arrow(rows.select("__v"), measured, "i int, g array<double>, high decimal(38,0), low decimal(38,0)")
    sums_by_row = parts.groupBy("i").agg(*(F.sum(F.get("g", F.lit(k))).alias(f"g{k}") for k in range(found)), F.sum("high").alias("high"), F.sum("low").alias("low")).collect()
    gram, total = np.zeros((found, found)), 0
    for r in sums_by_row:
        gram[r["i"]] = r[1 : found + 1]
        total += int(r["high"] or 0) * 10**30 + int(r["low"] or 0)
    error = float(np.abs(gram / n - np.eye(found)).max())
    explained = [float(Fraction(float(v)) * n**3 / total) for v in model.values]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                y = scaled(batch.column("__v"), width)
                w = (y - mean) @ onto
                exact, rows_of = deviations(y, sums, n), np.repeat(np.arange(len(y)), found)
                short = pa.array([d if d < 1 << 63 else None for d in exact], pa.int64())
                long = pa.array([Decimal(d) if d < 10**38 else None for d in exact], pa.decimal128(38, 0))
                k = len(rows_of)
                columns = [batch.column("vec_id").take(pa.array(rows_of)), pa.array(np.tile(np.arange(1, found + 1, dtype=np.int32), len(y))), pa.array(np.full(k, n)), short.take(pa.array(rows_of)), pa.array(w.ravel()), pa.array(np.tile(explained, len(y))), pa.array(np.full(k, error)), long.take(pa.array(rows_of))]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_exact"])

    return map_arrow(rows, run, shape)


def op13_embedding_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).drop("deviation_exact")
