"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation with full reorthogonalisation.

Rows with a null vector, or a null or non-finite entry, are left out. Entries become whole numbers
floor(256 * c); shorter vectors count as padded with zeros to the longest. Components come from the fit
list, each distinct vector once: a table that steps of the bidiagonalisation pass over. A step multiplies
the centred rows by the newest right vector and the transposed rows by the result. Left vectors, as long as
the table, are never stored: each is the centred rows times a short vector that the driver holds, so a task
makes those of its rows again, takes out of the new one what earlier ones hold, and adds up the transposed
product, all in one pass whose result is as long as a vector. Where more than half of a new left vector was
taken out, a second pass takes out the rest. Right vectors are reorthogonalised on the driver, twice.
The small bidiagonal matrix's singular values and right vectors give deviations and components.

The process stops once the wanted components are as exact as doubles allow, or its basis is complete.
In the first case a second one, on what the found components leave, shows that none was missed, as a
component may have an equal eigenvalue; it stops as soon as the largest of the rest is surely smaller.
Components beyond the rank of the centred rows are none: with one distinct vector, there are no rows.
The exact deviation is null where it is beyond a long. Ties: equal vectors have equal values, repeated rows
and ids are rows of their own, null ids stay null. An empty table has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbgrid.scratch import dropped, written

COMPONENTS = 4
#: What a residual may be of the largest singular value, and of what a component without deviation is.
EXACT, NOTHING = 4e-16, 1e-12
#: Rows that a task multiplies at once.
AT_ONCE = 4096


class Fit(NamedTuple):
    """n distinct vectors, their exact sums, the trace of their covariance, components (rows) with
    eigenvalues, the identity error, and the passes over the fit list."""

    n: int
    sums: list[int]
    trace: float
    vectors: np.ndarray
    values: np.ndarray
    identity_error: float
    passes: int


def whole_vectors(embeddings: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id, x (array<long>) of the rows that remain."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(f"`{column}`").cast("array<double>").alias("e")).filter("e IS NOT NULL")
    fine = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return rows.filter(F.forall("e", fine)).select("vec_id", F.transform("e", lambda c: F.floor(c * 256)).alias("x"))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    """Rows of a list column, padded to d."""
    lengths, flat = np.diff(column.offsets.to_numpy()), column.flatten().to_numpy(zero_copy_only=False)
    if (lengths == d).all():
        return flat.reshape(len(lengths), d)
    out = np.zeros((len(lengths), d), np.int64)
    out[np.arange(d)[None, :] < lengths[:, None]] = flat
    return out


def _added(fit: DataFrame, d: int, make, kind: str = "double") -> dict[int, float]:
    """Sums by position of what make(rows) gives for each part of the rows; one array a task is summed before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                part = make(_matrix(batch.column(0).slice(at, AT_ONCE), d))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array([*map(str, total.tolist())] if kind != "double" else total)], names=["i", "v"])

    sent = fit.select("x").mapInArrow(run, f"i long, v {'double' if kind == 'double' else 'string'}").withColumn("v", F.col("v").cast(kind))
    return {r["i"]: r["v"] for r in sent.groupBy("i").agg(F.sum("v").alias("v")).collect()}


class _Process:
    """Golub-Kahan-Lanczos on the centred rows of a fit list."""

    def __init__(self, fit: DataFrame, d: int, mean: np.ndarray) -> None:
        self.fit, self.d, self.mean, self.passes, self.draw = fit, d, mean, 0, np.random.default_rng(12)

    def product(self, short: np.ndarray, earlier: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
        """Of u = rows @ short: the transposed rows times u, its square, and its products with earlier left
        vectors (rows @ earlier)."""
        mean, self.passes = self.mean, self.passes + 1
        both = np.concatenate([short[:, None], earlier], 1)

        def part(x: np.ndarray) -> np.ndarray:
            rows = x - mean
            left = rows @ both
            u = left[:, 0]
            return np.concatenate([rows.T @ u, u @ left])

        got = _added(self.fit, self.d, part)
        flat = np.array([got.get(i, 0.0) for i in range(self.d + 1 + earlier.shape[1])])
        return flat[: self.d], float(flat[self.d]), flat[self.d + 1 :]

    def fresh(self, held: np.ndarray) -> np.ndarray | None:
        """A unit vector orthogonal to the columns held, None if they span all."""
        if held.shape[1] >= self.d:
            return None
        v = self.draw.standard_normal(self.d)
        for _ in range(3):
            v -= held @ (held.T @ v)
            v /= np.linalg.norm(v)
        return v

    def run(self, locked: np.ndarray, wanted: int, enough: float = 0.0) -> tuple[np.ndarray, np.ndarray, bool]:
        """The largest singular values and right vectors (columns) orthogonal to locked, and whether the basis is
        complete. With enough it stops once the largest is surely below that."""
        v = self.fresh(locked)
        right, short, z = np.zeros((self.d, 0)), np.zeros((self.d, 0)), np.zeros((self.d, 0))
        alphas, betas, beta, scale = [], [], 0.0, 0.0
        while v is not None:
            # u = (rows v - beta u_last) less what earlier left vectors hold, as rows @ y; z_j = transposed rows @ u_j
            y = v - (beta * short[:, -1] if alphas else 0.0)
            t, square, inner = self.product(y, short)
            left_out, size = short @ inner, max(square - float(inner @ inner), 0.0)
            if size < 0.75 * square or not np.isfinite(square):
                y = y - left_out
                t, square, inner = self.product(y, short)
                left_out, size = short @ inner, max(square - float(inner @ inner), 0.0)
            y, t, alpha = y - left_out, t - z @ inner, float(np.sqrt(size))
            right, scale = np.concatenate([right, v[:, None]], 1), max(scale, alpha)
            null = alpha <= NOTHING * max(scale, 1.0)
            alphas.append(0.0 if null else alpha)
            betas.append(beta)
            t, y = (np.zeros(self.d), np.zeros(self.d)) if null else (t / alpha, y / alpha)
            short, z = np.concatenate([short, y[:, None]], 1), np.concatenate([z, t[:, None]], 1)
            w, held = t - alphas[-1] * v, np.concatenate([locked, right], 1)
            for _ in range(2):
                w = w - held @ (held.T @ w)
            beta = float(np.linalg.norm(w))
            scale = max(scale, beta)
            broke = beta <= NOTHING * max(scale, 1.0)
            v = self.fresh(held) if broke else w / beta
            beta = 0.0 if broke else beta
            small = np.diag(alphas) + np.diag(betas[1:], 1)
            p, s, qt = np.linalg.svd(small)
            residual = beta * np.abs(p[-1])
            if v is not None and len(s) >= wanted + 2 and not broke:
                if (residual[:wanted] <= EXACT * s[0]).all() if not enough else s[0] + residual[0] < enough and residual[0] <= 1e-3 * s[0]:
                    return s, right @ qt.T, False
        if not alphas:
            return np.zeros(0), np.zeros((self.d, 0)), True
        return s, right @ qt.T, True


def fitted(rows: DataFrame) -> Fit | None:
    """What the distinct vectors of rows (x array<long>) give; None without entries."""
    fit = written(rows.select("x").distinct(), "fit")
    size = fit.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("d")).first()
    n, d = size["n"], size["d"]
    if not n or not d:  # nothing, or empty vectors only
        dropped(fit)
        return None
    exact = _added(fit, d, lambda x: x.astype(object).sum(0) if len(x) and np.abs(x.astype(float)).max() * len(x) > 2.0**60 else x.sum(0).astype(object), "decimal(38,0)")
    sums = [int(exact.get(i, 0)) for i in range(d)]
    mean = np.array([s / n for s in sums])
    trace = _added(fit, d, lambda x: np.array([((x - mean) ** 2).sum()]))[0] / n
    process, values, vectors = _Process(fit, d, mean), np.zeros(0), np.zeros((d, 0))
    if trace > 0:
        s, found, complete = process.run(vectors, COMPONENTS)
        values, vectors = s[:COMPONENTS], found[:, :COMPONENTS]
        while not complete:
            s, more, complete = process.run(vectors, 1, enough=float(values[-1]) * (1 - 1e-9))
            if not len(s) or s[0] <= values[-1] * (1 - 1e-9):
                break
            values, vectors = np.concatenate([values, s[:1]]), np.concatenate([vectors, more[:, :1]], 1)
            order = np.argsort(-values, kind="stable")
            values, vectors = values[order], vectors[:, order]
    kept = values[:COMPONENTS] > NOTHING * max(values[:1].max(initial=0.0), 1.0)
    values, vectors = values[:COMPONENTS][kept] ** 2 / n, vectors[:, :COMPONENTS][:, kept]
    k = len(values)

    def spread(x: np.ndarray) -> np.ndarray:
        w = (x - mean) @ vectors / np.sqrt(values)
        return np.concatenate([(w.T @ w).ravel(), w.sum(0)])

    error = 0.0
    if k:
        flat = _added(fit, d, spread)
        flat = np.array([flat[i] for i in range(k * k + k)]) / n
        error = float(np.abs(flat[: k * k].reshape(k, k) - np.outer(flat[k * k :], flat[k * k :]) - np.eye(k)).max())
    dropped(fit)
    return Fit(n, sums, trace, vectors.T, values, error, process.passes)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """sum((n * x - sums) ** 2) of each row, exact."""
    most = n * int(np.abs(x.astype(float)).max(initial=0)) + max(map(abs, sums), default=0)
    if most * most * max(len(sums), 1) < 1 << 62:
        return ((n * x - np.array(sums, np.int64)) ** 2).sum(1).tolist()
    whole = ((n * x.astype(object) - np.array(sums, object)) ** 2).sum(1)
    return [v if v < 1 << 63 else None for v in whole]


def whitened(embeddings: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each remaining vector and
    component, up to COMPONENTS."""
    rows = whole_vectors(embeddings, column)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    fit = fitted(rows)
    if fit is None or not len(fit.values):
        return embeddings.sparkSession.createDataFrame([], schema)
    d, k, mean = len(fit.sums), len(fit.values), np.array([s / fit.n for s in fit.sums])
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, AT_ONCE):
                batch = whole.slice(at, AT_ONCE)
                x = _matrix(batch.column(1), d)
                w = (x - mean) @ fit.vectors.T / np.sqrt(fit.values)
                one, m = np.repeat(np.arange(len(x)), k), len(x)
                columns = [batch.column(0).take(pa.array(one)), np.tile(np.arange(1, k + 1), m), np.full(m * k, fit.n), pa.array(deviations(x, fit.n, fit.sums), pa.int64()).take(pa.array(one)), w.ravel(), np.tile(fit.values / fit.trace, m), np.full(m * k, fit.identity_error)]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types)], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema)
