"""Embedding whitening by incremental eigendecomposition.

A vector's entries are scaled and floored to whole numbers; the fit list has each distinct vector once. Every task runs through its
part of the list with a running mean, and updates the eigenvalues and eigenvectors of its scatter matrix by one centred rank-one
step per vector (secular.py). The parts' spectra are combined in a tree: the eigenpairs of one part, and the difference of the
means, are further rank-one steps on the other. At last a pass over the list refines the basis (Rayleigh-Ritz): the covariance is
taken in the basis, which leaves a small matrix that is nearly diagonal, and its eigenvectors turn the basis. Sums of the vectors
are exact, and vectors are centred by them before anything is multiplied.

What reaches the driver is bounded by the dimension d: d sums and d * d numbers. A task holds one batch of vectors and one basis.

Vectors that are null or hold null or non-finite entries take no part and are not returned. Shorter vectors than the longest are
filled up with zeros; entries beyond a long are cut to it. A repeated row is returned as often as it occurs, and an empty table
gives an empty one. A component without variance (relative to the largest, d times the rounding of a double) has no whitened value
(null) and explains 0; if there is no variance at all, `explained` and `identity_error` are null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayline.llm.secular import EPS, rank_one
from assayline.llm.storage import stored

#: Vectors of the fit list that one task works in, and spectra that one task combines.
PART_ROWS = 8192
FAN = 8
#: Below this, sums of squares of a few thousand entries are whole numbers of 64 bits.
WIDE = 1 << 24

SPECTRUM = "part long, n long, mean array<double>, e array<double>, u array<double>"


def whole_numbers(vector: Column, scale: int) -> Column:
    """floor(scale * entry) of every entry, as long."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * F.lit(float(scale))).cast("long"))


def is_complete(vector: Column) -> Column:
    """Whether a vector is there and all its entries are finite numbers."""
    big = float("inf")
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == big))
    return vector.isNotNull() & ~bad


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    """The vectors of a batch as rows, filled up with zeros to d columns."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    if (sizes == d).all():
        return flat.reshape(-1, d)
    out = np.zeros((len(sizes), d), np.int64)
    out[np.arange(d)[None, :] < sizes[:, None]] = flat
    return out


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x less the mean sums / n, rounded once where the numbers allow it."""
    if len(x) == 0 or max(abs(int(x.min())), abs(int(x.max()))) * n + max(map(abs, sums)) >= 1 << 53:
        return x.astype(np.float64) - np.array([s / n for s in sums])
    return (x * n - np.array(sums, np.int64)) / n


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """sum((n x - sums)^2) of each row, exactly."""
    if not len(x):
        return []
    if max(abs(int(x.min())), abs(int(x.max()))) >= WIDE or x.shape[1] * WIDE >= 1 << 38:
        return [sum((n * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x.tolist()]
    # n^2 x.x - 2 n x.sums + sums.sums, with the sums in digits of 24 bits.
    own = (x * x).sum(1).tolist()
    cross = [0] * len(x)
    rest, at = [abs(s) for s in sums], 0
    while any(rest):
        digit = np.array([(r & (WIDE - 1)) * (1 if s >= 0 else -1) for r, s in zip(rest, sums, strict=True)], np.int64)
        cross = [c + (int(p) << at) for c, p in zip(cross, x @ digit, strict=True)]
        rest, at = [r >> 24 for r in rest], at + 24
    total = sum(s * s for s in sums)
    return [n * n * o - 2 * n * c + total for o, c in zip(own, cross, strict=True)]


def _vector_sums(fit: DataFrame, d: int) -> list[int]:
    """Exact sums of the entries by dimension."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = [0] * d, [0] * d
        for batch in batches:
            x = _matrix(batch.column("x"), d)
            low = [a + b for a, b in zip(low, (x & 0xFFFFFFFF).sum(0).tolist(), strict=True)]
            high = [a + b for a, b in zip(high, (x >> 32).sum(0).tolist(), strict=True)]
        whole = pa.array(range(d), pa.int32())
        yield pa.RecordBatch.from_arrays([whole, pa.array(low, pa.int64()), pa.array(high, pa.int64())], names=["i", "low", "high"])

    parts = fit.mapInArrow(summed, "i int, low long, high long").groupBy("i")
    exact = parts.agg(F.sum(F.col("low").cast("decimal(38,0)")), F.sum(F.col("high").cast("decimal(38,0)"))).collect()
    sums = [0] * d
    for i, low, high in exact:
        sums[i] = int(low) + (int(high) << 32)
    return sums


def _joined(parts: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """The spectrum of several parts together: n, mean, eigenvalues, eigenvectors of the scatter matrix."""
    (n, mean, e, u), *others = sorted(parts, key=lambda p: -p[0])
    for n2, mean2, e2, u2 in others:
        for value, vector in zip(e2, u2.T, strict=True):
            if value > 0:
                e, u = rank_one(e, u, vector, value)
        gap = mean2 - mean
        e, u = rank_one(e, u, gap, n * n2 / (n + n2))
        mean = mean + gap * (n2 / (n + n2))
        n += n2
    return n, mean, e, u


def _spectrum(fit: DataFrame, n: int, d: int) -> np.ndarray:
    """Orthonormal basis of the eigenvectors of the fit list's covariance, as columns."""

    def updated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, mean, e, u = 0, np.zeros(d), np.zeros(d), np.eye(d)
        for batch in batches:
            for x in _matrix(batch.column("x"), d).astype(np.float64):
                gap = x - mean
                if m:
                    e, u = rank_one(e, u, gap, m / (m + 1))
                m += 1
                mean += gap / m
        if m:
            row = {"part": TaskContext.get().partitionId(), "n": m, "mean": mean.tolist(), "e": e.tolist(), "u": u.ravel().tolist()}
            yield pa.RecordBatch.from_pylist([row])

    def combined(rows: pd.DataFrame) -> pd.DataFrame:
        parts = [(r.n, np.array(r.mean), np.array(r.e), np.array(r.u).reshape(d, d)) for r in rows.itertuples()]
        m, mean, e, u = _joined(parts)
        return pd.DataFrame({"part": [rows["part"].iloc[0] // FAN], "n": [m], "mean": [mean], "e": [e], "u": [u.ravel()]})

    parts = ceil(n / PART_ROWS)
    spectra = stored(fit.repartition(parts).mapInArrow(updated, SPECTRUM), "spectra")
    while parts > 1:
        grouped = spectra.withColumn("to", F.expr(f"part div {FAN}")).groupBy("to")
        spectra = stored(grouped.applyInPandas(lambda rows: combined(rows.drop(columns="to")), SPECTRUM), "spectra")
        parts = ceil(parts / FAN)
    return np.array(spectra.first()["u"]).reshape(d, d)


def _products(fit: DataFrame, d: int, projected: Callable[[np.ndarray], np.ndarray], width: int) -> np.ndarray:
    """Sum of the outer products of the projected vectors of the fit list."""

    def multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            y = projected(_matrix(batch.column("x"), d))
            total += y.T @ y
        places = pa.array(np.arange(width * width, dtype=np.int64))
        yield pa.RecordBatch.from_arrays([places, pa.array(total.ravel())], names=["place", "value"])

    sums = fit.mapInArrow(multiplied, "place long, value double").groupBy("place").agg(F.sum("value")).collect()
    out = np.zeros(width * width)
    for place, value in sums:
        out[place] = value
    return out.reshape(width, width)


def fit_whitening(fit: DataFrame, k: int) -> dict[str, Any] | None:
    """Means and leading components of a list of distinct whole-number vectors (column x): n, sums, values (falling), components
    (columns), trace, identity_error. None for an empty list."""
    n, d = fit.agg(F.count("*"), F.max(F.size("x"))).first()
    if not n or not d:
        return None
    sums = _vector_sums(fit, d)
    basis = _spectrum(fit, n, d)
    inner = _products(fit, d, lambda x: _centred(x, n, sums) @ basis, d) / n
    values, turn = np.linalg.eigh((inner + inner.T) / 2)
    order = np.argsort(-values, kind="stable")[:k]
    components = basis @ turn[:, order]
    components /= np.sqrt((components**2).sum(0))
    top = np.maximum(values[order], 0.0)
    alive = top > d * EPS * top.max()
    trace = float(np.maximum(values, 0.0).sum())
    error = None
    if alive.any():
        scale = np.where(alive, 1 / np.sqrt(np.where(alive, top, 1.0)), 0.0)
        own = _products(fit, d, lambda x: _centred(x, n, sums) @ (components * scale), len(order)) / n
        error = float(np.abs((own - np.eye(len(order)))[np.ix_(alive, alive)]).max())
    top = np.where(alive, top, 0.0)
    return {"n": n, "sums": sums, "values": top, "components": components, "trace": trace, "identity_error": error}


def whiten(
    table: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 4, scale: int = 256
) -> DataFrame:
    """Each complete vector in the coordinates of the k leading components, in units of their standard deviations.

    Returns id_col, component (from 1 by falling variance), n (vectors of the fit list), deviation (decimal: the exact sum of
    (n x - sums)^2), whitened, explained (share of the variance), identity_error (largest absolute entry of the whitened fit list's
    covariance less the identity). With fewer dimensions than k there are as many components as dimensions.
    """
    complete = table.filter(is_complete(F.col(vector_col)))
    rows = complete.select(F.col(id_col).alias("id"), whole_numbers(F.col(vector_col), scale).alias("x"))
    fit = stored(rows.select("x").distinct(), "vectors")
    model = fit_whitening(fit, k)
    out = "component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    empty = rows.select("id", *[F.lit(None).cast(c.split(" ")[1]).alias(c.split(" ")[0]) for c in out.split(", ")])
    if model is None:
        return empty.filter(F.lit(False)).withColumnRenamed("id", id_col)
    n, sums, values, components = model["n"], model["sums"], model["values"], model["components"]
    d, width = components.shape
    alive = values > 0
    projection = components * np.where(alive, 1 / np.sqrt(np.where(alive, values, 1.0)), np.nan)
    explained = [float(v / model["trace"]) if model["trace"] > 0 else None for v in values]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x"), d)
            white = (_centred(x, n, sums) @ projection).ravel()
            deviation = np.repeat(np.array([*_deviations(x, n, sums), None], object)[:-1], width)
            size = len(white)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").take(pa.array(np.repeat(np.arange(len(x)), width))),
                    pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(size, n, np.int64)),
                    pa.array(deviation.tolist(), pa.decimal128(38, 0)),
                    pa.array(white, mask=np.isnan(white)),
                    pa.array(explained * len(x), pa.float64()),
                    pa.array([model["identity_error"]] * size, pa.float64()),
                ],
                names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(scored, empty.schema).withColumnRenamed("id", id_col)
