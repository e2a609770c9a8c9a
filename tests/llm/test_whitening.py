import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayline.llm import queries, whitening
from assayline.llm.secular import rank_one

COLUMNS = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def plain(rows, k=4):
    """Whole numbers, exact sums, one eigendecomposition: rows by id, and the eigenvalues."""
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    d = max((len(v) for _, v in kept), default=0)
    xs = [(i, tuple(math.floor(256 * c) for c in v) + (0,) * (d - len(v))) for i, v in kept]
    fit = np.array(sorted({x for _, x in xs}), dtype=np.int64).reshape(-1, d)
    n = len(fit)
    sums = [int(s) for s in fit.sum(0)]
    centred = (fit * n - np.array(sums)) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    trace = (centred**2).sum() / n
    white = [(i, x, (np.array(x) * n - np.array(sums)) / n @ vectors / np.sqrt(values)) for i, x in xs]
    deviation = {x: sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)) for _, x in xs}
    return n, [(i, deviation[x], w) for i, x, w in white], values / trace


def check(df, rows, k=4):
    assert df.columns == COLUMNS
    n, want, explained = plain(rows, k)
    got = df.collect()
    assert len(got) == len(want) * len(explained)
    assert {r.n for r in got} == {n}
    assert all(0 <= r.identity_error <= 1e-9 for r in got)
    assert sorted(str((r.vec_id, r.deviation)) for r in got if r.component == 1) == sorted(str(w[:2]) for w in want)
    assert all(r.explained == pytest.approx(explained[r.component - 1], rel=1e-9) for r in got)
    for c in range(len(explained)):
        ours = {(r.vec_id, r.deviation): r.whitened for r in got if r.component == c + 1}
        theirs = {w[:2]: w[2][c] for w in want}
        sign = math.copysign(1, sum(ours[i] * theirs[i] for i in ours))
        assert all(ours[i] * sign == pytest.approx(theirs[i], abs=1e-7) for i in ours)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_whole_table(spark, sf, monkeypatch):
    monkeypatch.setattr(whitening, "PART_ROWS", 30)  # many parts, two rounds of combination
    monkeypatch.setattr(whitening, "FAN", 3)
    folder = f"/root/testdata/{sf}"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect()
    check(queries.op12_whitening(spark, folder), [tuple(r) for r in rows])


def odd_vectors():
    rng = np.random.default_rng(5)
    good = [(i, [float(c) for c in np.round(rng.normal(size=6) * [1, 2, 3, 4, 5, 6], 2)]) for i in range(60)]
    bad = [(100, None), (101, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (102, [float("nan")] * 6), (103, [float("inf")] * 6)]
    same = [good[0], good[0], (None, good[1][1]), (104, [c + 0.0001 for c in good[2][1]]), (105, [0.5, -0.0, 1.0]), (106, [])]
    return good + bad + same


def test_odd_rows(spark, on_table, monkeypatch):
    """Nulls, bad entries, repeated rows and vectors, short vectors; clashing columns."""
    monkeypatch.setattr(whitening, "PART_ROWS", 7)
    rows = odd_vectors()
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for name in ("id", "x", "n", "part", "component", "deviation"):
        table = table.withColumn(name, F.lit("?"))
    check(on_table("op12_whitening", table, spark), rows)


@pytest.mark.parametrize("copies", [1, 200])
def test_a_third_alike(spark, on_table, copies):
    rows = odd_vectors()[:60] + [(i, [1.0] * 6) for i in range(copies)]
    check(on_table("op12_whitening", spark.createDataFrame(rows, "vec_id long, embedding array<double>"), spark), rows)


def test_without_variance(spark, on_table):
    layout = "vec_id long, embedding array<float>"
    assert on_table("op12_whitening", spark.createDataFrame([(1, None), (2, [float("nan")])], layout), spark).collect() == []
    one = on_table("op12_whitening", spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], layout), spark).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [
        (c, 1, 0, None, None, None) for _ in range(2) for c in (1, 2)
    ]
    flat = [(i, [float(i), float(i), 3.0]) for i in range(9)]
    got = on_table("op12_whitening", spark.createDataFrame(flat, layout), spark).collect()
    assert {(r.component, r.whitened is None, round(r.explained, 9)) for r in got} == {
        (1, False, 1.0), (2, True, 0.0), (3, True, 0.0)
    }
    assert all(r.identity_error < 1e-9 for r in got)


def test_exact_deviations():
    rng = np.random.default_rng(0)
    for high in (1 << 10, 1 << 23, 1 << 40):
        x = rng.integers(-high, high, size=(20, 9))
        n, sums = 10**10 + 7, [int(s) * 10**9 for s in x.sum(0)]
        want = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x]
        assert whitening._deviations(x, n, sums) == want


@pytest.mark.parametrize("kind", ["random", "whole", "copies", "flat", "near"])
def test_rank_one(kind):
    """Eigenvalues and an orthogonal basis against a direct decomposition, with equal and nearly equal eigenvalues."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(150, 12)) * np.geomspace(1e-3, 10, 12)
    if kind == "whole":
        x = np.floor(x)
    if kind == "copies":
        x = np.repeat(x[:5], 30, 0)
    if kind == "flat":
        x[:, 4:] = 0
    if kind == "near":
        x = np.concatenate([np.eye(12), np.eye(12) * (1 + 1e-15), x[:3] * 1e-9])
    e, u = np.zeros(12), np.eye(12)
    for row in x:
        before = u.copy()
        e2, u2 = rank_one(e, u, row)
        assert (u == before).all()  # the given basis is left as it was
        e, u = e2, u2
    scatter = x.T @ x
    largest = np.linalg.eigvalsh(scatter).max()
    assert np.abs(u.T @ u - np.eye(12)).max() < 1e-12
    assert np.abs((u * e) @ u.T - scatter).max() < 1e-13 * largest
    assert np.abs(e - np.linalg.eigvalsh(scatter)).max() < 1e-13 * largest
