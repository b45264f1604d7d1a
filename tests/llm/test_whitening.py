"""Whitening against a dense eigendecomposition; the Lanczos iteration against matrices whose spectrum is known."""

from fractions import Fraction

import numpy as np
import pytest

from parley.llm import whitening as w


def plain(vectors, components=32):
    """By component number: (whitened column, explained), deviations, n; vectors are lists of floats of one length."""
    x = np.array([[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in vectors], object)
    n, s = len(x), x.sum(axis=0)
    deviation = [int(sum((n * a - b) ** 2 for a, b in zip(row, s))) for row in x]
    z = np.array([[float(Fraction(int(n * a - b), n)) for a, b in zip(row, s)] for row in x])
    values, vectors = np.linalg.eigh(z.T @ z / n)
    order = np.argsort(-values)[:components]
    values, vectors = values[order], vectors[:, order]
    return z @ vectors / np.sqrt(values), values * n**3 / float(sum(deviation)), deviation, n


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_the_query_equals_a_dense_eigendecomposition(spark, sf):
    folder = f"/root/testdata/sf{sf}"
    rows = [r for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect() if r["embedding"] is not None and all(c is not None and np.isfinite(c) for c in r["embedding"])]
    white, explained, deviation, n = plain([r["embedding"] for r in rows])
    got = w.op13_embedding_whitening(spark, folder).toPandas()
    assert list(got.columns) == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert len(got) == 32 * n and set(got["n"]) == {n} and got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-9
    table = got.pivot(index="vec_id", columns="component", values="whitened").loc[[r["vec_id"] for r in rows]].to_numpy()
    signs = np.sign((table * white).sum(axis=0))
    assert np.abs(table * signs - white).max() < 1e-8
    assert np.allclose(got.groupby("component")["explained"].first().to_numpy(), explained, rtol=1e-10)
    assert got.groupby("vec_id")["deviation"].first().to_dict() == {r["vec_id"]: d for r, d in zip(rows, deviation)}


def spectrum(values, seed):
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))[0]
    return (q * np.asarray(values, float)) @ q.T


@pytest.mark.parametrize("values", [
    [*range(100, 0, -1)], [5.0] * 40 + [1.0] * 60, [9.0] * 3 + [0.0] * 97, [2.0**-k for k in range(100)], [1.0] * 100, [7.0, 7.0, 3.0] + [1e-9] * 97, [1000.0] + [1.0 + k * 1e-6 for k in range(99)],
])
@pytest.mark.parametrize("block", [1, 4, 16])
def test_known_spectra(values, block):
    """Many equal eigenvalues, few dimensions that matter (breakdowns), steep and flat spectra."""
    a = spectrum(values, 3)
    found, vectors, passes = w.block_lanczos(a.dot, 100, 8, block)
    assert np.allclose(found, sorted(values, reverse=True)[:8], rtol=0, atol=1e-9 * max(values))
    assert np.abs(vectors.T @ vectors - np.eye(8)).max() < 1e-10
    assert np.linalg.norm(a @ vectors - vectors * found, axis=0).max() < 1e-11 * max(values)
    assert passes <= -(-100 // block)


def test_few_passes_where_few_directions_matter():
    values = [1000.0 / 4**k for k in range(6)] + [1e-14] * 394
    found, _, passes = w.block_lanczos(spectrum(values, 4).dot, 400, 4, 8)
    assert np.allclose(found, values[:4]) and passes <= 5


def test_no_row_is_too_large(monkeypatch):
    """Deviations are exact beyond longs."""
    y = np.array([[w.FAR, -w.FAR, 3], [5, 7, -11]])
    sums, n = [w.FAR + 5, -w.FAR + 7, -8], 2
    want = [sum((n * int(a) - s) ** 2 for a, s in zip(row, sums)) for row in y]
    assert w.deviations(y, sums, n) == want and max(want) > 1 << 63


SHAPE = "vec_id long, embedding array<float>, component int, n int, label int, __w int"


def test_odd_rows(spark):
    rng = np.random.default_rng(9)
    vectors = [list(map(float, v)) for v in rng.standard_normal((60, 5))]
    rows = [(k, v) for k, v in enumerate(vectors)] + [(7, vectors[7]), (None, vectors[8]), (100, None), (101, [1.0, None, 2.0, 3.0, 4.0]), (102, [1.0, float("nan"), 2.0, 3.0, 4.0]), (103, [float("inf")] * 5), (104, []), (105, [1.0, 2.0])]
    df = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], SHAPE).repartition(3)
    kept = [(i, [*map(float, np.float32(v)), *[0.0] * (5 - len(v))]) for i, v in rows if v is not None and None not in v and np.isfinite(v).all()]
    white, explained, deviation, n = plain([v for _, v in kept])
    got = w.whiten(df).toPandas()
    assert len(got) == 5 * len(kept) and n == len(kept) == 64
    assert sorted(set(zip(got["vec_id"].fillna(-1), got["deviation"]))) == sorted({(-1 if i is None else i, d) for (i, _), d in zip(kept, deviation)})
    first = got[got["component"] == 1]
    assert np.allclose(sorted(np.abs(first["whitened"])), sorted(np.abs(white[:, 0])), atol=1e-9)
    assert abs(got.groupby("component")["explained"].first().sum() - 1) < 1e-9


def test_nothing_to_whiten(spark):
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(k, [1.0, 2.0]) for k in range(9)], [(1, [])]):
        assert w.whiten(spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], SHAPE)).count() == 0
    line = [(k, [float(k), 2.0 * k, 1.0]) for k in range(9)]  # one direction only
    got = w.whiten(spark.createDataFrame([(*r, 1, 2, 3, 4) for r in line], SHAPE)).toPandas()
    assert len(got) == 9 and set(got["component"]) == {1} and abs(got["explained"].iloc[0] - 1) < 1e-9


def test_far_entries(spark):
    rows = [(k, [1e30 if k == 3 else float(k), float(k * k % 7)]) for k in range(9)]
    got = w.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas()
    assert got["deviation"].isna().any() and got["deviation_exact"].notna().all()
