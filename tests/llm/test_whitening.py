"""Whitening against a plain eigendecomposition."""

import numpy as np
import pytest

from kerbgrid.llm import whitening

SCHEMA = "vec_id long, embedding array<float>"


def plain(rows):
    kept = [(i, [int(np.floor(256 * np.float64(np.float32(c)))) for c in v]) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    d = max((len(v) for _, v in kept), default=0)
    kept = [(i, v + [0] * (d - len(v))) for i, v in kept]
    fit = np.array(sorted({tuple(v) for _, v in kept}), dtype=float)
    centred = fit - fit.mean(0)
    e, q = np.linalg.eigh(centred.T @ centred / len(fit))
    sums = [sum(v[i] for v in {tuple(v) for _, v in kept}) for i in range(d)]
    deviation = [sum((len(fit) * x - s) ** 2 for x, s in zip(v, sums)) for _, v in kept]
    return kept, len(fit), e[::-1], q[:, ::-1], sums, deviation


def agrees(spark, rows, components=4, vectors=True):
    got = whitening.whitened(spark.createDataFrame(rows, SCHEMA)).toPandas()
    kept, n, e, q, sums, deviation = plain(rows)
    assert len(got) == len(kept) * components and (got["n"] == n).all()
    for k in range(1, components + 1):
        part = got[got["component"] == k]
        assert sorted(zip(part["vec_id"].fillna(-1), part["deviation"])) == sorted(zip([-1 if i is None else i for i, _ in kept], deviation))
        np.testing.assert_allclose(part["explained"], e[k - 1] / e.sum(), rtol=1e-9)
        if vectors:
            own = np.array([(np.array(v) - np.array(sums) / n) @ q[:, k - 1] / np.sqrt(e[k - 1]) for _, v in kept])
            one = part["whitened"].to_numpy()
            want = own * np.sign(own @ one)
            np.testing.assert_allclose(one, want, atol=1e-9)
    assert (got["identity_error"] < 1e-9).all()


def test_components_of_odd_rows(spark):
    draw = np.random.default_rng(1)
    rows = [(i, (draw.standard_normal(9) * np.arange(1, 10)).tolist()) for i in range(200)]
    rows += rows[:20] + [(None, rows[3][1]), (7, None), (8, [None] * 9), (9, [float("nan")] * 9), (10, [float("inf")] + [0.0] * 8), (11, [1.0, -0.0]), (12, [])]
    agrees(spark, rows)


def test_equal_eigenvalues_and_few_dimensions(spark):
    units = [(i, [float((i % 6) == j) for j in range(6)]) for i in range(12)]
    agrees(spark, units, vectors=False)  # all five eigenvalues are one
    agrees(spark, [(0, [1.0, 0.0]), (1, [0.0, 2.0]), (2, [5.0, 5.0])], components=2)
    agrees(spark, [(0, [1.0, 1.0, 1.0]), (1, [3.0, 3.0, 3.0])], components=1)


def test_equal_eigenvalue_beside_a_found_one_is_not_missed(spark):
    # Pairs of opposite vectors: the two largest eigenvalues are the same, and many smaller ones follow.
    rows = []
    for j in range(40):
        size = 40.0 if j < 2 else 30.0 - j / 2
        rows += [(2 * j, [size * (i == j) for i in range(40)]), (2 * j + 1, [-size * (i == j) for i in range(40)])]
    agrees(spark, rows, vectors=False)


def test_tables_without_deviation_have_no_components(spark):
    for rows in ([], [(1, None)], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, [])]):
        assert whitening.whitened(spark.createDataFrame(rows, SCHEMA)).count() == 0


def test_exact_deviations_beyond_64_bits_are_null():
    x = np.array([[1 << 40, 0], [3, 4]])
    assert whitening.deviations(x, 10, [10, 20]) == [None, (30 - 10) ** 2 + (40 - 20) ** 2]


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_components_of_the_table(spark, sf):
    df = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").select("vec_id", "embedding")
    agrees(spark, [(r[0], list(r[1])) for r in df.collect()])
