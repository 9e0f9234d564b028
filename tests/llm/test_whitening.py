"""Whitening against exact fractions and plain numpy; refinement on clustered and extreme spectra."""

from __future__ import annotations

import math
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest

from recohort.llm import whitening

FOLDER = "/root/testdata/sf0.001"


def plain(rows):
    """{id: [(n, deviation, whitened, explained)]} of one length, the covariance by exact fractions."""
    sound = [(i, [math.floor(64 * float(c)) + 1000000 for c in v]) for i, v in rows
             if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    listed = sorted({tuple(x) for _, x in sound})
    n, dims = len(listed), len(listed[0])
    sums = [sum(x[k] for x in listed) for k in range(dims)]
    away = [[n * x[k] - sums[k] for k in range(dims)] for x in listed]
    cov = np.array([[float(Fraction(sum(a[i] * a[j] for a in away), n**3)) for j in range(dims)] for i in range(dims)])
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = []
    for i, x in sound:
        d = [n * a - s for a, s in zip(x, sums, strict=True)]
        z = np.array(d, float) / n @ vectors[:, :16] / np.sqrt(values[:16])
        out.append((i, n, sum(a * a for a in d), z, values[:16] / np.trace(cov)))
    return out


def compare(found, want):
    got = defaultdict(list)
    for r in found:
        got[r["vec_id"]].append(r)
    signs = np.zeros(len(want[0][3]))
    assert len(found) == sum(len(w[3]) for w in want)
    for i, n, deviation, z, explained in want:
        rows = sorted(got[i], key=lambda r: r["component"])[:len(z)]
        assert [r["component"] for r in rows] == list(range(1, len(z) + 1))
        assert all(r["n"] == n and r["deviation"] == deviation and int(r["deviation_text"]) == deviation for r in rows)
        mine = np.array([r["whitened"] for r in rows])
        signs = np.where(signs == 0, np.sign(mine * z), signs)
        assert mine * signs == pytest.approx(z, rel=1e-7, abs=1e-9)
        assert [r["explained"] for r in rows] == pytest.approx(list(explained), rel=1e-9)
    assert {r["identity_error"] for r in found}.__len__() == 1 and found[0]["identity_error"] < 1e-9


def test_given_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").select("vec_id", "embedding").collect()]
    compare(whitening.op13_whitening(spark, FOLDER).collect(), plain(rows))


def run(frame):
    spaces = whitening.fit(frame)
    return whitening.components(whitening.whiten(frame, spaces), spaces).collect()


def test_hard_rows(spark):
    sound = [(1, [0.5, -1.25, 3.0]), (2, [0.5, -1.25, 3.0]), (3, [0.51, -1.26, 3.001]), (4, [2.0, 9.0, -4.0]), (4, [7.0, 0.0, 1.0]), (None, [1e9, 2.0, -3e9]),
             (9, [-5.0, 1.0, 2.5])]
    unsound = [(5, None), (6, [1.0, None, 2.0]), (7, [float("nan"), 0.0, 0.0]), (8, [float("inf"), 0.0, 0.0]), (10, [])]
    schema = "vec_id long, embedding array<double>, x string, whitened int, space int, n string"
    frame = spark.createDataFrame([(*r, "x", 1, 2, "n") for r in sound + unsound], schema)
    found = run(frame)
    assert len(found) == 3 * len(sound)
    assert {r["n"] for r in found} == {6} and {r["component"] for r in found} == {1, 2, 3}
    want = {str(w[2]) for w in plain(sound)}
    assert {r["deviation_text"] for r in found} == want
    # Beyond a long: the digits stay in the text.
    assert any(r["deviation"] is None for r in found) and all(r["deviation"] in (None, int(r["deviation_text"])) for r in found)
    assert run(frame.limit(0)) == [] and run(frame.where("embedding is null")) == []


def test_spaces_and_flat_components(spark):
    frame = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 5.0]), (3, [4.0]), (4, [4.0])], "vec_id long, embedding array<float>")
    found = {(r["vec_id"], r["component"]): r for r in run(frame)}
    assert set(found) == {(1, 1), (1, 2), (2, 1), (2, 2), (3, 1), (4, 1)}
    assert abs(found[1, 1]["whitened"]) == pytest.approx(1) and found[1, 1]["whitened"] == -found[2, 1]["whitened"]
    assert found[1, 2]["whitened"] is None and found[1, 1]["explained"] == 1.0 and found[1, 1]["identity_error"] < 1e-12
    assert found[3, 1]["whitened"] is None and found[3, 1]["explained"] is None and found[3, 1]["n"] == 1 and found[3, 1]["deviation"] == 0


def test_very_large_entries(spark):
    frame = spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 2.0])], "vec_id long, embedding array<double>")
    found = run(frame)
    # The second component has 1e-36 of the variance of the first: none that is left after rounding.
    assert len(found) == 6 and all(r["identity_error"] < 1e-4 and (r["whitened"] is None) == (r["component"] == 2) for r in found)


@pytest.mark.parametrize("values", [
    np.linspace(1, 5, 40), np.r_[np.full(5, 1 + 1e-9) + np.arange(5) * 1e-12, np.linspace(2, 9, 20)], np.r_[np.full(6, 2.0), np.full(6, 3.0), 7.0],
    np.geomspace(1e-8, 1, 12), np.r_[np.full(4, 1.0) + np.arange(4) * 1e-7, 1 + 1e-15, 4.0]])
def test_refinement(values):
    random = np.random.Generator(np.random.PCG64(4))
    q = np.linalg.qr(random.normal(size=(len(values), len(values))))[0].astype(np.longdouble)
    for _ in range(3):
        q = q + q @ (np.eye(len(values), dtype=np.longdouble) - q.T @ q) / 2
    matrix = q * values.astype(np.longdouble) @ q.T
    matrix = (matrix + matrix.T) / 2
    found, vectors = whitening.eigen(matrix)
    assert np.abs(found - np.sort(values)[::-1]).max() < 1e-16 * values.max()
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-17
    assert np.abs(matrix @ vectors - vectors * found).max() < 2e-17 * values.max()
    # A float32 start alone is far from that.
    assert np.abs(matrix @ np.linalg.eigh(matrix.astype(np.float32))[1].astype(np.longdouble)[:, ::-1] - vectors * found).max() > 1e-9


def test_products_are_exact():
    big = np.array([[2**40, -3], [2**41 + 1, 5]])
    assert whitening.products(big).tolist() == [[2**80 + (2**41 + 1) ** 2, -3 * 2**40 + 5 * (2**41 + 1)], [-3 * 2**40 + 5 * (2**41 + 1), 34]]
