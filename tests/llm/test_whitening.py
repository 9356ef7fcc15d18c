"""Whitening against exact integers and a dense eigensolver."""

import math
from fractions import Fraction

import numpy as np
import pytest

from tidegrid.llm import whitening as wh

SCHEMA = "vec_id bigint, embedding array<float>"


def frame(spark, vectors, schema=SCHEMA):
    return spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(vectors)], schema).repartition(3)


def result(df, most=32):
    return wh.whiten(df, wh.learn(df, most=most)).toPandas().sort_values(["vec_id", "component"])


def compare(spark, vectors, most=32, schema="vec_id bigint, embedding array<double>"):
    got = result(frame(spark, vectors, schema), most)
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(d)]
    centred = np.array([[float(Fraction(n * r[j] - s[j], n)) for j in range(d)] for r in x])
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1][:most], u[:, ::-1][:, :most]
    k = int((e > 1e-10 * e[0]).sum())
    assert len(got) == n * k and set(got["n"]) == {n}
    assert got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] <= 1e-4
    deviation = got.groupby("vec_id")["deviation"].first()
    assert all(deviation[i] == sum((n * r[j] - s[j]) ** 2 for j in range(d)) for i, r in enumerate(x))
    w = got["whitened"].to_numpy().reshape(n, k)
    assert np.allclose(w.T @ w / n, np.eye(k), atol=1e-6)
    explained = got["explained"].to_numpy().reshape(n, k)
    assert np.allclose(explained, e[:k] / (centred**2).sum() * n, rtol=1e-6)
    return w, centred @ u[:, :k] / np.sqrt(e[:k])


def test_equals_the_dense_solution_up_to_sign(spark):
    rng = np.random.default_rng(2)
    w, want = compare(spark, (rng.standard_normal((200, 40)) * np.geomspace(3, 0.3, 40)).astype(np.float32))
    sign = np.sign((w * want).sum(axis=0))
    assert np.abs(w - want * sign).max() < 1e-9


@pytest.mark.parametrize("offset", [0.0, 1e5, -3e7])
def test_far_from_the_origin(spark, offset):
    rng = np.random.default_rng(3)
    w, want = compare(spark, rng.standard_normal((60, 5)) + offset)
    assert np.abs(w - want * np.sign((w * want).sum(axis=0))).max() < 1e-8


def test_equal_variances_and_lost_dimensions(spark):
    corners = [[a, b, 0.5] for a in (0, 1) for b in (0, 1)] * 5  # two equal eigenvalues, one zero
    compare(spark, corners)
    line = np.outer(np.arange(30), [1, 2, -1, 0])
    assert result(frame(spark, line))["component"].max() == 1


def test_left_out_rows_and_odd_tables(spark):
    nan, inf = float("nan"), float("inf")
    good = [[1.0, 2.0], [3.0, -1.0], [0.0, 0.0], [0.0, 0.0], [5.0, 7.0]]
    bad = [None, [], [1.0, None], [nan, 1.0], [inf, 0.0], [-inf, 0.0], [1.0], [1.0, 2.0, 3.0]]
    rows = [(i, v, "x", 1) for i, v in enumerate(good)] + [(100 + i, v, None, None) for i, v in enumerate(bad)] + [(None, [2.0, 2.0], "y", 2)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, component string, n int")
    got = result(df)
    assert set(got["vec_id"].dropna().astype(int)) == set(range(5)) and got["vec_id"].isna().sum() == 2 and set(got["n"]) == {6}
    repeated = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])], SCHEMA)
    assert len(result(repeated)) == 3
    for none in ([], [(1, None)], [(1, [2.0, 3.0])], [(1, [2.0]), (2, [2.0])]):
        df = spark.createDataFrame(none, SCHEMA)
        assert wh.whiten(df, wh.learn(df)).count() == 0


def test_huge_entries_have_a_defined_result(spark):
    df = frame(spark, [[1e30, 0.0], [-1e30, 1.0], [0.0, 2.0]], "vec_id bigint, embedding array<double>")
    got = result(df)
    assert len(got) and got["deviation"].isna().any() and got["identity_error"].iloc[0] < 1e-4


def test_string_ids(spark):
    df = spark.createDataFrame([("a", [1.0]), ("b", [2.0])], "vec_id string, embedding array<float>")
    assert set(result(df)["vec_id"]) == {"a", "b"}


@pytest.mark.parametrize("values", [
    np.geomspace(1, 1e-9, 64), np.r_[np.full(20, 5.0), np.full(44, 1.0)], 1 + 1e-10 * np.arange(64), np.arange(64.0), np.r_[1e6, np.ones(63)]])
def test_slices_hold_what_the_inertia_counts(values):
    q = np.linalg.qr(np.random.default_rng(4).standard_normal((64, 64)))[0]
    v = (q * values) @ q.T
    inertia, true = wh.Inertia(v), np.sort(values)[::-1]
    slices = inertia.slices(32)
    found = []
    for a, b, inside in slices:
        e, y = wh.feast(v, a, b, inside, inertia.norm)
        assert len(e) == inside and np.linalg.norm(v @ y - y * e, axis=0).max() <= 1e-12 * inertia.norm
        found += e.tolist()
    found = np.sort(found)[::-1]
    assert len(found) >= 32 and np.abs(found - true[: len(found)]).max() <= 1e-13 * true[0] * 64
    shifts = (true[:-1] + true[1:])[true[:-1] - true[1:] > 1e-3] / 2
    assert (inertia.above(shifts) == [(true > s).sum() for s in shifts]).all()
