"""Subjects with a long first axis against one numpy decomposition each."""

import numpy as np

from fieldspark.operators import decomposition

AXES = {"i0": 90, "a": 4, "t": 3}


def table(spark, xs):
    rows = [(k, *map(int, i), float(x[tuple(i)])) for k, x in xs.items() for i in np.argwhere(x)]
    return spark.createDataFrame(rows, "subject string, i0 int, a int, t int, v double")


def values(frame):
    return {(r["subject"], r["part"], r["mode"], r["row"], r["rank"]): r["value"] for r in frame.collect()}


def test_long_subjects(spark, monkeypatch):
    monkeypatch.setattr(decomposition, "FAN", 2)
    r = np.random.default_rng(0)
    x = r.standard_normal((90, 4, 3))
    x[5:20] = 0
    coo = table(spark, {"x": x, "y": 3 + r.random((90, 4, 3))})
    got, want = (values(f(coo, AXES, [3, 2, 2])) for f in (lambda *a: decomposition.per_subject_long(*a, block=10), decomposition.per_subject))
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-7 for k in got)


def test_subject_of_low_rank(spark):
    """Of rank one: the other columns are orthonormal all the same."""
    got = values(decomposition.per_subject_long(table(spark, {"x": np.arange(1.0, 91)[:, None, None] * np.ones((1, 4, 3))}), AXES, [3, 2, 2], block=16))
    u = np.array([[got["x", "factor", 0, i, k] for k in range(3)] for i in range(90)])
    assert np.allclose(u.T @ u, np.eye(3)) and got["x", "error", -1, 0, 0] < 1e-7


def test_every_supplier_has_a_row(spark):
    """Keys begin with 0 in the tables."""
    from fieldspark.plans import queries

    small = "/root/testdata/sf0.001"
    suppliers = spark.read.parquet(f"{small}/supplier.parquet").count()
    got = values(queries.QUERIES["hooi_subjects"](spark, small))
    for key in {k[0] for k in got}:
        u = np.array([[got[key, "factor", 0, i, k] for k in range(4)] for i in range(suppliers)])
        assert np.allclose(u.T @ u, np.eye(4))
