"""Blocks of tensors and axes with factors as tables, against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldspark.functions import kernels as K
from fieldspark.operators import blocks, tall

AXES = {"i0": 13, "i1": 5, "t": 9}
SIZES = {"i0": 4, "i1": 5, "t": 4}


def coo(spark, x, names):
    at = np.argwhere(x)
    return spark.createDataFrame([(*map(int, i), float(x[tuple(i)])) for i in at], ", ".join([*[f"{n} int" for n in names], "v double"]))


def dense(t):
    x = np.zeros(tuple(t.axes.values()))
    for r in blocks.to_coo(t).collect():
        x[tuple(r[a] for a in t.axes)] = r["v"]
    return x


@pytest.fixture(scope="module")
def x():
    y = np.random.default_rng(1).standard_normal(tuple(AXES.values()))
    y[4:8, :, :4] = 0  # a block that isn't there
    return y


@pytest.fixture(scope="module")
def t(spark, x):
    return blocks.from_coo(coo(spark, x, AXES), AXES, SIZES)


def test_blocks_hold_the_tensor(spark, x, t):
    assert t.frame.count() == 4 * 1 * 3 - 1
    assert np.array_equal(dense(t), x)
    most = t.frame.select(F.max(F.length("data"))).first()[0]
    assert most == 8 * 4 * 5 * 4
    other = blocks.reblock(t, {"i0": 5, "i1": 2, "t": 9})
    assert np.array_equal(dense(other), x) and other.frame.select(F.max(F.length("data"))).first()[0] == 8 * 5 * 2 * 9
    assert np.isclose(blocks.norm2(t), (x * x).sum())


def test_entries_of_one_place_add_up(spark):
    rows = spark.createDataFrame([(0, 0, 1.0), (0, 0, 2.5), (6, 2, None), (6, 2, 4.0)], "a int, b int, v double")
    got = dense(blocks.from_coo(rows, {"a": 7, "b": 3}, {"a": 3, "b": 2}))
    assert got[0, 0] == 3.5 and got[6, 2] == 4.0 and got.sum() == 7.5
    assert blocks.from_coo(rows.limit(0), {"a": 7, "b": 3}).frame.count() == 0


def test_products_and_grams(x, t):
    r = np.random.default_rng(2)
    f = {a: r.standard_normal((n, 3)) for a, n in AXES.items()}
    got = dense(blocks.multiply(t, {"i0": f["i0"], "t": f["t"]}))
    assert np.allclose(got, K.multi_dot(x, [f["i0"], np.eye(5), f["t"]], transpose=True))
    up = {"i0": r.standard_normal((20, 13))}
    assert np.allclose(dense(blocks.multiply(t, up, False)), K.mode_dot(x, up["i0"], 0))
    for m, a in enumerate(AXES):
        y = K.unfold(x, m)
        assert np.allclose(blocks.gram(t, a), y @ y.T)


def test_reconstruct_shuffles_nothing(spark):
    r = np.random.default_rng(3)
    core = r.standard_normal((2, 3, 2))
    f = {a: r.standard_normal((n, k)) for (a, n), k in zip(AXES.items(), core.shape)}
    got = blocks.reconstruct(spark, core, f, SIZES)
    assert np.allclose(dense(got), K.multi_dot(core, list(f.values())))
    assert "Exchange" not in got.frame._jdf.queryExecution().toString()


def test_tucker_of_blocks(x, t):
    core, f, error = blocks.tucker(t, [4, 3, 3], 1e-9, 2)
    want = K.tucker(x, [4, 3, 3], 1e-9, 2)
    assert abs(error - want.error(x)) < 1e-6
    assert np.allclose(K.multi_dot(core, list(f.values())), want.full(), atol=1e-6)


def lower(spark, seed=4):
    r = np.random.default_rng(seed)
    y = K.multi_dot(r.standard_normal((3, 2, 3)), [r.standard_normal((n, k)) for n, k in zip(AXES.values(), (3, 2, 3))])
    return y, blocks.from_coo(coo(spark, y, AXES), AXES, SIZES)


def test_long_axes_are_exact_at_low_rank(spark):
    y, t = lower(spark)
    core, f, error = tall.tucker(t, [3, 2, 3], ("i0", "t"), rounds=1)
    assert error < 1e-7 and isinstance(f["i0"], blocks.Blocks) and isinstance(f["i1"], np.ndarray)
    assert np.allclose(dense(tall.reconstruct(spark, core, f)), y)
    u = dense(f["i0"])
    assert np.allclose(u.T @ u, np.eye(3))


def test_long_axes_elsewhere(x, t):
    """Not of low rank: near the best error, which orthogonal iteration over whole matrices finds."""
    _, _, error = tall.tucker(t, [4, 3, 3], ("i0",), rounds=2)
    assert error <= K.tucker(x, [4, 3, 3], 1e-9, 2).error(x) * 1.02


def test_blocks_of_one_place_meet_in_many_tasks(spark, monkeypatch):
    """The other axis is one block, so all of the long axis' blocks meet the same one; one task read them all."""
    monkeypatch.setattr(blocks, "HELD", 2)
    r = np.random.default_rng(8)
    y, q = r.standard_normal((64, 3)), r.standard_normal((2, 3))
    t = blocks.from_coo(coo(spark, y, "ab").withColumn("a", F.col("a") - 4), {"a": 64, "b": 3}, {"a": 4, "b": 3})  # a block before the first, too
    z = blocks.from_coo(coo(spark, q, "ab"), {"a": 2, "b": 3}, {"a": 2, "b": 3})
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        dealt = [n["count"] for n in tall._paired(t, z, "a").groupBy(F.spark_partition_id()).count().collect()]
        got = {r["a"]: np.frombuffer(r["data"]).reshape(-1, 2) for r in tall._against(t, z, "a").frame.collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(dealt) == 16 and max(dealt) < 16
    assert np.allclose(np.vstack([got[b] for b in sorted(got)]), y @ q.T)


def test_range_finder_bound(spark):
    """Singular values that fall off: an error not far above the first value left out."""
    r = np.random.default_rng(6)
    u, v = np.linalg.qr(r.standard_normal((60, 30)))[0], np.linalg.qr(r.standard_normal((30, 30)))[0]
    y = u * 0.5 ** np.arange(30) @ v.T
    t = blocks.from_coo(coo(spark, y, "ab"), {"a": 60, "b": 30}, {"a": 16, "b": 8})
    q = dense(tall.leading(t, "a", 5, more=4))
    assert np.linalg.norm(y - q @ (q.T @ y), 2) < 1.01 * 0.5**5


def test_triangles_meet_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(tall, "FAN", 2)
    monkeypatch.setattr(tall, "STACK", 3)
    a = np.random.default_rng(7).standard_normal((50, 4))
    t = tall.from_array(spark, a, "a", 3)
    t = blocks.Blocks(t.frame.repartition(7), t.axes, t.sizes)
    assert np.allclose(np.abs(tall.triangle(t)), np.abs(np.linalg.qr(a, mode="r")))
    q = dense(tall.orthonormal(t))
    assert np.allclose(q.T @ q, np.eye(4)) and np.allclose(q @ (q.T @ a), a)
    assert np.allclose(np.abs(dense(tall.signed(t))), np.abs(a)) and (dense(tall.signed(t))[np.abs(a).argmax(axis=0), range(4)] > 0).all()
    few = tall.left_vectors(tall.times(t, np.outer([1, 2, 3, 4.0], [1, 1, 0])))
    assert few.axes["rank"] == 1  # of rank one


def path(n):
    """Edges of a path's Laplacian, as arrays and as rows."""
    rows = [(i, i, 2.0 if 0 < i < n - 1 else 1.0) for i in range(n)] + [(i, i + s, -1.0) for i in range(n) for s in (-1, 1) if 0 <= i + s < n]
    return tuple(np.array(c) for c in zip(*rows)), rows


def test_smoothing_by_conjugate_gradients(spark):
    edges, rows = path(23)
    rhs = np.random.default_rng(8).standard_normal((23, 3))
    beta = np.array([3.0, 9.0, 40.0])
    matrix = tall.edge_blocks(spark.createDataFrame(rows, "src long, dst long, l double"), 4)
    assert matrix.count() > 6 and matrix.select(F.max(F.length("l"))).first()[0] <= 8 * 16
    got = dense(tall.smooth_solve(matrix, tall.from_array(spark, rhs, "c", 4), 0.3, beta))
    m = np.zeros((23, 23))
    np.add.at(m, (edges[0], edges[1]), edges[2])
    for k in range(3):
        assert np.allclose(got[:, k], np.linalg.solve(beta[k] * np.eye(23) + 0.3 * m @ m, rhs[:, k]), atol=1e-6)


def test_geometry_tucker_is_that_of_one_machine(spark):
    edges, rows = path(13)
    r = np.random.default_rng(9)
    y = r.standard_normal((13, 9)) @ np.diag(2.0 ** -np.arange(9))
    t = blocks.from_coo(coo(spark, y, ("i0", "t")), {"i0": 13, "t": 9}, {"i0": 4, "t": 5})
    core, f, error = tall.tucker(t, [3, 3], ("i0",), {"i0": spark.createDataFrame(rows, "src long, dst long, l double")}, alpha=0.5, epsilon=1e-2, rounds=50)
    want = K.geometry_tucker(y, [3, 3], edges, 0.5, (0,), 1e-2)
    assert abs(error - want.error(y)) < 1e-6
    assert np.allclose(dense(f["i0"]), want.factors[0], atol=1e-6)
    assert np.allclose(K.multi_dot(core, [dense(f["i0"]), f["t"]]), want.full(), atol=1e-6)
    assert f["i0"].frame.count() == 4  # no block holds the whole axis


def test_isolated_cells(spark):
    """Rows that no edge meets are only divided."""
    matrix = tall.edge_blocks(spark.createDataFrame([(0, 0, 1.0), (0, 1, -1.0), (1, 0, -1.0), (1, 1, 1.0)], "src long, dst long, l double"), 2)
    got = dense(tall.smooth_solve(matrix, tall.from_array(spark, np.ones((6, 1)), "c", 2), 1.0, np.array([4.0])))
    assert np.allclose(got, 0.25)
