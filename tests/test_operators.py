import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fieldspark.functions import kernels as K
from fieldspark.functions import scalars as S
from fieldspark.operators import analysis, decomposition, experiments, graph, placement, sensing, stats, tensor
from fieldspark.plans import queries
from fieldspark.sources import generators, readers, sinks
from fieldspark.streaming import online


def coo(spark, x, names=("i0", "i1", "t"), subject=None):
    i = np.indices(x.shape).reshape(x.ndim, -1)
    t = pd.DataFrame({**dict(zip(names, i)), "v": x.ravel().astype(float)})
    if subject is not None:
        t.insert(0, "subject", subject)
    kinds = ["subject string"] * (subject is not None) + [f"{n} int" for n in names] + ["v double"]
    return spark.createDataFrame(t, ", ".join(kinds))


def back(frame, shape, names=("i0", "i1", "t")):
    return decomposition.dense(frame.toPandas(), dict(zip(names, shape)))


X = np.random.default_rng(42).random((8, 6, 4))


def test_shapes(spark):
    c = coo(spark, X)
    assert np.allclose(back(tensor.unflatten(tensor.flatten(c, {"i0": 8, "i1": 6}), {"i0": 8, "i1": 6}), X.shape), X)
    t = tensor.tubes(tensor.flatten(c, {"i0": 8, "i1": 6}), ["cell"], 4).toPandas().sort_values("cell")
    assert np.allclose(np.stack(t["tube"]), X.reshape(48, 4))
    assert tensor.zero_fill(c.filter("t > 1"), {"i0": 8, "i1": 6, "t": 4}).count() == X.size
    again = tensor.untube(tensor.tubes(c, ["i0", "i1"], 4))
    assert np.allclose(back(again, X.shape), X)


def test_gram_and_products(spark):
    c, axes = coo(spark, X), {"i0": 8, "i1": 6, "t": 4}
    for k, m in enumerate(axes):
        assert np.allclose(decomposition._gram(c, m, axes), K.unfold(X, k) @ K.unfold(X, k).T)
    u = np.random.default_rng(1).random((6, 3))
    p = back(tensor.mode_product(c, decomposition.factor_frame(spark, u), "i1", True), (8, 3, 4))
    assert np.allclose(p, K.mode_dot(X, u.T, 1))


def test_distributed_tucker_agrees(spark):
    core, factors, error = decomposition.distributed(coo(spark, X), {"i0": 8, "i1": 6, "t": 4}, [4, 3, 2], epsilon=1e-9, rounds=15)
    local = K.tucker(X, [4, 3, 2], epsilon=1e-9)
    assert error == pytest.approx(local.error(X), abs=1e-3)
    f = {n: decomposition.factor_frame(spark, u) for n, u in zip(("i0", "i1", "t"), factors)}
    rebuilt = back(decomposition.reconstruct(core, f), X.shape)
    assert np.linalg.norm(rebuilt - X) / np.linalg.norm(X) == pytest.approx(error, abs=1e-6)


def test_decomposer_states(spark):
    d = decomposition.Decomposer({"i0": 8, "i1": 6, "t": 4}, 2)
    with pytest.raises(RuntimeError):
        d.reconstruct()
    d.set_ranks([2, 2, 2])
    d.decompose(coo(spark, X))
    with pytest.raises(RuntimeError):
        d.set_ranks(3)
    assert d.reconstruct().count() == X.size and d.state == "reconstructed"


def test_per_subject(spark):
    both = coo(spark, X, subject="a").unionByName(coo(spark, X * 2, subject="b"))
    t = decomposition.per_subject(both, {"i0": 8, "i1": 6, "t": 4}, [3, 3, 3]).toPandas()
    e = t[(t["part"] == "error") & (t["mode"] == -1)].set_index("subject")["value"]
    assert e["a"] == pytest.approx(e["b"]) and (t["part"] == "factor").sum() == 2 * (8 + 6 + 4) * 3


def test_normalise_round_trip(spark):
    c = coo(spark, X * 100, subject="a")
    for m, tol in (("minmax", 1e-4), ("zscore", 1e-4), ("maxabs", 1e-4)):
        p = stats.fit(c)
        n = stats.apply(c, p, m)
        if m == "minmax":
            lo, hi = n.agg(F.min("v"), F.max("v")).first()
            assert 0 <= lo and hi <= 1
        assert np.allclose(back(stats.apply(n, p, m, inverse=True), X.shape), X * 100, atol=tol)
    with pytest.raises(ValueError):
        stats.apply(c, stats.fit(c), "other")


def test_empty_foreground(spark):
    z = coo(spark, np.zeros((2, 2, 2)))
    assert tuple(stats.foreground_stats(z, background=0.0).first()) == (0.0, 0.0, 0.0, 1.0)


def test_splits(spark):
    c = coo(spark, np.ones((2, 2, 20)), subject="a").unionByName(coo(spark, np.ones((2, 2, 10)), subject="b"))
    n = {(r["subject"], r["part"]): r["n"] for r in stats.split_ordered(c).groupBy("subject", "part").agg(F.countDistinct("t").alias("n")).collect()}
    assert n == {("a", "train"): 16, ("a", "test"): 4, ("b", "train"): 8, ("b", "test"): 2}
    a = stats.split_three(c, 0.8, 0.1, shuffle_seed=42).groupBy("part").count().count()
    assert a == 3
    with pytest.raises(ValueError):
        stats.split_three(c, 0.9, 0.2)
    r = stats.split_random(c, 2).filter("part = 'test'").groupBy("subject", "experiment").agg(F.countDistinct("t").alias("n")).collect()
    assert {(x["subject"], x["n"]) for x in r} == {("a", 4), ("b", 2)}


def test_metrics(spark):
    pairs = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0)], "rec double, ref double")
    m = stats.metrics(pairs).first()
    assert m["error"] == 0 and m["psnr"] == float("inf")
    const = spark.createDataFrame([(10.0, 10.0)] * 4, "rec double, ref double")
    assert stats.metrics(const).first()["psnr"] == 0.0


def test_detrend_demean(spark):
    line = np.arange(10.0)[None, None, :] * 3 + 5
    assert np.allclose(back(stats.detrend(coo(spark, line), ["i0", "i1"], 10), (1, 1, 10)), 0, atol=1e-9)
    assert np.allclose(back(stats.demean(coo(spark, X), ["i0", "i1"]), X.shape), X - X.mean(axis=2, keepdims=True))


def test_knn_square(spark):
    v = spark.createDataFrame([(0, [0.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0])], "cell long, coord array<double>")
    e = graph.knn_graph(v, 3).toPandas()
    assert len(e) == 12 and (e["src"] != e["dst"]).all()
    assert e[(e["src"] == 0) & (e["dst"] == 3)]["dist"].iloc[0] == pytest.approx(np.sqrt(2))
    w = graph.with_distances(graph.mirrored(spark.createDataFrame([(0, 1), (0, 2), (1, 2)], "src long, dst long")), v).toPandas()
    assert sorted(w["dist"].round(6)) == [1, 1, 1, 1, 1.414214, 1.414214]


def test_knn_is_exact(spark):
    p = np.vstack([np.random.default_rng(3).random((60, 2)), [[9.0, 9.0], [9.1, 9.0]]])
    v = spark.createDataFrame([(i, list(map(float, x))) for i, x in enumerate(p)], "cell long, coord array<double>")
    got = {(r["src"], r["dst"]) for r in graph.knn_graph(v, 4).collect()}
    want = set()
    for i in range(len(p)):
        for j in np.argsort(np.where(np.arange(len(p)) == i, np.inf, np.linalg.norm(p - p[i], axis=1)), kind="stable")[:4]:
            want |= {(i, int(j)), (int(j), i)}
    assert got == want


def test_radius_graph(spark):
    p = np.random.default_rng(4).random((80, 2))
    v = spark.createDataFrame([(i, list(map(float, x))) for i, x in enumerate(p)], "cell long, coord array<double>")
    got = {(r["src"], r["dst"]) for r in graph.radius_graph(v, 0.1).collect()}
    d = np.linalg.norm(p[:, None] - p[None], axis=2)
    assert got == {(i, j) for i in range(80) for j in range(80) if i != j and d[i, j] <= 0.1}
    with pytest.raises(ValueError):
        graph.radius_graph(v, None)


def test_proximity(spark):
    v = spark.createDataFrame([(i, [float(i), 0.0]) for i in (0, 1, 2, 3)], "cell long, coord array<double>")
    s = v.filter("cell < 2").select("coord")
    got = {r["cell"]: r["v"] for r in graph.proximity(v, s, 0.5).collect()}
    assert got == pytest.approx({0: 1.0, 1: 1.0, 2: np.exp(-2), 3: np.exp(-4)}, rel=1e-6)
    near = graph.nearest_sensor(v, s).join(v, "cell")
    assert graph.update_nearest(near, [3.0, 0.0]).filter("cell = 3").first()["dmin"] == 0


def test_place_distributed_agrees(spark):
    a = np.random.default_rng(5).standard_normal((40, 6))
    t = spark.createDataFrame([(i, list(map(float, r))) for i, r in enumerate(a)], "cell long, tube array<double>")
    one, two = placement.place(t, 6), placement.place(t, 6, small=0)
    assert one.cells == two.cells
    c = placement.check(t, one)
    assert c["valid"] and c["relative_error"] < 1e-10


def test_sensing_recovers(spark):
    g = np.random.default_rng(6)
    a = g.standard_normal((100, 10))
    x = np.zeros(10)
    x[[1, 4]] = 2.0, -3.0
    t = spark.createDataFrame([(i, list(map(float, r))) for i, r in enumerate(a)], "cell long, tube array<double>")
    y = spark.createDataFrame([(k, i, float(v)) for k in (0, 1) for i, v in enumerate(a @ x * (k + 1))], "t int, cell long, v double")
    s = spark.createDataFrame([(int(c),) for c in range(0, 100, 4)], "cell long")
    out = sensing.sense(t, s, y, ["t"], 10, K.Sensing(epsilon=1e-3))
    got = {r["t"]: np.array(r["x"]) for r in out.collect()}
    assert np.abs(got[0] - x).max() < 1e-2 and np.abs(got[1] - 2 * x).max() < 1e-2
    assert all(r["error"] < 1e-2 for r in sensing.observed_error(t, s, y, out, ["t"]).collect())
    f = sensing.fields(t, out.filter("t = 0"), ["t"], 1e-4, 3).toPandas().sort_values("cell")["v"].to_numpy()
    assert np.abs(f - a @ x).max() < 0.05
    with pytest.raises(ValueError):
        sensing.sense(t, s.filter("cell < 0"), y, ["t"], 10)
    lap = graph.laplacian(graph.grid_edges(spark, [10, 10]), graph.grid_vertices(spark, [10, 10]), True)
    assert sensing.sense(t, s, y, ["t"], 10, matrix=lap).count() == 2
    best = experiments.grid_search(sensing.right_sides(t, y, ["t"]), a.T @ a, ["t"], [1e-3, 1e-2], [0.9])
    assert best.count() == 4


def test_sensing_queries_take_all_months(spark, monkeypatch):
    sf, seen = "/root/testdata/sf0.001", []
    months = {r["t"] for r in queries._full(spark, sf).select("t").distinct().collect()}
    assert len(months) == 84 and {r["t"] for r in queries.cs_solve(spark, sf).select("t").collect()} == months
    monkeypatch.setattr(experiments, "sweep", lambda basis, truth, *_, **__: seen.append(truth) or truth)
    monkeypatch.setattr(experiments, "analytics", lambda x: x)
    queries.experiment_sweep(spark, sf)
    assert {r["t"] for r in seen[0].select("t").distinct().collect()} == months


def test_sweep(spark):
    a = np.random.default_rng(7).standard_normal((25, 4))
    t = spark.createDataFrame([(i, list(map(float, r))) for i, r in enumerate(a)], "cell long, tube array<double>")
    y = spark.createDataFrame([(k, i, float(v)) for k in range(3) for i, v in enumerate(a @ np.array([1.0, k, 0, 2]))], "t int, cell long, v double")
    out = experiments.sweep(t, y, ["t"], 4, [2, 4], shape=(5, 5)).toPandas()
    assert list(out["sensors"]) == [2, 4] and out["error_mean"].iloc[1] < out["error_mean"].iloc[0]
    noisy = experiments.add_noise(y, ["t"], 0.1, seed=1).join(y.withColumnRenamed("v", "u"), ["t", "cell"])
    assert noisy.filter("v <> u").count() > 0 and experiments.add_noise(y, ["t"], 0) is y


def test_wells(spark, tmp_path):
    (tmp_path / "w.json").write_text('{"a": [[1, 1], [2, 2], [1, 1], [9, 9]], "b": [[0, 3], [5]]}')
    w = readers.read_wells(spark, str(tmp_path / "w.json"))
    got = {(r["subject"], r["row"], r["col"]) for r in analysis.wells(w, 5, 5).collect()}
    assert got == {("a", 1, 1), ("a", 2, 2), ("b", 0, 3)}
    assert analysis.first_wells(w, 1, 5, 5).count() == 2 and analysis.first_wells(w, 1, 5, 5, pooled=True).count() == 1
    assert analysis.swap(w).filter("subject = 'b'").first()["row"] == 3


def test_within_metrics(spark):
    s = spark.createDataFrame([(5, 5), (7, 6)], "row int, col int")
    w = spark.createDataFrame([(0, 6, 7), (1, 50, 50)], "well_idx long, row int, col int")
    n = {m: analysis.within(s, w, 2, m).count() for m in ("l1", "l2", "linf")}
    assert n == {"l1": 1 + 1 - 1, "l2": 1, "linf": 2}
    with pytest.raises(ValueError):
        S.distance(["row"], ["col"], "other")
    with pytest.raises(ValueError):
        analysis.rank_by_proximity(s, w, 60, 60, normalize="other")


def test_readers(spark, tmp_path):
    np.save(tmp_path / "x.npy", X)
    np.savez(tmp_path / "z.npz", a=X, b=X[:2])
    assert np.allclose(back(readers.load_tensor(spark, str(tmp_path / "x.npy")), X.shape), X)
    assert readers.load_tensor(spark, str(tmp_path / "z.npz"), "b").count() == X[:2].size
    assert list(readers.metadata(spark, str(tmp_path / "z.npz")).first()["keys"]) == ["a", "b"]
    with pytest.raises(ValueError):
        readers.kind_of("x.foo")
    (tmp_path / "csv").mkdir()
    for k in range(3):
        pd.DataFrame(np.hstack([np.zeros((10, 4)), np.full((10, 5), float(k))])).to_csv(tmp_path / "csv" / f"tensor_step_{k}.csv", index=False)
    t = readers.read_static(spark, str(tmp_path / "csv"))
    assert t.groupBy("subject").count().count() == 3 and t.filter("step = 2").agg(F.avg("v")).first()[0] == 2.0
    four = readers.read_dynamic(spark, str(tmp_path / "csv"), {"i0": 5, "i1": 2, "i2": 5, "t": 1}, 5)
    assert four.select("subject").distinct().count() == 15
    assert readers.load_slice(readers.load_tensor(spark, str(tmp_path / "x.npy")), t=(1, 3)).count() == 96


def test_exports(spark, tmp_path):
    f = spark.createDataFrame([(r, c, float(r * 3 + c)) for r in range(2) for c in range(3)], "row int, col int, v double")
    sinks.save_ijk(f, f, str(tmp_path / "out"), (2, 3))
    t = spark.read.option("header", True).csv(str(tmp_path / "out" / "original")).collect()
    assert (t[0]["I"], t[0]["J"], t[0]["Value"]) == ("1", "1", "0.000000") and len(t) == 6
    with pytest.raises(ValueError):
        sinks.save_ijk(f, f, str(tmp_path / "no"), (3, 3))
    sinks.append_report(f, str(tmp_path / "rep"))
    sinks.append_report(f, str(tmp_path / "rep"))
    assert spark.read.option("header", True).csv(str(tmp_path / "rep")).count() == 12


def test_generators(spark):
    assert generators.field_samples(spark, 2, 1, 16).count() == 32
    x = generators.gaussian_field(np.random.default_rng(0), 2, 16)
    assert x.shape == (16, 16) and abs(x.mean()) < 1e-10
    w = generators.navier_stokes_samples(spark, 1, 8, 3, 0.06, 1e-2)
    assert w.count() == 8 * 8 * 3 and w.filter("isnan(v)").count() == 0
    u = generators.cosine_factor(spark, 6, 6).toPandas().pivot(index="row", columns="rank", values="u").to_numpy()
    assert np.allclose(u.T @ u, np.eye(6))


def test_streamed_reconstruction(spark, tmp_path):
    a = np.random.default_rng(8).standard_normal((20, 4))
    t = spark.createDataFrame([(i, list(map(float, r))) for i, r in enumerate(a)], "cell long, tube array<double>")
    y = spark.createDataFrame([(k, i, float(v)) for k in range(2) for i, v in enumerate(a[:, k])], "t int, cell long, v double")
    y.write.parquet(str(tmp_path / "in"))
    got = []
    stream = spark.readStream.schema(y.schema).parquet(str(tmp_path / "in"))
    q = online.reconstruct(stream, t, t.select("cell"), a.T @ a, ["t"], lambda s, n: got.extend(s.collect()), K.Sensing(epsilon=1e-3))
    q.processAllAvailable()
    q.stop()
    assert {r["t"]: int(np.argmax(np.abs(r["x"]))) for r in got} == {0: 0, 1: 1}


def test_scalars(spark):
    f = spark.createDataFrame([("PRESSURE_STEP_12.png",), ("plain",)], "n string")
    assert [r[0] for r in f.select(S.step_number("n")).collect()] == [12, 0]
    d = spark.createDataFrame([(0.0, 0.0, 1.0), (0.5, 0.0, 1.0), (3.0, 3.0, 3.0)], "v double, lo double, hi double")
    assert [r[0] for r in d.select(S.display_range("v", "lo", "hi")).collect()] == [0.0, 0.5, 0.0]
    assert [r[0] for r in d.select(S.soft_threshold("v", 1.0)).collect()] == [0.0, 0.0, 2.0]
