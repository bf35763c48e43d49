"""Placement with blocked regions, sweeps of one frame and of wells, processing, and what readers leave out."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fieldspark.functions import kernels as K
from fieldspark.operators import decomposition, experiments, graph, placement, sensing, stats, tensor
from fieldspark.sources import readers


def rows(spark, a):
    return spark.createDataFrame([(i, list(map(float, r))) for i, r in enumerate(a)], "cell long, tube array<double>")


def test_regions_name_alike_columns(spark):
    a = np.random.default_rng(1).standard_normal((4 * 3 * 2, 5))
    for column in (4, 9):  # columns 1, 4 and 9 begin alike
        a[column * 2 : column * 2 + 2, 0] = a[2:4, 0] + 1e-5
    a[2:4, 0] = np.round(a[2:4, 0], 3)
    for column in (4, 9):
        a[column * 2 : column * 2 + 2, 0] = a[2:4, 0] + 1e-5
    got = {r["cell"]: r["region"] for r in placement.regions(rows(spark, a), [4, 3, 2]).collect()}
    assert {c for c, r in got.items() if r == 1} == {2, 3, 8, 9, 18, 19}
    assert all(got[c] == c // 2 for c in got if got[c] != 1)
    flat = placement.regions(rows(spark, a), [6, 4]).collect()
    assert all(r["region"] == r["cell"] for r in flat)


@pytest.mark.parametrize("uniform", [False, True])
def test_blocking_is_the_same_in_passes(spark, uniform):
    a = np.random.default_rng(2).standard_normal((6 * 4 * 3, 8))
    t = rows(spark, a).withColumn("region", F.floor(F.col("cell") / 3) % 3)
    opt = placement.Options(uniform=uniform, shape=[6, 4, 3])
    one, two = placement.place(t, 8, blocked=[5], opt=opt), placement.place(t, 8, blocked=[5], opt=opt, small=0)
    assert one.cells == two.cells and np.allclose(one.scores, two.scores)
    free = placement.place(t.drop("region"), 8, blocked=[5], opt=opt)
    assert free.cells[0] == one.cells[0]
    # by hand: a quarter of the first pivot's region and slice, in order, isn't placed later
    first = one.cells[0]
    group = [c for c in range(72) if c // 3 % 3 == first // 3 % 3 and c % 3 == first % 3]
    out = [c for c in group if c != first][: max(1, len(group) // 4)]
    assert not set(out) & set(one.cells)


def test_turns_across_blocks(spark):
    t = rows(spark, np.ones((50, 2))).withColumn("region", F.lit(7))
    got = placement._turns(t, placement.Options(shape=[5, 5, 2]), block=8).orderBy("cell").collect()
    assert [r["_turn"] for r in got] == [i // 2 + 1 for i in range(50)] and {r["_size"] for r in got} == {25}


def test_figures_of_a_placement(spark):
    a = np.random.default_rng(3).standard_normal((30, 4))
    t = rows(spark, a)
    with pytest.warns(UserWarning):
        p = placement.place(t, 9)
    i = placement.info(t, p, 9)
    assert i["actual"] == 4 and i["requested"] == 9 and i["condition"] == pytest.approx(np.linalg.cond(a))
    assert placement.condition(rows(spark, np.ones((5, 2)))) == float("inf")
    v = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(30)], "cell long, coord array<double>")
    assert {r["coord"][0] for r in placement.coordinates(v, p).collect()} == set(map(float, p.cells))
    with pytest.raises(ValueError):
        placement.place(t, 2, opt=placement.Options(uniform=True), small=0)


def fields(spark):
    g = np.random.default_rng(4)
    a = g.standard_normal((25, 4))
    y = [(s, k, i, float(v)) for s in ("a", "b") for k in range(2) for i, v in enumerate(a @ (np.array([1.0, k + 1, 0, 2]) * (1 if s == "a" else -1)))]
    return rows(spark, a), spark.createDataFrame(y, "subject string, t int, cell long, v double")


def test_sweep_of_a_frame_and_of_wells(spark):
    tubes, truth = fields(spark)
    cfg = experiments.Config(noise=0.05, samples=3, max_iter=200)
    one = experiments.sweep_slice(tubes, truth, "a", 1, 4, [2, 4], cfg, shape=(5, 5)).toPandas()
    assert list(one.columns[:3]) == ["sensors", "subject", "slice_idx"] and set(one["num_samples"]) == {4}
    assert set(one["subject"]) == {"a"} and set(one["slice_idx"]) == {1}
    with pytest.raises(ValueError):
        experiments.sweep_slice(tubes, truth, "c", 1, 4, [2], cfg)
    wells = spark.createDataFrame([("a", i, i % 5, i // 5) for i in range(12)] + [("b", i, 4 - i % 5, i // 5) for i in range(12)], "subject string, well_idx long, row int, col int")
    both = experiments.sweep(tubes, truth, ["subject", "t"], 4, [3, 8], experiments.Config(), experiments.well_sensors(wells, 5, 5), (5, 5)).toPandas()
    assert set(both["num_samples"]) == {4} and both["error_mean"].iloc[1] < both["error_mean"].iloc[0]
    # each subject by its own wells: the same as one subject alone
    alone = experiments.sweep(tubes, truth.filter("subject = 'b'"), ["subject", "t"], 4, [8], experiments.Config(), experiments.well_sensors(wells, 5, 5, "b"), (5, 5)).first()
    sensors = experiments.well_sensors(wells, 5, 5)(8).filter("subject = 'b'").select("cell")
    plain = experiments.sweep(tubes, truth.filter("subject = 'b'"), ["subject", "t"], 4, [8], experiments.Config(), lambda n: sensors, (5, 5)).first()
    assert alone["error_mean"] == pytest.approx(plain["error_mean"], rel=1e-6)


def test_best_and_places(spark):
    t = spark.createDataFrame([("x", 2.0), ("y", 1.0), ("z", float("nan"))], "basis string, rmse double")
    assert experiments.best(t).first()["basis"] == "y"
    sides = spark.createDataFrame([(0, [3.0, -2.0], 13.0, 1.0, 2)], "t int, aty array<double>, yty double, level double, n int")
    table = experiments.grid_search(sides, np.eye(2), ["t"], [0.5, 0.01], [0.9, 0.95]).toPandas()
    assert sorted(table["place"]) == [1, 2, 3, 4] and table.set_index("place")["epsilon"][1] == 0.01


def test_processing(spark):
    x = np.random.default_rng(5).random((6, 8))
    frame = spark.createDataFrame([("s", 0, i, j, float(x[i, j])) for i in range(6) for j in range(8)], "subject string, t int, i0 int, i1 int, v double")
    small = stats.process(frame, size=(6, 8), to=(3, 4)).toPandas()
    assert np.allclose(decomposition.dense(small, {"i0": 3, "i1": 4}), K.resize(x, (3, 4)))
    for method, params in (("minmax", {"min": -1.0, "max": 3.0}), ("zscore", {"mean": 0.5, "std": 2.0})):
        there = stats.process(frame, method=method, params=params)
        again = stats.restore(there, method, params).toPandas()
        assert np.allclose(decomposition.dense(again, {"i0": 6, "i1": 8}), x)
    own = stats.process(frame, method="minmax").agg(F.min("v"), F.max("v")).first()
    assert tuple(own) == (0.0, 1.0)
    rgb = tensor.gray_to_rgb(frame)
    assert np.allclose(decomposition.dense(stats.process(rgb, gray=True).toPandas(), {"i0": 6, "i1": 8}), x)
    assert stats.given(frame, "zscore", {"mean": 1.0, "std": 0.0}) is frame
    for bad in (lambda: stats.restore(frame, "minmax", {"min": 0.0}), lambda: stats.process(frame, method="other"), lambda: tensor.mode_of({"a": 2}, 3)):
        with pytest.raises(ValueError):
            bad()
    assert tensor.mode_of({"a": 2, "b": 3, "c": 3}, 3) == "b"
    split = stats.split_ordered(frame.withColumn("t", F.col("i0")), 0.5)
    assert {r["part"]: r["frames"] for r in stats.least_frames(split).collect()} == {"train": 3, "test": 3}


def test_what_readers_leave_out(spark, tmp_path):
    (tmp_path / "csv").mkdir()
    pd.DataFrame(np.ones((3, 6))).to_csv(tmp_path / "csv" / "good_1.csv", index=False)
    (tmp_path / "csv" / "bad_2.csv").write_text("a,b,c,d,e\n1,2,3,4,word\n")
    (tmp_path / "csv" / "empty_3.csv").write_text("")
    t = readers.read_static(spark, str(tmp_path / "csv"))
    assert [r["subject"] for r in readers.list_keys(t).collect()] == ["good_1"]
    assert readers.bad_files(spark, str(tmp_path / "csv")).count() == 1  # Spark itself passes over empty files
    with pytest.raises(Exception, match="word|columns"):
        readers.read_static(spark, str(tmp_path / "csv"), skip_bad=False).count()
    text = '{"a": [{"x": 3, "y": 4}, [1, 2], [5], "no"]}'
    (tmp_path / "w.json").write_text(text)
    got = [(r["row"], r["col"]) for r in readers.read_wells(spark, str(tmp_path / "w.json")).collect()]
    assert got == [(3, 4), (1, 2)] and readers.parse_wells(text) == {"a": [[3, 4], [1, 2]]}


def test_length_without_edges_states_and_modes(spark):
    v = spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(4)], "cell long, coord array<double>")
    none = spark.createDataFrame([], "src long, dst long, w double, dist double")
    assert graph.characteristic_length(none, v).first()[0] == pytest.approx(4.5 / 2)
    d = decomposition.Decomposer({"i0": 2, "i1": 2}, [1, 1])
    with pytest.raises(RuntimeError):
        d.reconstruct()
    with pytest.raises(Exception):
        d.decompose(v)
    assert d.state == "error"
    d.reset()
    assert d.state == "initialized"
    core = spark.createDataFrame([("one", 0, 0, 2.0)], "subject string, i0 int, t int, v double")
    factor = spark.createDataFrame([("one", "i0", 0, 0, 0.6), ("one", "i0", 1, 0, 0.8)], "subject string, axis string, row int, rank int, u double")
    got = {r["i0"]: r["v"] for r in decomposition.modes_by_subject(core, factor, ["i0", "t"]).collect()}
    assert got == pytest.approx({0: 1.2, 1: 1.6})
    single = decomposition.modes_by_subject(core.drop("subject"), factor.drop("subject"), ["i0", "t"])
    assert {r["subject"] for r in single.collect()} == {"single_subject"}
    with pytest.raises(ValueError):
        decomposition.modes_by_subject(core.withColumn("subject", F.lit("two")), factor, ["i0", "t"])


def test_tubes_with_gaps(spark):
    c = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0), (0, 2, 3.0), (1, 2, 5.0), (2, 1, None)], "cell long, t int, v double")
    got = {r["cell"]: r["tube"] for r in tensor.tubes(c, ["cell"], 3).collect()}
    assert got == {0: [1.0, 2.0, 3.0], 1: [0.0, 0.0, 5.0], 2: [0.0, 0.0, 0.0]}


def test_subjects_stand_one_after_another(spark):
    c = spark.createDataFrame([("a", 0, 1.0), ("b", 0, 2.0), ("b", 1, 3.0), ("c", 0, 4.0)], "subject string, t int, v double")
    lengths = spark.createDataFrame([("c", 2, 1), ("a", 0, 1), ("b", 1, 2)], "subject string, place long, n long")
    assert [(r["t"], r["v"]) for r in tensor.stack_subjects(c, lengths).orderBy("t").collect()] == [(0, 1.0), (1, 2.0), (2, 3.0), (3, 4.0)]
