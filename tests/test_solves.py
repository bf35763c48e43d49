"""Solves that go on, their rounds as rows, and streams of right-hand sides."""

from dataclasses import replace

import numpy as np
import pytest

from fieldspark.functions import kernels as K
from fieldspark.operators import sensing
from fieldspark.streaming import online

SIDES = "k string, aty array<double>, yty double, level double"


@pytest.fixture(scope="module")
def problem():
    r = np.random.default_rng(5)
    a = r.standard_normal((40, 6))
    return a.T @ a, {k: (a.T @ (a @ x)).tolist() for k, x in zip("uvw", r.standard_normal((3, 6)))}


def sides(spark, b):
    return spark.createDataFrame([(k, x, 1.0, 1.0) for k, x in b.items()], SIDES)


def test_two_solves_are_one(spark, problem):
    g, b = problem
    cfg = K.Sensing(delta=0.3, tol=0.0, max_iter=10)
    whole = {r["k"]: r for r in sensing.solve(sides(spark, b), g, ["k"], cfg).collect()}
    first = sensing.solve(sides(spark, {k: b[k] for k in "uv"}), g, ["k"], replace(cfg, max_iter=4), keep=True)
    rest = {r["k"]: r for r in sensing.solve(sides(spark, b), g, ["k"], replace(cfg, max_iter=6), before=first).collect()}
    for k in "uv":
        assert rest[k]["x"] == whole[k]["x"] and rest[k]["history"] == whole[k]["history"]
    fresh = K.admm(g, np.array(b["w"]), 1.0, replace(cfg, max_iter=6))
    assert rest["w"]["x"] == fresh.x.tolist()  # a key without a state begins anew


def test_trace_and_a_bad_subject(spark, problem):
    g, b = problem
    cfg = K.Sensing(delta=0.3, max_iter=50)
    rows = sensing.trace(sides(spark, {**b, "short": [1.0], "nan": [float("nan")] * 6, "none": None}), g, ["k"], cfg).collect()
    assert {r["k"] for r in rows if r["failure"]} == {"short", "nan", "none"} and sum(bool(r["failure"]) for r in rows) == 3
    for k in b:
        seen: list = []
        found = K.admm(g, np.array(b[k]), 1.0, cfg, hook=lambda *x: seen.append(x))
        own = sorted((r for r in rows if r["k"] == k), key=lambda r: r["iteration"])
        assert len(own) == found.iterations and [(r["iteration"], r["primal"], r["dual"], r["objective"], r["delta"]) for r in own] == seen


def test_stream_of_right_hand_sides(spark, problem, tmp_path):
    g, b = problem
    cfg = K.Sensing(delta=0.3, tol=1e-8, max_iter=300)
    schema = "key string, step long, aty array<double>, yty double, reset boolean"
    steps = [("u", 1, b["u"], 1.0, False), ("v", 1, b["v"], 1.0, False)], [("u", 3, b["u"], 1.0, True), ("u", 2, (np.array(b["u"]) * 1.001).tolist(), 1.0, False)]
    out = []
    for n, rows in enumerate(steps):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = online.tracked(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "key", g, cfg)
        q = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start(str(tmp_path / "out"))
        assert q.awaitTermination(120)
        out = {(r["key"], r["step"]): r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
        assert len(out) == (2, 4)[n]
    cold = K.admm(g, np.array(b["u"]), 1.0, cfg)
    assert out["u", 1]["x"] == cold.x.tolist() == out["u", 3]["x"] and out["u", 3]["iterations"] == cold.iterations
    assert out["u", 2]["iterations"] < cold.iterations
