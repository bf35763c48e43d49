"""Compressive sensing: fields from sparse measurements.

The basis meets the sensors once, in distributed sums of A'A and A'y; each right-hand side is
then a small problem of its own, solved many to a task.
"""

from __future__ import annotations

from dataclasses import asdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldspark.functions import kernels as K
from fieldspark.functions import scalars as S


def gram(tubes: DataFrame, width: int) -> np.ndarray:
    """A'A of the rows' tubes: a partial matrix a batch, summed entry by entry."""

    def run(batches):
        total = np.zeros((width, width))
        for t in batches:
            if len(t):
                a = np.stack(t["tube"].to_numpy()).astype(float)
                total += a.T @ a
        i, j = np.indices(total.shape)
        yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "g": total.ravel()})

    parts = tubes.select("tube").mapInPandas(run, "i int, j int, g double").groupBy("i", "j").agg(F.sum("g").alias("g")).toPandas()
    out = np.zeros((width, width))
    out[parts["i"], parts["j"]] = parts["g"]
    return out


def laplacian_tubes(matrix: DataFrame, tubes: DataFrame, width: int) -> DataFrame:
    """L A as tubes, from a sparse matrix (src, dst, l)."""
    long = tubes.select(F.col("cell").alias("dst"), F.posexplode("tube").alias("k", "v"))
    out = matrix.join(long, "dst").groupBy(F.col("src").alias("cell"), "k").agg(F.sum(F.col("l") * F.col("v")).alias("v"))
    entries = out.groupBy("cell").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("m"))
    return entries.select("cell", F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0.0))).alias("tube"))


def right_sides(tubes: DataFrame, measured: DataFrame, keys: list[str]) -> DataFrame:
    """keys, aty, yty, level, n of every right-hand side of rows (keys..., cell, v)."""
    long = measured.join(tubes.select("cell", F.posexplode("tube").alias("k", "a")), "cell")
    sums = long.groupBy(*keys, "k").agg(F.sum(F.col("a") * F.col("v")).alias("b"))
    vectors = sums.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "b"))), lambda x: x["b"]).alias("aty"))
    size = measured.groupBy(*keys).agg(F.sum(F.col("v") * F.col("v")).alias("yty"), F.avg(F.abs("v")).alias("level"), F.count("*").alias("n"))
    return vectors.join(size, keys)


SOLUTION = "x array<double>, iterations int, converged boolean, primal double, dual double, objective double, delta double, history array<double>"
#: What a solve needs to go on, beside delta and history.
STATE = "d array<double>, p array<double>"


def solve(sides: DataFrame, gram_matrix: np.ndarray, keys: list[str], cfg: K.Sensing = K.Sensing(), smooth: np.ndarray | None = None, alpha: float = 0.01, auto: bool = True, adaptive: bool = True, most: float = 1.0, before: DataFrame | None = None, keep: bool = False) -> DataFrame:
    """A solution a right-hand side. With ``smooth``, a Laplacian's quadratic form of weight alpha is added:
    alpha scaled to the two matrices (auto) and to the level of the measurements (adaptive). ``before`` are solutions with their state
    (``keep``), from which those of the same keys go on; keys it lacks begin anew, and to leave it out is to reset all."""
    shared = sides.sparkSession.sparkContext.broadcast((gram_matrix, smooth, asdict(cfg)))  # width squared
    base = alpha if smooth is None or not auto else K.auto_alpha(gram_matrix, smooth, alpha, most)
    resumed = before is not None
    keep = keep or resumed
    if resumed:
        sides = sides.join(before.select(*keys, F.struct("d", "p", "delta", "history").alias("_state")), keys, "left")

    def run(batches):
        g, sm, c = shared.value
        c = K.Sensing(**c)
        plain = K.Solver(g, c.solver, c.reg) if sm is None else None
        for t in batches:
            rows = []
            states = t["_state"] if resumed else [None] * len(t)
            for aty, yty, level, at in zip(t["aty"], t["yty"], t["level"], states):
                extra = None if sm is None else (K.adaptive_alpha(base, level, most) if adaptive else base) * sm
                r = K.admm(g, np.asarray(aty, float), float(yty), c, extra, plain, state=_state(at))
                rows.append((r.x.tolist(), r.iterations, r.converged, r.primal, r.dual, r.objective, r.delta, r.history, r.d.tolist(), r.p.tolist())[: 10 if keep else 8])
            out = pd.DataFrame(rows, columns=["x", "iterations", "converged", "primal", "dual", "objective", "delta", "history", "d", "p"][: 10 if keep else 8])
            yield pd.concat([t[keys].reset_index(drop=True), out], axis=1)

    kinds = {f.name: f.dataType.simpleString() for f in sides.schema}
    return sides.mapInPandas(run, ", ".join([*[f"{k} {kinds[k]}" for k in keys], SOLUTION, *[STATE] * keep]))


def _state(at) -> K.State | None:
    if at is None or at["d"] is None:
        return None
    return K.State(np.asarray(at["d"], float), np.asarray(at["p"], float), float(at["delta"]), [float(x) for x in at["history"]])


ROUND = "iteration int, primal double, dual double, objective double, delta double, failure string"


def trace(sides: DataFrame, gram_matrix: np.ndarray, keys: list[str], cfg: K.Sensing = K.Sensing()) -> DataFrame:
    """What each round of each solve reports, a row an iteration and key, as it is made: a batch of rounds is all that a task holds. A right-hand
    side that can't be solved (of another length, or not of numbers) gives one row with its ``failure`` and leaves the others alone."""
    shared = sides.sparkSession.sparkContext.broadcast((gram_matrix, asdict(cfg)))
    names = ["iteration", "primal", "dual", "objective", "delta", "failure"]

    def run(batches):
        g, c = shared.value
        c = K.Sensing(**c)
        plain = K.Solver(g, c.solver, c.reg)
        for t in batches:
            for i, (aty, yty) in enumerate(zip(t["aty"], t["yty"])):
                seen: list = []
                try:
                    if aty is None or len(aty) != len(g) or not np.isfinite(np.asarray(aty, float)).all():
                        raise ValueError(f"a right-hand side of {len(g)} numbers is needed")
                    K.admm(g, np.asarray(aty, float), float(yty), c, None, plain, lambda *x: seen.append((*x, None)))  # noqa: B023
                except (ValueError, TypeError, np.linalg.LinAlgError) as e:
                    seen = [(None, None, None, None, None, str(e))]
                out = pd.DataFrame(seen, columns=names).astype({"iteration": "Int32"})
                for k in keys:
                    out[k] = t[k].iloc[i]
                yield out[[*keys, *names]]

    kinds = {f.name: f.dataType.simpleString() for f in sides.schema}
    return sides.mapInPandas(run, ", ".join([*[f"{k} {kinds[k]}" for k in keys], ROUND]))


def sense(tubes: DataFrame, sensors: DataFrame, measured: DataFrame, keys: list[str], width: int, cfg: K.Sensing = K.Sensing(), matrix: DataFrame | None = None, **geometry) -> DataFrame:
    """From basis tubes, sensor cells and measurements to solutions."""
    rows = tubes.join(sensors.select("cell").distinct(), "cell", "left_semi")
    if not rows.limit(1).count():
        raise ValueError("no sensor lies on the basis")
    sides = right_sides(rows, measured.join(sensors.select("cell").distinct(), "cell", "left_semi"), keys)
    smooth = None if matrix is None else gram(laplacian_tubes(matrix, tubes, width), width)
    return solve(sides, gram(rows, width), keys, cfg, smooth, **geometry)


def sense_by(tubes: DataFrame, sensors: DataFrame, measured: DataFrame, keys: list[str], width: int, cfg: K.Sensing, by: str) -> DataFrame:
    """As ``sense``, with sensors (by, cell) of their own for each subject: A'A is summed per subject, width squared numbers each,
    and travels with the right-hand sides."""
    long = tubes.select("cell", "tube").join(sensors.select(by, "cell").distinct(), "cell")

    def grams(batches):
        for t in batches:
            for name, rows in t.groupby(by):
                a = np.stack(rows["tube"].to_numpy()).astype(float)
                yield pd.DataFrame({by: [name], "g": [(a.T @ a).ravel().tolist()]})

    parts = long.mapInPandas(grams, f"{by} string, g array<double>").select(by, F.posexplode("g").alias("k", "g"))
    summed = parts.groupBy(by, "k").agg(F.sum("g").alias("g")).groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "g"))), lambda x: x["g"]).alias("gram"))
    sides = right_sides(tubes, measured.join(sensors.select(by, "cell").distinct(), [by, "cell"], "left_semi"), keys).join(summed, by)
    c = asdict(cfg)

    def run(batches):
        settings = K.Sensing(**c)
        for t in batches:
            rows = [K.admm(np.asarray(g, float).reshape(width, width), np.asarray(b, float), float(y), settings) for g, b, y in zip(t["gram"], t["aty"], t["yty"])]
            names = ["iterations", "converged", "primal", "dual", "objective", "delta", "history"]
            out = pd.DataFrame([(r.x.tolist(), *[getattr(r, n) for n in names]) for r in rows], columns=["x", *names])
            yield pd.concat([t[keys].reset_index(drop=True), out], axis=1)

    kinds = {f.name: f.dataType.simpleString() for f in sides.schema}
    return sides.mapInPandas(run, ", ".join([*[f"{k} {kinds[k]}" for k in keys], SOLUTION]))


def fields(tubes: DataFrame, solutions: DataFrame, keys: list[str], zero: float | None = None, decimals: int | None = None) -> DataFrame:
    """keys, cell, v = A x at every cell. Solutions are one short row a right-hand side; with many, both sides are dealt out."""
    out = tubes.crossJoin(solutions.select(*keys, "x")).select(*keys, "cell", S.dot("tube", "x").alias("v"))
    return out if zero is None else out.withColumn("v", S.zero_suppress("v", zero, decimals))


def observed_error(tubes: DataFrame, sensors: DataFrame, measured: DataFrame, solutions: DataFrame, keys: list[str]) -> DataFrame:
    """|A x - y| / |y| over the sensors."""
    at = tubes.join(sensors.select("cell").distinct(), "cell", "left_semi")
    found = measured.join(at, "cell").join(solutions.select(*keys, "x"), keys)
    d = S.dot("tube", "x") - F.col("v")
    return found.groupBy(*keys).agg((F.sqrt(F.sum(d * d)) / F.sqrt(F.sum(F.col("v") * F.col("v")))).alias("error"))
