"""Sensor placement by pivoted QR over tubes.

R equals A Q throughout, so only Q (as wide as a tube) changes: each step one pass over the
tubes finds the best remaining cell, and the driver turns its tube into a reflection. A
pass returns one row a batch. Small bases, checked by their size, are placed in one go.
Scores that agree to ``PLACES`` decimals are ties: the smallest cell of them is the pivot.
"""

from __future__ import annotations

import warnings
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldspark.functions import scalars as S
from fieldspark.operators import sensing

#: Up to so many numbers a basis is placed on the driver.
SMALL = 2_000_000
LEAST = 1e-6
#: Decimals by which scores are compared; what scales a term is the largest score itself.
PLACES = 9
WEIGHTS = ("gradient", "amplitude", "energy")


@dataclass
class Options:
    """Penalties and weights of a placement."""

    uniform: bool = False
    shape: list[int] | None = None
    slice_weight: float = 0.8
    density_weight: float = 0.5
    geometry: bool = False
    gradient: float = 0.5
    amplitude: float = 1.0
    energy: float = 0.5
    proximity: float = 1.0
    min_distance: float = 2.0


@dataclass
class Placement:
    cells: list[int]
    scores: list[float]
    q: np.ndarray
    orthogonality: list[float] = field(default_factory=list)


def validate_count(n: int, k: int | None = None) -> int:
    """A warning where a tube is too short for n sensors: only k can be placed."""
    if n < 1 or int(n) != n:
        raise ValueError("at least one sensor is needed")
    if k is not None and n > k:
        warnings.warn(f"{n} sensors asked for, but tubes have {k} entries, so only {k} can be placed", stacklevel=3)
    return int(n)


def reflection(tube: np.ndarray) -> np.ndarray:
    """The unit vector whose reflection turns a tube into its first axis; zero for a vanishing tube."""
    size = np.linalg.norm(tube)
    if size < LEAST:
        return np.zeros_like(tube)
    sign = 1.0 if abs(tube[0]) < LEAST else float(np.sign(tube[0]))
    u = tube.copy()
    u[0] += sign * size
    return u / np.sqrt(2 * size * (size + abs(tube[0])))


def _scores(r: np.ndarray, d: int, opt: Options) -> np.ndarray:
    return np.abs(r[:, d:]).sum(axis=1) if opt.geometry else np.sqrt((r[:, d:] ** 2).sum(axis=1))


def _rounded(score):
    return np.round(score, PLACES)


def _penalty(cells: np.ndarray, chosen: list[int], shape: list[int], most: float, opt: Options) -> np.ndarray:
    """Penalties of crowded slices and dense axes."""
    out = np.zeros(len(cells))
    if not chosen:
        return out
    mine, theirs = np.unravel_index(cells, shape), np.unravel_index(np.array(chosen), shape)
    for axis, size in enumerate(shape):
        counts = (mine[axis][:, None] == theirs[axis]).sum(axis=1)  # of the few chosen, not of the axis
        if axis == 2:  # slices of the third axis, against an even share of the sensors placed so far
            out += np.maximum(0, counts - len(chosen) / size) * opt.slice_weight * most
        out += counts / len(chosen) * opt.density_weight * most
    return out


def _terms(cells: np.ndarray, chosen: list[int], weights: dict[str, np.ndarray], dmin: np.ndarray | None, opt: Options) -> list[np.ndarray]:
    """What is added to the scores, term by term. Each is scaled by the largest score so far, so the scales build on one another."""
    out = [-_penalty(cells, chosen, opt.shape, 1.0, opt)] if opt.uniform and chosen else []
    if opt.geometry:
        out += [getattr(opt, name) * weights[name] for name in WEIGHTS if name in weights and getattr(opt, name)]
        if dmin is not None and opt.proximity:
            out.append(-opt.proximity * np.exp(-dmin / (opt.min_distance + 1e-10)))
    return out


def _slice(cells: np.ndarray, opt: Options) -> np.ndarray:
    """The index on the third axis, which blocking keeps to; 0 without one."""
    return np.unravel_index(cells, opt.shape)[2] if opt.shape and len(opt.shape) > 2 else np.zeros(len(cells), int)


def place_array(a: np.ndarray, n: int, cells: np.ndarray | None = None, blocked=(), opt: Options = Options(), weights: dict[str, np.ndarray] | None = None, coords: np.ndarray | None = None, similar: np.ndarray | None = None) -> Placement:
    """Pivots of a dense basis (cells, k). ``similar`` gives each cell a region; after a pivot the first cells of
    its region and slice are taken out, a quarter of them."""
    a = np.asarray(a, float)
    if not np.isfinite(a).all():
        raise ValueError("the basis holds values that are not finite")
    k = a.shape[1]
    n = validate_count(n, k)
    if opt.uniform and not opt.shape:
        opt = replace(opt, shape=[len(a)])
    cells = np.arange(len(a)) if cells is None else cells
    free = ~np.isin(cells, np.asarray(list(blocked), np.int64))
    if not free.any():
        raise ValueError("every cell is rejected")
    q, out = np.eye(k), Placement([], [], np.eye(k))
    dmin, slices = np.full(len(a), np.inf), _slice(cells, opt)
    for d in range(min(n, k)):
        if not free.any():
            break
        r, at = a @ q, np.flatnonzero(free)
        score = _scores(r[at], d, opt)
        near = dmin[at] if coords is not None and out.cells else None
        for term in _terms(cells[at], out.cells, {m: w[at] for m, w in (weights or {}).items()}, near, opt):
            score = score + score.max() * term
        tied = np.flatnonzero(_rounded(score) == _rounded(score.max()))
        first = tied[np.argmin(cells[at[tied]])]
        best = at[first]
        tube = r[best, d:]
        if np.linalg.norm(tube) < LEAST:
            break
        out.cells.append(int(cells[best]))
        out.scores.append(float(score[first]))
        free[best] = False
        if similar is not None:
            group = np.flatnonzero((similar == similar[best]) & (slices == slices[best]))
            free[group[group != best][: max(1, len(group) // 4)]] = False
        if coords is not None:
            dmin = np.minimum(dmin, np.linalg.norm(coords - coords[best], axis=1))
        q = _reflected(q, d, tube, out)
    if not out.cells:
        raise RuntimeError("no sensor could be placed")
    out.q = q
    return out


def _reflected(q: np.ndarray, d: int, tube: np.ndarray, out: Placement) -> np.ndarray:
    u = reflection(tube)
    q = q.copy()
    q[:, d:] -= 2 * np.outer(q[:, d:] @ u, u)
    out.orthogonality.append(float(np.abs(q.T @ q - np.eye(len(q))).max()))
    return q


def regions(tubes: DataFrame, shape: list[int], decimals: int = 3) -> DataFrame:
    """The rows with ``region``: columns (first two axes) are alike whose first tube entries, rounded and in order along
    the other axes, agree; a region is named by its least column. Fewer than three axes have no regions: each cell is its own."""
    if len(shape) < 3:
        return tubes.withColumn("region", F.col("cell"))
    depth = int(np.prod(shape[2:]))
    column = F.floor(F.col("cell") / F.lit(depth)).cast("long")
    entries = tubes.groupBy(column.alias("_column")).agg(F.array_sort(F.collect_list(F.struct("cell", F.bround(F.col("tube")[0], decimals).alias("v")))).alias("_p"))  # depth entries
    alike = entries.withColumn("_p", F.transform("_p", lambda x: F.struct((x["cell"] % depth).alias("z"), (x["v"] + F.lit(0.0)).alias("v"))))
    names = alike.groupBy("_p").agg(F.min("_column").alias("region"))
    named = alike.join(names, "_p").select("_column", "region")
    return tubes.withColumn("_column", column).join(named, "_column").drop("_column")


def _turns(rows: DataFrame, opt: Options, block: int = 65536) -> DataFrame:
    """The rows with _z, _turn and _size: a cell's place among its region's cells of a slice, and their number. Places are counted
    within blocks of cells and offset by the blocks before, so that a large region is dealt out too."""
    z = S.unravel("cell", opt.shape)[2] if opt.shape and len(opt.shape) > 2 else F.lit(0)
    rows = rows.withColumn("_z", z).withColumn("_block", F.floor(F.col("cell") / block))
    group = ["region", "_z"]
    counts = rows.groupBy(*group, "_block").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*group)
    before = counts.withColumn("_before", F.sum("_n").over(w.orderBy("_block")) - F.col("_n")).withColumn("_size", F.sum("_n").over(w)).drop("_n")
    inside = F.row_number().over(Window.partitionBy(*group, "_block").orderBy("cell"))
    return rows.withColumn("_in", inside).join(before, [*group, "_block"]).withColumn("_turn", F.col("_before") + F.col("_in")).drop("_block", "_before", "_in")


def place(tubes: DataFrame, n: int, blocked=(), opt: Options = Options(), small: int = SMALL) -> Placement:
    """Pivots of rows (cell, tube). With ``opt.geometry`` the rows may hold gradient, amplitude and energy weights and
    ``coord``; a column ``region`` (see ``regions``) blocks alike cells. Beyond ``small`` numbers each step is one
    pass over the rows for each term of the score and one for the pivot; the result is the same."""
    size = tubes.agg(F.count("*"), F.max(F.size("tube"))).first()
    if not size[0]:
        raise ValueError("the basis has no cells")
    n, k = validate_count(n, size[1]), size[1]
    if opt.uniform and not opt.shape:
        raise ValueError("even spreading needs the shape of the grid")
    extra = [c for c in (*WEIGHTS, "coord") if opt.geometry and c in tubes.columns]
    if "region" in tubes.columns:
        extra.append("region")
    rows = tubes.select("cell", "tube", *extra)
    if size[0] * size[1] <= small:
        t = rows.toPandas().sort_values("cell")
        weights = {c: t[c].to_numpy(float) for c in WEIGHTS if c in extra}
        coords = np.stack(t["coord"].to_numpy()).astype(float) if "coord" in extra else None
        return place_array(np.stack(t["tube"].to_numpy()).astype(float), n, t["cell"].to_numpy(), blocked, opt, weights, coords, t["region"].to_numpy() if "region" in extra else None)
    if "region" in extra:
        rows = _turns(rows, opt)
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _place_passes(rows, n, k, blocked, opt)
    finally:
        rows.unpersist()


def _place_passes(rows: DataFrame, n: int, k: int, blocked, opt: Options) -> Placement:
    q, out = np.eye(k), Placement([], [], np.eye(k))
    gone, spots, rules = set(blocked), [], []
    carried = [c for c in ("coord", "region", "_z", "_turn", "_size") if c in rows.columns]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(["cell long", "score double", "rounded double", "most double", "terms int", "tube array<double>", *[f"{c} {kinds[c]}" for c in carried]])

    def top(d: int, scales: list[float]):
        """The best row by the score with as many terms as there are scales, and the largest score."""
        now, taken, chosen, near_to = q.copy(), np.array(sorted(gone), np.int64), list(out.cells), np.array(spots, float)
        limits = list(rules)

        def best(batches):
            for t in batches:
                keep = ~np.isin(t["cell"].to_numpy(), taken)
                for region, z, upto in limits:
                    keep &= ~((t["region"].to_numpy() == region) & (t["_z"].to_numpy() == z) & (t["_turn"].to_numpy() <= upto))
                t = t[keep].sort_values("cell")
                if not len(t):
                    continue
                r = np.stack(t["tube"].to_numpy()).astype(float) @ now
                dmin = None
                if "coord" in t.columns and len(near_to):
                    at = np.stack(t["coord"].to_numpy()).astype(float)
                    dmin = np.min([np.linalg.norm(at - s, axis=1) for s in near_to], axis=0)
                terms = _terms(t["cell"].to_numpy(), chosen, {c: t[c].to_numpy(float) for c in WEIGHTS if c in t.columns}, dmin, opt)
                score = _scores(r, d, opt)
                for scale, term in zip(scales, terms):
                    score = score + scale * term
                i = int(np.argmax(_rounded(score)))  # rows are in order: the smallest cell
                one = {"cell": [t["cell"].iloc[i]], "score": [score[i]], "rounded": [_rounded(score[i])], "most": [score.max()], "terms": [len(terms)], "tube": [r[i, d:].tolist()]}
                yield pd.DataFrame({**one, **{c: [t[c].iloc[i]] for c in carried}})

        found = rows.mapInPandas(best, schema)
        pivot = F.max_by(F.struct(*[c for c in found.columns if c != "most"]), F.struct("rounded", -F.col("cell")))
        return found.agg(pivot.alias("pivot"), F.max("most").alias("most")).first()

    for d in range(min(n, k)):
        scales: list[float] = []
        pivot, most = top(d, scales)
        while pivot is not None and len(scales) < pivot["terms"]:
            scales.append(most)
            pivot, most = top(d, scales)
        if pivot is None or np.linalg.norm(pivot["tube"]) < LEAST:
            break
        out.cells.append(pivot["cell"])
        out.scores.append(pivot["score"])
        gone.add(pivot["cell"])
        if "coord" in carried:
            spots.append(pivot["coord"])
        if "region" in carried:
            quota = max(1, pivot["_size"] // 4)
            rules.append((pivot["region"], pivot["_z"], quota + (pivot["_turn"] <= quota)))
        q = _reflected(q, d, np.array(pivot["tube"]), out)
    if not out.cells:
        raise RuntimeError("no sensor could be placed")
    out.q = q
    return out


def coordinates(vertices: DataFrame, placed: Placement) -> DataFrame:
    """cell, coord of the placed sensors; there are at most as many as a tube has entries."""
    return vertices.filter(F.col("cell").isin(placed.cells)).select("cell", "coord")


def condition(tubes: DataFrame) -> float:
    """Largest over smallest singular value of the basis, from its Gram matrix (tube length squared); infinite without full rank."""
    width = tubes.agg(F.max(F.size("tube"))).first()[0]
    w = np.linalg.eigvalsh(sensing.gram(tubes, width))
    return float(np.sqrt(w[-1] / w[0])) if w[0] > w[-1] * 1e-15 else float("inf")


def info(tubes: DataFrame, placed: Placement, requested: int, opt: Options = Options()) -> dict:
    """The settings and figures of a placement."""
    history = placed.orthogonality
    return {
        "cells": tubes.count(), "shape": opt.shape, "tube": len(placed.q), "requested": requested, "actual": len(placed.cells), "uniform": opt.uniform,
        "geometry": opt.geometry, "config": asdict(opt), "orthogonality_history": history, "max_orthogonality_deviation": max(history, default=0.0), "condition": condition(tubes),
    }


def project(tubes: DataFrame, q: np.ndarray) -> DataFrame:
    """R = A Q of every cell."""

    def run(batches):
        for t in batches:
            r = np.stack(t["tube"].to_numpy()).astype(float) @ q if len(t) else np.zeros((0, len(q)))
            yield pd.DataFrame({"cell": t["cell"], "tube": list(map(list, r))})

    return tubes.select("cell", "tube").mapInPandas(run, "cell long, tube array<double>")


def check(tubes: DataFrame, placed: Placement, tol: float = 1e-6) -> dict:
    """Whether R Q' gives the basis back and Q is orthogonal, with the figures."""
    q = placed.q
    back = project(project(tubes, q), q.T).withColumnRenamed("tube", "back")
    both = tubes.join(back, "cell").select(F.explode(F.arrays_zip("tube", "back")).alias("x"))
    e = both.agg(F.sqrt(F.sum((F.col("x.tube") - F.col("x.back")) ** 2)).alias("d"), F.sqrt(F.sum(F.col("x.tube") ** 2)).alias("n")).first()
    error, ortho = (e["d"] or 0.0) / max(e["n"] or 0.0, 1e-300), float(np.abs(q.T @ q - np.eye(len(q))).max())
    return {"valid": error < tol and ortho < tol, "relative_error": error, "orthogonality": ortho, "sensors": len(placed.cells), "orthogonality_history": placed.orthogonality}
