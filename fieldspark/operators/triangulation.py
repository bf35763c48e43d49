"""Delaunay triangulations of plane points beyond one task.

The plane is cut into rectangles of about SQUARE x SQUARE tiles of TILE points each, at quantiles of the points, along x and y in turn, in up to four at a time: a
tree. Each leaf is triangulated alone. A triangle whose circumcircle lies in the leaf holds no point of the whole set, so it stands, as does an edge of the
hull with nothing of the others' area beyond. The corners of those that don't stand are few, near the leaf's borders; they are triangulated again, alone, in the
rectangles of STEP levels further up, until the whole plane is one. Of these a triangle of one child's points counts only if the child had found it too
(others fill what stands already); one between children always does. So each triangle stands once, and gives its three edges in one direction each.

What stands has to be the same whatever else a task holds: the signs behind it are exact, and of points on one circle the one of the greatest cell counts as lifted a bit, so
that the triangulation is one. Points of one place count once, as that of the least cell; points without a finite place have none. Points
on a line, or fewer than three, have no triangles: they are joined with their ``NEAR`` nearest. With keys, meshes are triangulated
beside one another, and points of a key without triangles are joined along their line.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldspark.operators import graph
from fieldspark.operators.cut import checkpointed

TILE, NEAR = 256, 6
SQUARE = 8  # tiles along a side of what a task of the first round holds
STEP = 2  # levels of the tree between rounds
FAR = -1  # the point at infinity
EPS = 1e-12
WAYS = [0.25, 0.5, 0.75]

# Bounds on the rounding error of the two determinants (Shewchuk 1997), as parts of the sum of their terms without signs.
TURN, WITHIN, TINY = 3.34e-16, 1.12e-15, 1e-290


def _signs(X: list[float], Y: list[float]):
    """turn(a, b, c): positive if c is left of a -> b; within(a, b, c, d): whether d is in the circle of a, b, c, which run
    counter-clockwise. Points by number; where floats can't tell, in integers. Of four on a circle the last is lifted."""
    whole = []

    def exact():
        if not whole:
            parts = [(x.as_integer_ratio(), y.as_integer_ratio()) for x, y in zip(X, Y)]
            unit = max(max(x[1], y[1]) for x, y in parts)  # powers of two
            whole.append([(x[0] * (unit // x[1]), y[0] * (unit // y[1])) for x, y in parts])
        return whole[0]

    def turn(a, b, c):
        left, right = (X[a] - X[c]) * (Y[b] - Y[c]), (Y[a] - Y[c]) * (X[b] - X[c])
        d, e = left - right, TURN * (abs(left) + abs(right)) + TINY
        if d > e or d < -e:
            return d
        q = exact()
        (ax, ay), (bx, by), (cx, cy) = q[a], q[b], q[c]
        return (ax - cx) * (by - cy) - (ay - cy) * (bx - cx)

    def within(a, b, c, d):
        px, py = X[d], Y[d]
        ax, ay, bx, by, cx, cy = X[a] - px, Y[a] - py, X[b] - px, Y[b] - py, X[c] - px, Y[c] - py
        al, bl, cl = ax * ax + ay * ay, bx * bx + by * by, cx * cx + cy * cy
        s = al * (bx * cy - cx * by) + bl * (cx * ay - ax * cy) + cl * (ax * by - bx * ay)
        e = WITHIN * (al * (abs(bx * cy) + abs(cx * by)) + bl * (abs(cx * ay) + abs(ax * cy)) + cl * (abs(ax * by) + abs(bx * ay))) + TINY
        if s > e or s < -e:
            return s > 0
        q = exact()
        (px, py), (ax, ay), (bx, by), (cx, cy) = q[d], q[a], q[b], q[c]
        ax, ay, bx, by, cx, cy = ax - px, ay - py, bx - px, by - py, cx - px, cy - py
        s = (ax * ax + ay * ay) * (bx * cy - cx * by) + (bx * bx + by * by) * (cx * ay - ax * cy) + (cx * cx + cy * cy) * (ax * by - bx * ay)
        if s:
            return s > 0
        last = max(a, b, c, d)
        if last == d:
            return False
        return (turn(d, b, c) if last == a else turn(a, d, c) if last == b else turn(a, b, d)) > 0

    return turn, within


def _order(p: np.ndarray) -> list[int]:
    """Numbers of the points as they are inserted: shuffled halves, each twice the one before, to and fro along rows within each."""
    n = len(p)
    rank = np.random.default_rng(0).permutation(n)
    out, last = [], n
    while last > 0:
        first = last // 2 if last > 32 else 0
        some = np.flatnonzero((rank >= first) & (rank < last))
        row = np.empty(len(some), np.int64)
        row[np.argsort(p[some, 1], kind="stable")] = np.arange(len(some)) // max(1, math.isqrt(len(some)))
        out.append(some[np.lexsort((np.where(row % 2, -p[some, 0], p[some, 0]), row))])
        last = first
    return np.concatenate(out[::-1]).tolist() if out else []


def triangles(p: np.ndarray) -> np.ndarray:
    """Triangles of points in the plane, counter-clockwise, by inserting one point after another; rows (a, b, FAR) are the hull's edges,
    with what is outside on their left. None if all points lie on a line."""
    empty = np.zeros((0, 3), np.int64)
    if len(p) < 3:
        return empty
    by_place = np.lexsort((p[:, 1], p[:, 0]))
    again = by_place[1:][(p[by_place[1:]] == p[by_place[:-1]]).all(axis=1)]
    if len(again):  # of one place the first counts
        once = np.delete(np.arange(len(p)), again)
        t = triangles(p[once])
        return np.where(t == FAR, FAR, once[t])
    X, Y = p[:, 0].tolist(), p[:, 1].tolist()
    turn, within = _signs(X, Y)
    order = _order(p)
    a, b = order[:2]
    c = next((i for i in order if turn(a, b, i) != 0), None)
    if c is None:
        return empty
    if turn(a, b, c) < 0:
        a, b = b, a
    V = [a, b, c, b, a, FAR, c, b, FAR, a, c, FAR]  # corners, FAR the third
    N = [2, 3, 1, 3, 2, 0, 1, 3, 0, 2, 1, 0]  # triangle opposite to each
    seen = [-1] * 4
    wide = float(np.ptp(p, axis=0).max())
    sure_turn, sure_within = 2 * wide * wide * TURN + TINY, 12 * wide * wide * wide * wide * WITHIN + TINY  # beyond these floats can tell for any of the points
    at = 0
    for i in order:
        if i == a or i == b or i == c:
            continue
        px, py = X[i], Y[i]
        t = at
        while True:  # to the triangle that holds the point, or beyond the hull's edge it is outside of
            j = 3 * t
            u, v, w = V[j], V[j + 1], V[j + 2]
            if w < 0:
                break
            ux, uy, vx, vy, wx, wy = X[u] - px, Y[u] - py, X[v] - px, Y[v] - py, X[w] - px, Y[w] - py
            s = ux * vy - uy * vx
            if s < -sure_turn or s <= sure_turn and turn(u, v, i) < 0:
                t = N[j + 2]
                continue
            s = vx * wy - vy * wx
            if s < -sure_turn or s <= sure_turn and turn(v, w, i) < 0:
                t = N[j]
                continue
            s = wx * uy - wy * ux
            if s < -sure_turn or s <= sure_turn and turn(w, u, i) < 0:
                t = N[j + 1]
                continue
            break
        seen[t] = i
        out, border = [t], []
        for t in out:
            j = 3 * t
            for k, o in enumerate((N[j], N[j + 1], N[j + 2])):
                if seen[o] == i:
                    continue
                m = 3 * o
                u, v, w = V[m], V[m + 1], V[m + 2]
                if w < 0:
                    s = turn(u, v, i)
                    hit = s > 0 or s == 0 and min(X[u], X[v]) <= px <= max(X[u], X[v]) and min(Y[u], Y[v]) <= py <= max(Y[u], Y[v])
                else:
                    ux, uy, vx, vy, wx, wy = X[u] - px, Y[u] - py, X[v] - px, Y[v] - py, X[w] - px, Y[w] - py
                    s = (ux * ux + uy * uy) * (vx * wy - wx * vy) + (vx * vx + vy * vy) * (wx * uy - ux * wy) + (wx * wx + wy * wy) * (ux * vy - vx * uy)
                    hit = s > sure_within or not s < -sure_within and within(u, v, w, i)
                if hit:
                    seen[o] = i
                    out.append(o)
                else:
                    border.append((V[j + (k + 1) % 3], V[j + (k + 2) % 3], o, m if N[m] == t else m + 1 if N[m + 1] == t else m + 2))
        more = len(border) - len(out)
        out += range(len(seen), len(seen) + more)
        seen += [-1] * more
        V += [FAR] * (3 * more)
        N += [FAR] * (3 * more)
        starts, ends = {}, {}
        for t, (u, v, _, _) in zip(out, border):
            starts[u] = ends[v] = t
        for t, (u, v, o, back) in zip(out, border):
            N[back] = t
            j, s, e = 3 * t, starts[v], ends[u]
            if u < 0:
                V[j], V[j + 1], V[j + 2], N[j], N[j + 1], N[j + 2] = v, i, FAR, e, o, s
            elif v < 0:
                V[j], V[j + 1], V[j + 2], N[j], N[j + 1], N[j + 2] = i, u, FAR, o, s, e
            else:
                V[j], V[j + 1], V[j + 2], N[j], N[j + 1], N[j + 2] = u, v, i, s, e, o
                at = t
    return np.array(V, np.int64).reshape(-1, 3)


Region = tuple[float, float, float, float]  # left, right, bottom, top
PLANE: Region = (-math.inf, math.inf, -math.inf, math.inf)


def _settled(p: np.ndarray, t: np.ndarray, region: Region, box: Region) -> np.ndarray:
    """Which rows of ``triangles`` hold no point of ``box``, the extent of the whole set, outside ``region`` in their circle or half-plane."""
    if region == PLANE:
        return np.ones(len(t), bool)
    a, b, c = (p[t[:, k]] for k in range(3))
    ghost = t[:, 2] == FAR
    u, v = b - a, np.where(ghost[:, None], a, c) - a
    left, right, bottom, top = region[0] - a[:, 0], region[1] - a[:, 0], region[2] - a[:, 1], region[3] - a[:, 1]
    size = np.maximum(np.abs(u).max(axis=1), np.abs(v).max(axis=1))
    u, v = u / size[:, None], v / size[:, None]
    with np.errstate(all="ignore"):
        d = 2 * (u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0])
        uu, vv = (u * u).sum(axis=1), (v * v).sum(axis=1)
        x, y = (v[:, 1] * uu - u[:, 1] * vv) / d, (u[:, 0] * vv - v[:, 0] * uu) / d
        lost = 1e-14 * (np.sqrt(vv) * uu + np.sqrt(uu) * vv) / np.abs(d) * (1 + 1 / np.abs(d))  # what rounding can have moved the centre by
        x, y, r = x * size, y * size, (np.sqrt(x * x + y * y) * (1 + 1e-9) + 2 * lost) * size
        inside = (x - r > left) & (x + r < right) & (y - r > bottom) & (y + r < top) & np.isfinite(r)
        beyond = np.zeros(len(t), bool)
        for k, end in enumerate(region):  # the four parts of the box around the region
            if math.isfinite(end):
                part = list(box)
                part[k ^ 1] = end
                for px in part[:2]:
                    for py in part[2:]:
                        up, down = u[:, 0] * (py - a[:, 1]), u[:, 1] * (px - a[:, 0])
                        beyond |= ~(up - down < -1e-9 * (np.abs(up) + np.abs(down)))
    return np.where(ghost, ~beyond, inside)


ROUND = "kind int, k int, path string, a long, b long, c long, x double, y double"
EDGE, POINT, FACE, HULL = 0, 1, 2, 3  # x of an edge is its length; HULL is a FACE whose third corner is FAR


def _cut(points: DataFrame, leaf: int) -> tuple[DataFrame, dict[tuple[int, str], Region]]:
    """The points with the path to their leaf of at most about ``leaf`` points, a character a level, and the region of each node."""
    regions: dict[tuple[int, str], Region] = {}
    points, axis, idle = points.withColumn("path", F.lit("")), 0, 0
    while idle < 2:
        v = ("x", "y")[axis]
        found = points.groupBy("k", "path").agg(F.count("*").alias("n"), F.min(v).alias("low"), F.percentile_approx(v, WAYS, 1000).alias("cuts"))
        rows = []
        large = found.filter(F.col("n") > leaf).collect()  # a row for each so many points
        for e in large:
            cuts = sorted({c for c in (e["cuts"] if e["n"] > 2 * leaf else e["cuts"][1:2]) if c > e["low"]})
            ends = list(regions.get((e["k"], e["path"]), PLANE))
            if cuts:
                rows.append((e["k"], e["path"], cuts))
            for i, (low, high) in enumerate(zip([ends[2 * axis], *cuts], [*cuts, ends[2 * axis + 1]])) if cuts else ():
                regions[e["k"], f"{e['path']}{i}"] = tuple([low, high, *ends[2:]] if axis == 0 else [*ends[:2], low, high])
        if not large:
            break
        if rows:
            cuts = F.broadcast(points.sparkSession.createDataFrame(rows, "k int, path string, cuts array<double>"))
            child = F.size(F.filter("cuts", lambda c: c <= F.col(v))).cast("string")
            points = points.join(cuts, ["k", "path"], "left").withColumn("path", F.when(F.col("cuts").isNull(), F.col("path")).otherwise(F.concat("path", child))).drop("cuts")
        axis, idle = 1 - axis, 0 if rows else idle + 1
    return points, regions


def _round(rows: DataFrame, depth: int, first: bool, regions: dict[tuple[int, str], Region], boxes: list[Region]) -> DataFrame:
    """Edges that stand once the points of each node at ``depth`` are triangulated, and of what doesn't stand yet its corners, and itself if it may."""
    count = max(1, len({(k, path[:depth]) for k, path in regions}) + len(boxes))
    regions = {at: r for at, r in regions.items() if len(at[1]) <= depth}

    def turned(t: np.ndarray) -> list[tuple[int, ...]]:
        return [(a, b, c) if a <= b and a <= c else (b, c, a) if b <= c else (c, a, b) for a, b, c in t.tolist()]

    def run(g: pd.DataFrame) -> pd.DataFrame:
        k, node = int(g["k"].iloc[0]), g["node"].iloc[0]
        points = g[g["kind"] == POINT].sort_values("a")
        child, _ = pd.factorize(points["path"])
        if not first and not child.any() and points["path"].iloc[0] == node:
            return g.drop(columns="node")  # a leaf that has been seen
        p, cell = points[["x", "y"]].to_numpy(), points["a"].to_numpy()
        t = triangles(p)
        if not len(t):  # both sides of a line
            line = np.lexsort((p[:, 1], p[:, 0]))
            t = np.array([(*q, FAR) for a, b in zip(line, line[1:]) for q in ((a, b), (b, a))], np.int64).reshape(-1, 3)
        stands = _settled(p, t, regions.get((k, node), PLANE), boxes[k])
        left = np.setdiff1d(t[~stands], [FAR]) if len(p) > 1 else np.zeros(1, np.int64)
        counts = np.ones(len(t), bool)
        if not first:
            faces = g[g["kind"] >= FACE]
            known = np.searchsorted(cell, faces[["a", "b", "c"]].to_numpy())
            known[(faces["kind"] == HULL).to_numpy(), 2] = FAR
            a, b, c = (child[t[:, j]] for j in range(3))
            known = set(turned(known))
            counts = (a != b) | (t[:, 2] != FAR) & (a != c) | np.array([q in known for q in turned(t)], bool)
        done, open_ = t[stands & counts], t[~stands & counts]
        ends = np.concatenate([done[:, [i, j]] for i, j in ((0, 1), (1, 2), (2, 0))])
        ends = ends[(ends != FAR).all(axis=1)]
        gap = p[ends[:, 0]] - p[ends[:, 1]]
        none = lambda *some: np.zeros(sum(map(len, some)), np.int64)
        out = {
            "kind": np.concatenate([np.full(len(ends), EDGE), np.full(len(left), POINT), np.where(open_[:, 2] == FAR, HULL, FACE)]),
            "a": np.concatenate([cell[ends[:, 0]], cell[left], cell[open_[:, 0]]]),
            "b": np.concatenate([cell[ends[:, 1]], none(left), cell[open_[:, 1]]]),
            "c": np.concatenate([none(ends, left), cell[open_[:, 2]]]),
            "x": np.concatenate([np.sqrt((gap * gap).sum(axis=1)), p[left, 0], none(open_)]),
            "y": np.concatenate([none(ends), p[left, 1], none(open_)]),
        }
        return pd.DataFrame(out).assign(k=k, path=node)[["kind", "k", "path", "a", "b", "c", "x", "y"]]

    parts = min(2 * count, max(4 * rows.sparkSession.sparkContext.defaultParallelism, count // 8))
    dealt = rows.withColumn("node", F.substring("path", 1, depth)).repartition(parts, "k", "node")
    return checkpointed(dealt.groupBy("k", "node").applyInPandas(run, ROUND))


def delaunay(vertices: DataFrame, tile: int = TILE, by: tuple[str, ...] = ()) -> DataFrame:
    """src, dst, w, dist of the triangulation of (cell, coord), both directions; with ``by`` of the points of each key."""
    spark = vertices.sparkSession
    xy = vertices.select(*by, F.col("cell").cast("long").alias("cell"), F.col("coord")[0].cast("double").alias("x"), F.col("coord")[1].cast("double").alias("y"))
    xy = xy.filter((F.abs("x") < math.inf) & (F.abs("y") < math.inf))  # NaN is the largest
    places = xy.groupBy(*by, "x", "y").agg(F.min("cell").alias("cell"))
    at = F.struct("x", "y")
    ends = places.groupBy(*by).agg(F.count("*").alias("n"), *[f(at, c).alias(f"{f.__name__}_{c}") for c in ("x", "y") for f in (F.min_by, F.max_by)]).collect()  # a row a key
    boxes, known = [], []
    for e in ends:
        box = tuple(e[f"{f}_{c}"][c] for c in ("x", "y") for f in ("min_by", "max_by")) if e["n"] else PLANE
        if e["n"] < 3 or box[0] == box[1] or box[2] == box[3]:
            continue
        c = "x" if box[1] - box[0] >= box[3] - box[2] else "y"
        low, high = e[f"min_by_{c}"], e[f"max_by_{c}"]
        known.append((*[e[c] for c in by], len(boxes), low["x"], low["y"], high["x"] - low["x"], high["y"] - low["y"], max(box[1] - box[0], box[3] - box[2])))
        boxes.append(box)
    kinds = ", ".join([f"_{c} {places.schema[c].dataType.simpleString()}" for c in by] + ["k int, lx double, ly double, dx double, dy double, extent double"])
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]

    if known:
        keys = F.broadcast(spark.createDataFrame(known, kinds))
        points = places.join(keys, same, "inner") if by else places.crossJoin(keys)
        x, y = ((F.col(c) - F.col(f"l{c}")) / F.col("extent") for c in ("x", "y"))
        off = F.abs(F.col("dx") / F.col("extent") * y - F.col("dy") / F.col("extent") * x)
        points = checkpointed(points.select("k", "cell", "x", "y", off.alias("off")))
        plane = {r["k"] for r in points.groupBy("k").agg(F.max("off").alias("off")).filter(F.col("off") >= EPS).collect()}  # the others are on a line but for rounding
        points, known = points.drop("off"), [x for x in known if x[len(by)] in plane]
    if not by and not known:
        return graph.knn_graph(vertices, NEAR)
    joined = None
    if known:
        if len(known) < len(boxes):
            points = points.filter(F.col("k").isin([x[len(by)] for x in known]))
        points, regions = _cut(points, tile * SQUARE * SQUARE)
        rows = points.select(F.lit(POINT).alias("kind"), "k", "path", F.col("cell").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("c"), "x", "y")
        levels = max((len(path) for _, path in regions), default=0)
        for depth in sorted({0, *range(levels, 0, -STEP)}, reverse=True):
            found = _round(rows, depth, depth == levels, regions, boxes)
            edges = found.filter(F.col("kind") == EDGE).select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("x").alias("dist"))
            joined = edges if joined is None else joined.unionByName(edges)
            rows = found.filter(F.col("kind") != EDGE)
    if by:
        flat = spark.createDataFrame([x[: len(by) + 1] for x in known], kinds.split(", lx")[0])
        along = Window.partitionBy(*by).orderBy("x", "y")
        rest = places.join(F.broadcast(flat), same, "left_anti")
        line = rest.select("cell", "x", "y", *[F.lag(c).over(along).alias(f"_{c}") for c in ("cell", "x", "y")]).filter("_cell is not null")
        gap = F.sqrt((F.col("x") - F.col("_x")) * (F.col("x") - F.col("_x")) + (F.col("y") - F.col("_y")) * (F.col("y") - F.col("_y")))
        path = graph.both_ways(line.select(F.col("_cell").alias("src"), F.col("cell").alias("dst"), gap.alias("dist")))
        joined = path if joined is None else joined.unionByName(path)
    return joined.select("src", "dst", F.lit(1.0).alias("w"), "dist")
