"""Delaunay tiles against the empty-circle test over all points."""

import itertools

import numpy as np

from fieldspark.operators import triangulation as D


def brute(p):
    """Edges through whose ends some circle holds no other point."""
    out = set()
    for a, b in itertools.combinations(range(len(p)), 2):
        m, h = (p[a] + p[b]) / 2, (p[b] - p[a]) / 2
        n = np.array([-h[1], h[0]])
        d = np.delete(p, [a, b], axis=0) - m
        s, f = d @ n, (d * d).sum(axis=1) - h @ h
        if (f[s == 0] < 0).any():
            continue
        t = f / np.where(s == 0, 1, 2 * s)
        if max(t[s < 0], default=-np.inf) < min(t[s > 0], default=np.inf):
            out.add((a, b))
    return out


def test_triangles_of_one_task():
    for seed in range(6):
        p = np.random.default_rng(seed).standard_normal((60, 2)) * [1, 10.0**-seed]
        t = D.triangles(p)
        t = t[t[:, 2] != D.FAR]
        assert {tuple(sorted((q[i], q[j]))) for q in t.tolist() for i, j in ((0, 1), (1, 2), (0, 2))} == brute(p)
    assert not len(D.triangles(np.stack([np.arange(9.0), 2 * np.arange(9.0)], axis=1)))


def edges(spark, p, tile, exact=True):
    rows = [(i, [float(x), float(y)]) for i, (x, y) in enumerate(p)]
    out = D.delaunay(spark.createDataFrame(rows, "cell long, coord array<double>"), tile).collect()
    assert {(r["src"], r["dst"]) for r in out} == {(r["dst"], r["src"]) for r in out}
    for r in out[:20] if exact else []:
        assert np.isclose(r["dist"], np.hypot(*(np.array(p[r["src"]]) - p[r["dst"]])))
    return {(r["src"], r["dst"]) for r in out if r["src"] < r["dst"]}


def test_tiles_are_the_whole(spark):
    r = np.random.default_rng(3)
    p = np.concatenate([r.random((110, 2)), r.normal(0.3, 0.02, (60, 2)), [[0.9, 3.0], [3.0, 0.1]]])  # dense and empty tiles, far points
    assert edges(spark, p, 12) == brute(p)


def test_degenerate(spark):
    line = [(i, 2.0 * i) for i in range(8)]
    got = edges(spark, np.array(line), 4, False)
    assert {(i, i + 1) for i in range(7)} <= got  # joined with the nearest
    p = np.random.default_rng(5).random((40, 2))
    assert edges(spark, np.concatenate([p, p[:5]]), 8) == brute(p)  # of one place the least cell


def test_meshes_by_key(spark):
    """Each key in tiles of its own, far out too; a line and two points are joined in a row."""
    r = np.random.default_rng(11)
    meshes = {"a": r.random((90, 2)), "b": r.normal(5, 30, (70, 2)), "line": np.stack([np.arange(6.0), 3 * np.arange(6.0)], axis=1)[::-1], "two": np.array([[0.0, 0], [1, 0]])}
    rows = [(k, 1000 * m + i, x.tolist()) for m, (k, p) in enumerate(meshes.items()) for i, x in enumerate(p)]
    out = D.delaunay(spark.createDataFrame(rows, "key string, cell long, coord array<double>"), 10, ("key",)).collect()
    got = sorted((x["src"], x["dst"]) for x in out if x["src"] < x["dst"])
    want = [(1000 * m + i, 1000 * m + j) for m, k in enumerate("ab") for i, j in brute(meshes[k])]
    want += [(2000 + i, 2001 + i) for i in range(5)] + [(3000, 3001)]
    assert got == sorted(want) and len(out) == 2 * len(got)


def test_the_query_asks_no_task_for_a_label(spark, monkeypatch):
    """``delaunay_graph`` goes by tiles."""
    from fieldspark.operators import graph
    from fieldspark.plans import queries

    monkeypatch.setattr(graph, "delaunay_graph", None)
    out = queries.QUERIES["delaunay_graph"](spark, "/root/testdata/sf0.001").collect()
    assert {(x["src"], x["dst"]) for x in out} == {(x["dst"], x["src"]) for x in out}


def once(spark, p, tile):
    rows = [(i, [float(x), float(y)]) for i, (x, y) in enumerate(p)]
    out = [(r["src"], r["dst"]) for r in D.delaunay(spark.createDataFrame(rows, "cell long, coord array<double>"), tile).collect()]
    assert len(out) == len(set(out))
    return set(out)


def both(t):
    t = t[t[:, 2] != D.FAR]
    return {(q[i], q[j]) for q in t.tolist() for i in range(3) for j in range(3) if i != j}


def test_rounds_dont_grow_with_the_outskirts(spark, monkeypatch):
    """Sparse points around a dense middle are met in rounds by the tree's levels, each of which writes one table."""
    written, write = [], D.checkpointed

    def counted(frame):
        written.append(write(frame))
        return written[-1]

    monkeypatch.setattr(D, "checkpointed", counted)
    p = np.random.default_rng(7).normal(0, 1, (3000, 2))
    assert once(spark, p, 12) == both(D.triangles(p))
    assert len(written) <= 4


def test_leaves_are_the_whole(spark, monkeypatch):
    """Leaves of a few points, some of them on a line: the same edges as one task's, each once in a direction."""
    monkeypatch.setattr(D, "SQUARE", 1)
    r = np.random.default_rng(5)
    lattice = np.stack(np.meshgrid(np.arange(16.0), np.arange(11.0)), axis=-1).reshape(-1, 2)
    tail = np.concatenate([r.normal(0, 1, (90, 2)), r.normal(4, 1e-5, (60, 2)), [[900.0, 2.0], [-3.0, 4000.0]]])
    assert once(spark, tail, 6) == both(D.triangles(tail)) == {(a, b) for e in brute(tail) for a, b in (e, e[::-1])}
    assert once(spark, lattice, 6) == both(D.triangles(lattice))
    gone = np.concatenate([tail[:40], [[np.nan, 0.0], [0.0, np.inf]]])  # no place, no edges
    assert once(spark, gone, 6) == both(D.triangles(tail[:40]))


def test_triangles_are_exact():
    """Points close together beside far ones are all kept; of points on a circle every order and every part of the set take the same triangles."""
    r = np.random.default_rng(2)
    p = np.concatenate([r.normal(0, 1e-13, (50, 2)), [[5.0, 1.0], [-2.0, 7.0]]])
    assert len(D.triangles(p)) == 2 * len(p) - 2  # as many as a closed surface has, with the point at infinity
    p = np.stack(np.meshgrid(np.arange(9.0), np.arange(7.0)), axis=-1).reshape(-1, 2)
    turned = lambda t: {tuple(np.roll(q, -int(np.argmin(q))).tolist()) for q in t}
    all_of = turned(D.triangles(p))
    assert len(all_of) == 2 * len(p) - 2
    for seed in range(4):
        some = np.sort(np.random.default_rng(seed).permutation(len(p))[:45])
        t = D.triangles(p[some])
        assert {q for q in all_of if min(q) >= 0 and np.isin(q, some).all()} <= turned(some[t[t[:, 2] != D.FAR]])
