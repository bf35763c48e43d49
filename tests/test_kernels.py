import numpy as np
import pytest

from fieldspark.functions import kernels as K
from fieldspark.operators import graph, placement


def rng():
    return np.random.default_rng(42)


def test_ranks():
    shape = (10, 8, 6)
    assert K.validate_ranks(None, shape) == [6, 6, 6]
    assert K.validate_ranks(4, shape) == [4, 4, 4]
    for bad in (0, 11, [5, 4], [5, 0, 3], [5, 4, 10], "invalid"):
        with pytest.raises(ValueError):
            K.validate_ranks(bad, shape)
    with pytest.raises(ValueError):
        K.validate_ranks(None, (5,))
    with pytest.raises(ValueError):
        K.validate_epsilon(0)


def test_tucker_single():
    x = rng().standard_normal((30, 20, 10))
    r = K.tucker(x, [10, 8, 5])
    assert [u.shape[1] for u in r.factors] == [10, 8, 5] and r.core.shape == (10, 8, 5)
    assert 0 < r.error(x) < 1
    for u in r.factors:
        assert np.allclose(u.T @ u, np.eye(u.shape[1]), atol=1e-10)
    full = K.tucker(x, [30, 20, 10])
    assert full.error(x) < 1e-10


def test_tucker_finds_low_rank():
    g = rng()
    core = g.standard_normal((2, 3, 2))
    x = K.multi_dot(core, [g.standard_normal((n, r)) for n, r in zip((8, 7, 6), (2, 3, 2))])
    assert K.tucker(x, [2, 3, 2]).error(x) < 1e-10


def _path(n):
    src = np.concatenate([np.arange(n - 1), np.arange(1, n), np.arange(n)])
    dst = np.concatenate([np.arange(1, n), np.arange(n - 1), np.arange(n)])
    deg = np.full(n, 2.0)
    deg[[0, -1]] = 1
    return src, dst, np.concatenate([-np.ones(2 * n - 2), deg])


def test_geometry_tucker_smooths():
    x = rng().standard_normal((12, 9))
    edges = _path(12)
    rough, smooth = (K.geometry_tucker(x, [4, 4], edges, a).factors[0] for a in (0.0, 50.0))
    energy = lambda u: np.linalg.norm(K.edges_apply(edges, u))
    assert energy(smooth) < energy(rough)
    assert np.allclose(smooth.T @ smooth, np.eye(4), atol=1e-8)


def test_smooth_solve_matches_dense():
    edges, n = _path(10), 10
    lap = np.zeros((n, n))
    np.add.at(lap, (edges[0], edges[1]), edges[2])
    b = rng().standard_normal(n)
    assert np.allclose(K.smooth_solve(edges, b, 0.3, 2.0), np.linalg.solve(2 * np.eye(n) + 0.3 * lap @ lap, b), atol=1e-5)


def test_modes_shape():
    g = rng()
    assert K.modes(g.standard_normal((5, 5, 3, 5)), [g.standard_normal((n, r)) for n, r in ((10, 5), (10, 5), (5, 3), (10, 5))]).shape == (10, 10, 5, 5)


@pytest.mark.parametrize("solver", ["cholesky", "direct", "svd"])
def test_admm_noiseless(solver):
    g = rng()
    a = g.standard_normal((100, 20))[g.permutation(100)[:30]]
    x = g.standard_normal(20)
    y = a @ x
    r = K.admm(a.T @ a, a.T @ y, y @ y, K.Sensing(max_iter=500, epsilon=1e-4, solver=solver))
    assert r.converged and np.abs(r.x - x).max() < 1e-3 and len(r.history) == r.iterations


def test_admm_policies_and_hook():
    a = rng().standard_normal((40, 10))
    y = a[:, 0] * 3
    seen = []
    for policy in ("boyd", "cap_only"):
        for stop in ("residual", "relative", "both"):
            r = K.admm(a.T @ a, a.T @ y, y @ y, K.Sensing(policy=policy, stop=stop, delta=0.1), hook=lambda *s: seen.append(s))
            assert abs(r.x[0] - 3) < 0.05
    assert len(seen[0]) == 5
    assert K.boyd(1.0, 100.0, 1.0, 1.0) == (1.0, 1.0) and K.boyd(0.25, 100.0, 1.0, 1.0) == (0.5, 0.5) and K.boyd(1.0, 1.0, 100.0, 1.0) == (0.5, 2.0)
    with pytest.raises(ValueError):
        K.Sensing(relax=1.0)


def test_alphas():
    assert K.auto_alpha(np.eye(3), np.zeros((3, 3)), 0.01) == 0.01
    assert K.auto_alpha(4 * np.eye(3), 2 * np.eye(3), 0.01) == pytest.approx(0.02)
    assert K.adaptive_alpha(0.01, 0.0) == 0.01 and K.adaptive_alpha(0.01, 50.0) == pytest.approx(0.01) and K.adaptive_alpha(0.01, 1.0) == pytest.approx(0.1)


def test_ssim():
    a = rng().random((20, 20))
    assert K.ssim(a, a) == pytest.approx(1.0)
    assert K.ssim(a, a + 0.3 * rng().standard_normal((20, 20))) < 0.95
    assert K.ssim(np.full((5, 5), 10.0), np.full((5, 5), 10.0)) == 1.0 and K.ssim(np.zeros((5, 5)), np.full((5, 5), 10.0)) == 0.0


def test_resize():
    x = np.arange(16.0).reshape(4, 4)
    assert np.allclose(K.resize(x, (4, 4)), x) and K.resize(x, (2, 8)).shape == (2, 8)
    assert np.allclose(K.resize(np.full((6, 6), 3.0), (3, 3)), 3.0)


def test_pivots():
    a = rng().standard_normal((60, 8))
    p = placement.place_array(a, 8)
    assert p.cells[0] == int(np.linalg.norm(a, axis=1).argmax()) and len(set(p.cells)) == 8
    assert np.allclose(p.q.T @ p.q, np.eye(8), atol=1e-10)
    r = a[p.cells] @ p.q
    assert np.allclose(np.triu(r, 1), 0, atol=1e-9)  # each pivot's tube ends at its own step
    blocked = placement.place_array(a, 3, blocked=[p.cells[0]])
    assert p.cells[0] not in blocked.cells
    with pytest.raises(ValueError):
        placement.place_array(a, 3, blocked=range(60))
    with pytest.raises(ValueError):
        placement.place_array(a * np.nan, 3)
    with pytest.raises(ValueError):
        placement.validate_count(0)
    with pytest.raises(RuntimeError):
        placement.place_array(np.zeros((4, 3)), 2)
    assert len(placement.place_array(rng().standard_normal((9, 5)), 20).cells) <= 9


def test_similar_regions_and_uniform():
    a = np.vstack([np.tile([5.0, 0, 0, 1], (8, 1)), rng().standard_normal((8, 4))])
    similar = np.array([0] * 8 + list(range(1, 9)))
    p = placement.place_array(a, 4, similar=similar)
    assert len(p.cells) == 4
    u = placement.place_array(rng().standard_normal((25, 10)), 10, opt=placement.Options(uniform=True, shape=[5, 5]))
    assert len(set(u.cells)) == 10


def test_geometry_spreads():
    x, y = np.meshgrid(np.arange(6.0), np.arange(6.0))
    coords = np.stack([x.ravel(), y.ravel()], axis=1)
    a = np.ones((36, 6)) + 0.01 * rng().standard_normal((36, 6))
    p = placement.place_array(a, 3, coords=coords, opt=placement.Options(geometry=True, proximity=5.0, min_distance=3.0))
    d = np.linalg.norm(coords[p.cells[0]] - coords[p.cells[1]])
    assert d > 2


def test_delaunay_is_empty_circle():
    pts = rng().random((40, 2))
    edges = graph.delaunay_edges(pts)
    assert all(a < b for a, b in edges) and len({i for e in edges for i in e}) == 40
    assert 40 <= len(edges) <= 3 * 40 - 6
    nearest = {(min(i, j), max(i, j)) for i in range(40) for j in [int(np.argsort(np.linalg.norm(pts - pts[i], axis=1))[1])]}
    assert nearest <= edges  # every nearest-neighbour edge is in the triangulation


def test_slices_share_what_is_placed_so_far():
    """A slice of the third axis is penalised for what it has above an even share of the sensors placed, whatever was asked for."""
    opt = placement.Options(uniform=True, shape=[2, 2, 2], slice_weight=1.0, density_weight=0.0)
    got = placement._penalty(np.arange(8), [0, 2, 5], [2, 2, 2], 10.0, opt)  # two in slice 0, one in slice 1
    assert np.allclose(got, [5.0 if k % 2 == 0 else 0.0 for k in range(8)])
    assert not placement._penalty(np.arange(4), [0, 1], [2, 2], 10.0, opt).any()


def test_ssim_has_sample_variances():
    a, b = rng().standard_normal((7, 7)), rng().standard_normal((7, 7))
    m = lambda x: K.blur(x, 1.5)[3, 3]
    f, ma, mb = 49 / 48, m(a), m(b)
    va, vb, vab = f * (m(a * a) - ma**2), f * (m(b * b) - mb**2), f * (m(a * b) - ma * mb)
    assert K.ssim(a, b) == pytest.approx((2 * ma * mb + 0.012) * (2 * vab + 0.032) / ((ma**2 + mb**2 + 0.012) * (va + vb + 0.032)))


def scalar_rounds(g, b, cfg, policy, stop, rounds):
    """ADMM in plain loops: the number of rounds, the penalty and the residuals."""
    w, x = len(b), None
    d, p, delta, history = np.zeros(w), np.zeros(w), cfg.delta, []
    for it in range(1, rounds + 1):
        x = np.linalg.solve(g + (delta + cfg.reg) * np.eye(w), b + delta * (d - p))
        m = cfg.relax * x + (1 - cfg.relax) * d
        new = np.array([np.sign(z) * max(abs(z) - cfg.epsilon / delta, 0) for z in m + p])
        p = p + m - new
        primal, dual = np.sqrt(((x - new) ** 2).sum()), delta * np.sqrt(((new - d) ** 2).sum())
        d = new
        if policy == "boyd" and primal > 10 * dual and min(2 * delta, cfg.delta_max) != delta:
            delta, p = min(2 * delta, cfg.delta_max), p * 0.5
        elif policy == "boyd" and dual > 10 * primal and not primal > 10 * dual:
            delta, p = delta / 2, p * 2
        history.append(max(primal, dual))
        small = history[-1] < cfg.tol
        slow = it > cfg.window and (history[-cfg.window] - history[-1]) / max(history[-cfg.window], 1e-12) < cfg.drop
        if {"residual": small, "relative": slow, "both": small or slow}[stop]:
            return x, it, True, delta, history
    return x, rounds, False, delta, history


@pytest.mark.parametrize("policy", ["boyd", "cap_only"])
@pytest.mark.parametrize("stop", ["residual", "relative", "both"])
def test_stops_look_at_residuals(policy, stop):
    a = rng().standard_normal((30, 8))
    y = a @ np.r_[3.0, -2.0, np.zeros(6)]
    cfg = K.Sensing(delta=2.0, delta_max=8.0, max_iter=60, tol=1e-3, drop=0.3, policy=policy, stop=stop)
    r = K.admm(a.T @ a, a.T @ y, y @ y, cfg)
    x, it, converged, delta, history = scalar_rounds(a.T @ a, a.T @ y, cfg, policy, stop, 60)
    assert (r.iterations, r.converged) == (it, converged) and r.delta == delta
    assert np.allclose(r.history, history) and np.allclose(r.x, x)


def test_a_solve_goes_on():
    from dataclasses import replace

    a = rng().standard_normal((30, 8))
    b, cfg = a.T @ a[:, 1], K.Sensing(delta=0.5, tol=0.0, max_iter=14)
    whole = K.admm(a.T @ a, b, 1.0, cfg)
    half = K.admm(a.T @ a, b, 1.0, replace(cfg, max_iter=7))
    rest = K.admm(a.T @ a, b, 1.0, replace(cfg, max_iter=7), state=half.state())
    assert np.array_equal(rest.x, whole.x) and rest.history == whole.history and rest.delta == whole.delta
    assert len(half.history) == 7  # not changed by what follows
    near = K.admm(a.T @ a, b * 1.001, 1.0, replace(cfg, tol=1e-6, max_iter=500), state=whole.state())
    assert near.iterations < K.admm(a.T @ a, b * 1.001, 1.0, replace(cfg, tol=1e-6, max_iter=500)).iterations
