"""Small dense linear algebra in numpy: what runs inside one task or on the driver."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


def unfold(x: np.ndarray, mode: int) -> np.ndarray:
    return np.moveaxis(x, mode, 0).reshape(x.shape[mode], -1)


def mode_dot(x: np.ndarray, u: np.ndarray, mode: int) -> np.ndarray:
    return np.moveaxis(np.tensordot(u, x, axes=(1, mode)), 0, mode)


def multi_dot(x: np.ndarray, factors: list[np.ndarray], transpose: bool = False, skip: int | None = None) -> np.ndarray:
    for m, u in enumerate(factors):
        if m != skip:
            x = mode_dot(x, u.T if transpose else u, m)
    return x


def signed(u: np.ndarray) -> np.ndarray:
    """Columns with their largest entry positive, so that a basis is the same in every run."""
    if not u.size:
        return u
    top = u[np.abs(u).argmax(axis=0), np.arange(u.shape[1])]
    return u * np.where(top < 0, -1.0, 1.0)


def leading(gram: np.ndarray, r: int) -> np.ndarray:
    """The r leading eigenvectors of a Gram matrix."""
    _, v = np.linalg.eigh((gram + gram.T) / 2)
    return signed(v[:, ::-1][:, :r])


def energy_rank(gram: np.ndarray, share: float = 0.95) -> int:
    """The least rank whose eigenvalues hold a share of the total."""
    w = np.maximum(np.linalg.eigvalsh(gram)[::-1], 0)
    return int(np.searchsorted(np.cumsum(w) / max(w.sum(), 1e-300), share) + 1) if w.sum() > 0 else 1


def validate_ranks(ranks, shape, least: int = 1) -> list[int]:
    """Ranks for a shape: None or an int for all axes alike, or a list with one rank an axis."""
    shape = [int(s) for s in shape]
    if len(shape) < 2 or min(shape) <= 0:
        raise ValueError(f"a tensor needs two or more non-empty axes, not {shape}")
    if ranks is None:
        return [min(shape)] * len(shape)
    if isinstance(ranks, bool) or not isinstance(ranks, (int, list, tuple)):
        raise ValueError(f"ranks must be None, an int or a list, not {ranks!r}")
    if isinstance(ranks, int):
        if not least <= ranks <= min(shape):
            raise ValueError(f"rank {ranks} is outside [{least}, {min(shape)}]")
        return [ranks] * len(shape)
    if len(ranks) != len(shape):
        raise ValueError(f"{len(ranks)} ranks for {len(shape)} axes")
    for i, (r, n) in enumerate(zip(ranks, shape)):
        if isinstance(r, bool) or not isinstance(r, int) or not least <= r <= n:
            raise ValueError(f"rank {r!r} at index {i} is outside [{least}, {n}]")
    return list(ranks)


def validate_epsilon(epsilon) -> float:
    if isinstance(epsilon, bool) or not isinstance(epsilon, (int, float)) or not epsilon > 0:
        raise ValueError(f"epsilon must be a positive number, not {epsilon!r}")
    return float(epsilon)


@dataclass
class Tucker:
    core: np.ndarray
    factors: list[np.ndarray]
    iterations: int = 0

    def full(self) -> np.ndarray:
        return multi_dot(self.core, self.factors)

    def error(self, x: np.ndarray) -> float:
        return float(np.linalg.norm(x - self.full()) / np.linalg.norm(x))


def tucker(x: np.ndarray, ranks, epsilon: float = 1e-2, rounds: int = 100) -> Tucker:
    """HOSVD, then higher-order orthogonal iteration until the error changes by less than epsilon."""
    x = np.asarray(x, float)
    ranks, epsilon = validate_ranks(ranks, x.shape), validate_epsilon(epsilon)
    factors = [leading(unfold(x, m) @ unfold(x, m).T, r) for m, r in enumerate(ranks)]
    norm, before, it = np.linalg.norm(x), None, 0
    for it in range(1, rounds + 1):
        for m, r in enumerate(ranks):
            y = unfold(multi_dot(x, factors, transpose=True, skip=m), m)
            factors[m] = leading(y @ y.T, r)
        core = multi_dot(x, factors, transpose=True)
        error = np.sqrt(max(0.0, norm**2 - np.linalg.norm(core) ** 2)) / max(norm, 1e-300)
        if before is not None and abs(before - error) < epsilon:
            break
        before = error
    return Tucker(multi_dot(x, factors, transpose=True), factors, it)


def edges_apply(edges: tuple, u: np.ndarray) -> np.ndarray:
    """L u for a Laplacian given as (src, dst, entries), without building it."""
    src, dst, entry = edges
    out = np.zeros_like(u)
    np.add.at(out, src, entry[:, None] * u[dst] if u.ndim == 2 else entry * u[dst])
    return out


def smooth_solve(edges: tuple, rhs: np.ndarray, alpha: float, beta: float, rounds: int = 100, tol: float = 1e-6) -> np.ndarray:
    """Conjugate gradients for (beta I + alpha L'L) u = rhs; L is symmetric."""
    apply = lambda v: beta * v + alpha * edges_apply(edges, edges_apply(edges, v))
    u = np.zeros_like(rhs)
    r = rhs.copy()
    p, rr = r.copy(), r @ r
    for _ in range(rounds):
        if np.sqrt(rr) < tol:
            break
        q = apply(p)
        a = rr / (p @ q)
        u += a * p
        r -= a * q
        new = r @ r
        p, rr = r + new / rr * p, new
    return u


def geometry_tucker(x: np.ndarray, ranks, edges: tuple, alpha: float = 0.01, spatial=(0,), epsilon: float = 1e-2, rounds: int = 50) -> Tucker:
    """Tucker by alternating least squares with Laplacian smoothing of the spatial factors: column j of a
    smoothed factor solves (alpha L'L + |g_j|^2 I) u = (Y G')_j, g_j being a row of the core's
    unfolding; the columns are then made orthonormal."""
    x = np.asarray(x, float)
    ranks = validate_ranks(ranks, x.shape)
    factors = [np.linalg.svd(unfold(x, m), full_matrices=False)[0][:, :r] for m, r in enumerate(ranks)]
    norm, before, it = max(np.linalg.norm(x), 1e-300), None, 0
    for it in range(1, rounds + 1):
        for m, r in enumerate(ranks):
            y = unfold(multi_dot(x, factors, transpose=True, skip=m), m)
            if m in spatial:
                g = unfold(multi_dot(x, factors, transpose=True), m)
                rhs = y @ g.T
                u = np.stack([smooth_solve(edges, rhs[:, j], alpha, float(g[j] @ g[j]) + 1e-12) for j in range(r)], axis=1)
                factors[m] = np.linalg.qr(u)[0]
            else:
                factors[m] = np.linalg.svd(y, full_matrices=False)[0][:, :r]
        core = multi_dot(x, factors, transpose=True)
        error = np.linalg.norm(x - multi_dot(core, factors)) / norm
        if before is not None and abs(before - error) < epsilon:
            break
        before = error
    factors = [signed(u) for u in factors]
    return Tucker(multi_dot(x, factors, transpose=True), factors, it)


def modes(core: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    """Spatial modes that don't depend on time: the core's last-axis slices in the spatial factors."""
    return multi_dot(core, factors[:-1])


# --- sparse recovery ---------------------------------------------------------------------------


def soft(z, k):
    return np.sign(z) * np.maximum(np.abs(z) - k, 0)


def boyd(delta: float, primal: float, dual: float, most: float) -> tuple[float, float]:
    """Keep the residuals within a factor of ten: (new delta, factor of the scaled dual)."""
    new = min(2 * delta, most) if primal > 10 * dual else max(delta / 2, 1e-12) if dual > 10 * primal else min(delta, most)
    return new, (1.0 if new == delta else 0.5 if primal > 10 * dual else 2.0 if dual > 10 * primal else 1.0)


def cap_only(delta: float, primal: float, dual: float, most: float) -> tuple[float, float]:
    return delta, 1.0


def stop_residual(it, primal, dual, cfg, history) -> bool:
    return max(primal, dual) < cfg.tol


def stop_relative(it, primal, dual, cfg, history) -> bool:
    """Little progress of the residuals over a window of rounds."""
    if it <= cfg.window or len(history) < cfg.window:
        return False
    then, now = history[-cfg.window], history[-1]
    return (then - now) / max(then, 1e-12) < cfg.drop


def stop_both(it, primal, dual, cfg, history) -> bool:
    return stop_residual(it, primal, dual, cfg, history) or stop_relative(it, primal, dual, cfg, history)


@dataclass
class Sensing:
    max_iter: int = 1000
    tol: float = 1e-4
    epsilon: float = 1e-2
    delta: float = 1.0
    delta_max: float = 1.0
    relax: float = 0.95
    solver: object = "cholesky"
    reg: float = 1e-8
    policy: object = "boyd"
    stop: object = "residual"
    window: int = 5
    drop: float = 1e-3

    def __post_init__(self):
        if not 0 < self.relax < 1:
            raise ValueError("relax must lie in (0, 1)")


POLICIES = {"boyd": boyd, "cap_only": cap_only}
STOPS = {"residual": stop_residual, "relative": stop_relative, "both": stop_both}


class Solver:
    """Solves (gram + delta I + reg I) x = b; one factorisation a delta."""

    def __init__(self, gram: np.ndarray, kind, reg: float):
        self.gram, self.kind, self.reg, self.known = gram, kind, reg, {}

    def __call__(self, delta: float, b: np.ndarray) -> np.ndarray:
        if callable(self.kind):
            return self.kind(self.gram + delta * np.eye(len(b)), b)
        if delta not in self.known:
            lhs = self.gram + delta * np.eye(len(b))
            if self.kind in ("cholesky", "direct"):
                lhs = lhs + self.reg * np.eye(len(b))
                try:
                    if self.kind == "cholesky":
                        half = np.linalg.inv(np.linalg.cholesky(lhs))
                        self.known[delta] = half.T @ half
                    else:
                        self.known[delta] = np.linalg.inv(lhs)
                except np.linalg.LinAlgError:
                    self.known[delta] = np.linalg.pinv(lhs)
            elif self.kind == "svd":
                u, s, v = np.linalg.svd(lhs)
                keep = s > np.finfo(float).eps * max(lhs.shape) * s[0]
                self.known[delta] = (v[keep].T / s[keep]) @ u[:, keep].T
            else:
                raise ValueError(f"unknown solver: {self.kind}")
        return self.known[delta] @ b


@dataclass
class Recovery:
    x: np.ndarray
    iterations: int
    converged: bool
    primal: float
    dual: float
    objective: float
    delta: float
    history: list = field(default_factory=list)
    d: np.ndarray | None = None
    p: np.ndarray | None = None

    def state(self) -> State:
        return State(self.d, self.p, self.delta, self.history)


@dataclass
class State:
    """Where a solve stands: the sparse copy, the scaled dual, the penalty and the residuals so far."""

    d: np.ndarray
    p: np.ndarray
    delta: float
    history: list = field(default_factory=list)


def admm(gram: np.ndarray, aty: np.ndarray, yty: float, cfg: Sensing = Sensing(), smooth: np.ndarray | None = None, solver: Solver | None = None, hook=None, state: State | None = None) -> Recovery:
    """Basis pursuit denoising on normal equations: min 1/2 |A x - y|^2 + epsilon |x|_1, with relaxation.
    ``smooth`` is a second quadratic form that is added (a Laplacian's). With ``state`` the solve goes on from there, for the same right-hand
    side or a new one; the state it ends in is in the result. The history holds the larger residual of each round."""
    lhs = gram if smooth is None else gram + smooth
    solve = solver or Solver(lhs, cfg.solver, cfg.reg)
    policy, stop = (POLICIES.get(cfg.policy, cfg.policy), STOPS.get(cfg.stop, cfg.stop))
    w = len(aty)
    if state is None:
        state = State(np.zeros(w), np.zeros(w), min(cfg.delta, cfg.delta_max))
    x, d, p, delta, history = state.d, state.d, state.p, state.delta, list(state.history)
    primal = dual = objective = np.inf
    it, converged = 0, False
    for it in range(1, cfg.max_iter + 1):
        x = solve(delta, aty + delta * (d - p))
        mixed = cfg.relax * x + (1 - cfg.relax) * d
        old, d = d, soft(mixed + p, cfg.epsilon / delta)
        p = p + mixed - d
        primal, dual = float(np.linalg.norm(x - d)), float(delta * np.linalg.norm(d - old))
        objective = float(0.5 * (x @ lhs @ x - 2 * aty @ x + yty) + cfg.epsilon * np.abs(d).sum())
        new, factor = policy(delta, primal, dual, cfg.delta_max)
        if new != delta:
            delta, p = new, p * factor
        history.append(max(primal, dual))
        if hook is not None:
            hook(it, primal, dual, objective, delta)
        if stop(it, primal, dual, cfg, history):
            converged = True
            break
    return Recovery(x, it, converged, primal, dual, objective, delta, history, d, p)


def auto_alpha(gram: np.ndarray, smooth: np.ndarray, alpha: float, most: float = 1.0) -> float:
    top = np.linalg.norm(smooth, 2)
    return alpha if top <= 1e-10 else float(np.clip(alpha * np.linalg.norm(gram, 2) / top, 1e-6, most))


def adaptive_alpha(alpha: float, level: float, most: float = 1.0, reference: float = 50.0) -> float:
    return alpha if level < 1e-6 else float(np.clip(alpha * np.clip(reference / level, 0.1, 10), 1e-6, most))


# --- images --------------------------------------------------------------------------------------


def blur(x: np.ndarray, sigma: float, truncate: float = 3.5) -> np.ndarray:
    """Separable Gaussian filter with mirrored borders."""
    r = int(truncate * sigma + 0.5)
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    k /= k.sum()
    for axis in range(x.ndim):
        padded = np.pad(x, [(r, r) if a == axis else (0, 0) for a in range(x.ndim)], mode="symmetric")
        x = sum(w * np.take(padded, range(i, i + x.shape[axis]), axis=axis) for i, w in enumerate(k))
    return x


def ssim(a: np.ndarray, b: np.ndarray, span: float | None = None, sigma: float = 1.5) -> float:
    """Gaussian-weighted structural similarity; the constants are sqrt(.012) and sqrt(.032) over the range.
    Variances are those of a sample, of a window of 7 cells a side at most. Of a constant reference: 1 if both
    agree, else 0. Three axes: the mean over the last."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    span = float(np.ptp(b)) if span is None else span
    if span < 1e-12:
        return 1.0 if np.allclose(a, b) else 0.0
    if a.ndim > 2:
        return float(np.mean([ssim(a[..., k], b[..., k], span, sigma) for k in range(a.shape[-1])]))
    c1, c2 = (np.sqrt(0.012) / span * span) ** 2, (np.sqrt(0.032) / span * span) ** 2
    ma, mb = blur(a, sigma), blur(b, sigma)
    side = min(7, min(a.shape)) - 1 | 1
    cells = side**2
    unbiased = cells / max(1, cells - 1)
    va, vb, vab = (unbiased * v for v in (blur(a * a, sigma) - ma * ma, blur(b * b, sigma) - mb * mb, blur(a * b, sigma) - ma * mb))
    s = (2 * ma * mb + c1) * (2 * vab + c2) / ((ma * ma + mb * mb + c1) * (va + vb + c2))
    pad = side // 2
    core = s[pad : s.shape[0] - pad or None, pad : s.shape[1] - pad or None]
    return float((core if core.size else s).mean())


def resize(x: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """Bilinear, after a Gaussian filter where the image shrinks."""
    x = np.asarray(x, float)
    for axis, n in enumerate(shape):
        m = x.shape[axis]
        if m > n:
            s = [0.0, 0.0]
            s[axis] = (m / n - 1) / 2
            r = int(4 * s[axis] + 0.5)
            if r:
                k = np.exp(-0.5 * (np.arange(-r, r + 1) / s[axis]) ** 2)
                k /= k.sum()
                padded = np.pad(x, [(r, r) if a == axis else (0, 0) for a in range(2)], mode="symmetric")
                x = sum(w * np.take(padded, range(i, i + m), axis=axis) for i, w in enumerate(k))
        at = np.clip((np.arange(n) + 0.5) * m / n - 0.5, 0, m - 1)
        lo = np.floor(at).astype(int)
        hi, f = np.minimum(lo + 1, m - 1), at - lo
        f = f[:, None] if axis == 0 else f[None, :]
        x = (1 - f) * np.take(x, lo, axis=axis) + f * np.take(x, hi, axis=axis)
    return x
