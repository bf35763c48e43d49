"""Decompositions with axes too long for one machine.

The factor of a long axis is a table too: blocks of its rows (axis, ``rank``), of the same size along the axis as the tensor's blocks, so
both meet by block number. Only numbers of the ranks' size reach the driver:

* R factors by QR in tasks and in tree rounds (``triangle``);
* leading vectors by a randomised range finder (Halko, Martinsson, Tropp 2011), exact where the rank of the unfolding is at most
  ``rank + more``, with power rounds elsewhere; once the other axes are contracted, by the R factor alone;
* Laplacian smoothing by conjugate gradients on blocks of edges, all columns at once.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldspark.functions import kernels as K
from fieldspark.operators import blocks
from fieldspark.operators.blocks import Blocks, _array, _batch, _held_sums, _rows, _schema, shape, span, summed
from fieldspark.operators.cut import checkpointed, release

#: Rows that a task stacks under its R factor at a time; partitions merged in a round of the tree.
STACK, FAN = 4096, 16


def tall(t: Blocks, axis: str) -> Blocks:
    """A tensor of one block along all other axes as a matrix (axis, rank): each row the others' entries, row-major."""
    names, m = list(t.axes), list(t.axes).index(axis)
    axes, sizes = t.axes, t.sizes
    width = math.prod(n for a, n in axes.items() if a != axis)

    def run(batches):
        for at, data in _rows(batches, names):
            yield _batch((at[m], 0), K.unfold(_array(data, shape(axes, sizes, at)), m), [axis, "rank"])

    if any(sizes[a] < n for a, n in axes.items() if a != axis):
        raise ValueError("only the one axis may have several blocks")
    return Blocks(t.frame.mapInArrow(run, _schema([axis, "rank"])), {axis: axes[axis], "rank": width}, {axis: sizes[axis], "rank": width})


def from_array(spark, u: np.ndarray, axis: str, size: int) -> Blocks:
    """A factor that fits the driver, as blocks of rows."""
    rows = [(i // size, 0, np.ascontiguousarray(u[i : i + size], np.float64).tobytes()) for i in range(0, len(u), size)]
    return Blocks(spark.createDataFrame(rows, _schema([axis, "rank"])), {axis: len(u), "rank": u.shape[1]}, {axis: size, "rank": u.shape[1]})


def times(a: Blocks, small: np.ndarray) -> Blocks:
    """Rows times a small matrix."""
    axis, _ = a.axes
    width = a.axes["rank"]

    def run(batches):
        for at, data in _rows(batches, [axis, "rank"]):
            yield _batch(at, _array(data, (-1, width)) @ small, [axis, "rank"])

    n = small.shape[1]
    return Blocks(a.frame.mapInArrow(run, a.schema()), {axis: a.axes[axis], "rank": n}, {axis: a.sizes[axis], "rank": n})


def triangle(a: Blocks) -> np.ndarray:
    """The R factor (rank x rank) of all rows: of each task's rows, then of FAN tasks' factors a round."""
    axis, width = next(iter(a.axes)), a.axes["rank"]

    def reduce_rows(batches):
        r = np.zeros((0, width))
        for b in batches:
            for x in b.column(b.schema.get_field_index("data")):
                rows = _array(x.as_py(), (-1, width))
                for s in range(0, len(rows), STACK):
                    r = np.linalg.qr(np.vstack([r, rows[s : s + STACK]]), mode="r")
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary())], names=["data"])

    parts = a.frame.select(axis, "data").mapInArrow(reduce_rows, "data binary")
    left = blocks.tasks_of(a.frame.sparkSession)
    while left > 1:
        left = -(-left // FAN)
        parts = parts.repartition(left).mapInArrow(reduce_rows, "data binary")
    r = np.vstack([np.zeros((0, width)), *[_array(x[0], (-1, width)) for x in parts.collect()]])
    return np.linalg.qr(np.vstack([r, np.zeros((width, width))]), mode="r")


def left_vectors(a: Blocks, most: int | None = None, tolerance: float = 1e-12) -> Blocks:
    """The leading left singular vectors, as many as there are above ``tolerance`` of the first, ``most`` at most. A second
    R factor mends what the division by small singular values loses."""
    _, s, v = np.linalg.svd(triangle(a))
    keep = min(max(1, int((s > tolerance * s[0]).sum())), most or len(s))
    return orthonormal(_kept(times(a, v[:keep].T / np.where(s[:keep] > 0, s[:keep], 1.0))))


def orthonormal(a: Blocks) -> Blocks:
    """The Q factor, from R: of full rank, as ``numpy.linalg.qr`` but for signs, which make R's diagonal positive."""
    r = triangle(a)
    d = np.diag(r)
    if not len(d) or np.abs(d).min() == 0:  # zeros stay zeros
        return times(a, np.linalg.pinv(r))
    return times(a, np.linalg.solve(r, np.diag(np.sign(d))))


def multiply(t: Blocks, factors: dict, transpose: bool = True) -> Blocks:
    """Mode products with arrays and with tables of factor rows."""
    arrays = {a: u for a, u in factors.items() if isinstance(u, np.ndarray)}
    tables = {a: u for a, u in factors.items() if isinstance(u, Blocks)}
    if arrays and transpose:
        t = blocks.multiply(t, arrays, True)
    for a, u in tables.items():
        t = _multiply_table(t, a, u, transpose)
    return blocks.multiply(t, arrays, False) if arrays and not transpose else t


def _multiply_table(t: Blocks, axis: str, u: Blocks, transpose: bool) -> Blocks:
    names, m, width = list(t.axes), list(t.axes).index(axis), u.axes["rank"]
    rows = u.frame.select(F.col(axis).alias("_block"), F.col("data").alias("_factor"))
    to = {a: (width if transpose else u.axes[axis]) if a == axis else n for a, n in t.axes.items()}
    to_sizes = {a: (width if transpose else u.sizes[axis]) if a == axis else n for a, n in t.sizes.items()}
    axes, sizes = t.axes, t.sizes
    if transpose:
        if sizes[axis] != u.sizes[axis]:
            raise ValueError(f"tensor and factor have blocks of other sizes along {axis}")
        met = t.frame.join(rows, F.col(axis) == F.col("_block"))
    else:
        met = t.frame.crossJoin(rows)  # a pair is a block of the result

    def run(batches):
        def out():
            for b in batches:
                block = b.column(b.schema.get_field_index("_block")).to_numpy()
                factor = b.column(b.schema.get_field_index("_factor"))
                for i, (at, data) in enumerate(_rows([b], names)):
                    f = _array(factor[i].as_py(), (-1, width))
                    x = K.mode_dot(_array(data, shape(axes, sizes, at)), f.T if transpose else f, m)
                    yield tuple((0 if transpose else int(block[i])) if a == axis else k for a, k in zip(names, at)), x

        yield from _held_sums(out(), names)

    frame = met.mapInArrow(run, _schema(names))
    return Blocks(summed(frame, to, to_sizes) if transpose else frame, to, to_sizes)


def normals(index: np.ndarray, width: int, seed: int) -> np.ndarray:
    """Normal numbers (index, width) that depend on the index and the seed alone."""
    mask = np.uint64(0xFFFFFFFFFFFFFFFF)
    n = (width + 1) // 2
    x = (index.astype(np.uint64)[:, None] * np.uint64(2 * n) + np.arange(2 * n, dtype=np.uint64) + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15)) & mask
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    u = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / float(1 << 53)
    radius, angle = np.sqrt(-2 * np.log1p(-u[:, :n])), 2 * np.pi * u[:, n:]
    return np.concatenate([radius * np.cos(angle), radius * np.sin(angle)], axis=1)[:, :width]


def _sketch(t: Blocks, axis: str, width: int, seed: int) -> Blocks:
    """The unfolding along the axis times a matrix of normal numbers, which is never stored."""
    names, m, axes, sizes = list(t.axes), list(t.axes).index(axis), t.axes, t.sizes

    def run(batches):
        def out():
            for at, data in _rows(batches, names):
                x = K.unfold(_array(data, shape(axes, sizes, at)), m)
                column = np.zeros(1, np.int64)
                for a, b in zip(names, at):
                    if a != axis:
                        s, e = span(axes, sizes, a, b)
                        column = (column[:, None] * axes[a] + np.arange(s, e)).ravel()
                yield (at[m], 0), x @ normals(column, width, seed)

        yield from _held_sums(out(), [axis, "rank"])

    to, to_sizes = {axis: axes[axis], "rank": width}, {axis: sizes[axis], "rank": width}
    return Blocks(summed(t.frame.mapInArrow(run, _schema([axis, "rank"])), to, to_sizes), to, to_sizes)


def _paired(t: Blocks, z: Blocks, axis: str) -> DataFrame:
    """Blocks of ``t`` with z's of the same places along all other axes. Those places may be few, or one, so z's blocks are
    copied: one for about HELD of t's along the axis, which are a key of the join."""
    others = [a for a in t.axes if a != axis]
    copies = -(-t.counts()[axis] // blocks.HELD)
    left = t.frame.withColumn("_copy", F.pmod(F.col(axis), F.lit(copies)))
    right = z.frame.select(*others, F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("_copy"), F.col("data").alias("_other"))
    return left.join(right, [*others, "_copy"])


def _against(t: Blocks, z: Blocks, axis: str) -> Blocks:
    """The unfolding of ``t`` along the axis times the transposed one of ``z``, whose blocks lie as t's along all other axes."""
    names, m, axes, sizes = list(t.axes), list(t.axes).index(axis), t.axes, t.sizes
    met = _paired(t, z, axis)
    width = z.axes[axis]

    def run(batches):
        def out():
            for b in batches:
                other = b.column(b.schema.get_field_index("_other"))
                for i, (at, data) in enumerate(_rows([b], names)):
                    dims = shape(axes, sizes, at)
                    y = _array(other[i].as_py(), tuple(width if k == m else n for k, n in enumerate(dims)))
                    yield (at[m], 0), K.unfold(_array(data, dims), m) @ K.unfold(y, m).T

        yield from _held_sums(out(), [axis, "rank"])

    to, to_sizes = {axis: axes[axis], "rank": width}, {axis: sizes[axis], "rank": width}
    return Blocks(summed(met.mapInArrow(run, _schema([axis, "rank"])), to, to_sizes), to, to_sizes)


def leading(t: Blocks, axis: str, rank: int, more: int = 8, power: int = 2, seed: int = 1) -> Blocks:
    """The leading left singular vectors of the unfolding along a long axis, by a randomised range finder."""
    width = min(rank + more, t.axes[axis], math.prod(n for a, n in t.axes.items() if a != axis))
    q = left_vectors(_kept(_sketch(t, axis, width, seed)))
    for _ in range(power):
        q = left_vectors(_kept(_against(t, multiply(t, {axis: q}), axis)))
    v = K.leading(blocks.gram(multiply(t, {axis: q}), axis), min(rank, q.axes["rank"]))
    return _kept(times(q, v))


def _kept(a: Blocks) -> Blocks:
    return Blocks(checkpointed(a.frame), a.axes, a.sizes)


def inner(a: Blocks, b: Blocks) -> np.ndarray:
    """A'B of two matrices whose blocks lie alike: ranks' size."""
    axis, wa, wb = next(iter(a.axes)), a.axes["rank"], b.axes["rank"]
    met = a.frame.select(axis, "data").join(b.frame.select(axis, F.col("data").alias("_other")), axis)

    def run(batches):
        total = np.zeros((wa, wb))
        for x in batches:
            for p, q in zip(x.column(1), x.column(2)):
                total += _array(p.as_py(), (-1, wa)).T @ _array(q.as_py(), (-1, wb))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["data"])

    return blocks.tree_sum(met.mapInArrow(run, "data binary"), wa * wb).reshape(wa, wb)


def signed(a: Blocks) -> Blocks:
    """Columns with their largest entry positive, the first of equals."""
    axis, width, size = next(iter(a.axes)), a.axes["rank"], a.sizes[next(iter(a.axes))]

    def run(batches):
        for (b, _), data in _rows(batches, [axis, "rank"]):
            x = _array(data, (-1, width))
            top = np.abs(x).argmax(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(b * size + top), pa.array(x[top, np.arange(width)])], names=["k", "row", "v"])

    tops = a.frame.mapInArrow(run, "k long, row long, v double").groupBy("k").agg(F.max_by("v", F.struct(F.abs("v"), -F.col("row"))).alias("v")).collect()
    sign = np.ones(width)
    for r in tops:
        sign[r["k"]] = -1.0 if r["v"] < 0 else 1.0
    return times(a, np.diag(sign))


# --- smoothing by a Laplacian ---------------------------------------------------------------------


def edge_blocks(matrix: DataFrame, size: int) -> DataFrame:
    """A sparse matrix (src, dst, l) as rows (to, of, i, j, l): entries of a block of rows and a block of columns."""
    import pandas as pd

    keyed = matrix.select(F.floor(F.col("src") / size).cast("int").alias("to"), F.floor(F.col("dst") / size).cast("int").alias("of"), (F.col("src") % size).cast("int").alias("i"), (F.col("dst") % size).cast("int").alias("j"), F.col("l").cast("double").alias("l"))

    def run(t: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"to": [int(t["to"].iloc[0])], "of": [int(t["of"].iloc[0])], "i": [t["i"].to_numpy(np.int32).tobytes()], "j": [t["j"].to_numpy(np.int32).tobytes()], "l": [t["l"].to_numpy(float).tobytes()]})

    return checkpointed(keyed.groupBy("to", "of").applyInPandas(run, "to int, of int, i binary, j binary, l binary"))


def _apply(edges: DataFrame, x: Blocks) -> Blocks:
    """The sparse matrix times the rows of ``x``: blocks meet by number, partial results add up."""
    axis, width = next(iter(x.axes)), x.axes["rank"]
    met = edges.join(x.frame.select(F.col(axis).alias("of"), "data"), "of")
    axes, sizes = x.axes, x.sizes

    def run(batches):
        def out():
            for b in batches:
                to = b.column(b.schema.get_field_index("to")).to_numpy()
                parts = [b.column(b.schema.get_field_index(c)) for c in ("i", "j", "l", "data")]
                for k in range(b.num_rows):
                    i, j, l, data = (p[k].as_py() for p in parts)
                    i, j, l = np.frombuffer(i, np.int32), np.frombuffer(j, np.int32), np.frombuffer(l, np.float64)
                    y = np.zeros(shape(axes, sizes, (int(to[k]), 0)))
                    np.add.at(y, i, l[:, None] * _array(data, (-1, width))[j])
                    yield (int(to[k]), 0), y

        yield from _held_sums(out(), [axis, "rank"])

    return Blocks(summed(met.mapInArrow(run, _schema([axis, "rank"])), axes, sizes), axes, sizes)


def smooth_solve(edges: DataFrame, rhs: Blocks, alpha: float, beta: np.ndarray, rounds: int = 100, tol: float = 1e-6) -> Blocks:
    """Conjugate gradients for (beta_k I + alpha L'L) u_k = rhs_k, all columns at once; L, symmetric, as ``edge_blocks``. Each round is two
    products with L, and two sums a column for the driver; a column that is solved stands still."""
    axis, width = next(iter(rhs.axes)), rhs.axes["rank"]
    ddl = f"{axis} int, u binary, r binary, p binary"

    def start(batches):
        for (b, _), data in _rows(batches, [axis, "rank"]):
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([bytes(len(data))], pa.binary()), pa.array([data], pa.binary()), pa.array([data], pa.binary())], names=[axis, "u", "r", "p"])

    state, held = rhs.frame.mapInArrow(start, ddl), None
    rr = np.diag(inner(rhs, rhs)).copy()
    for _ in range(rounds):
        live = np.sqrt(rr) >= tol
        if not live.any():
            break
        p = Blocks(state.select(axis, F.lit(0).alias("rank"), F.col("p").alias("data")), rhs.axes, rhs.sizes)
        twice = _apply(edges, _apply(edges, p))
        met = state.join(twice.frame.select(axis, F.col("data").alias("q")), axis, "left")

        def with_q(batches):
            for b in batches:
                for k in range(b.num_rows):
                    p, q = b.column(3)[k].as_py(), b.column(4)[k].as_py()
                    full = _array(p, (-1, width)) * beta
                    if q is not None:
                        full = full + alpha * _array(q, (-1, width))
                    yield pa.RecordBatch.from_arrays([b.column(0)[k : k + 1], b.column(1)[k : k + 1], b.column(2)[k : k + 1], b.column(3)[k : k + 1], pa.array([full.tobytes()], pa.binary())], names=[axis, "u", "r", "p", "q"])

        state = checkpointed(met.mapInArrow(with_q, ddl + ", q binary"))
        release(held)
        held = state

        def sums(batches, make):
            total = np.zeros(width)
            for b in batches:
                for k in range(b.num_rows):
                    total += make(*(_array(b.column(c)[k].as_py(), (-1, width)) for c in (2, 3, 4))).sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["data"])

        pq = blocks.tree_sum(state.mapInArrow(lambda it: sums(it, lambda r, p, q: p * q), "data binary"), width)
        a = np.where(live & (pq > 0), rr / np.where(pq > 0, pq, 1.0), 0.0)
        # The new residuals themselves, not a recurrence, whose rounding would grow.
        new = blocks.tree_sum(state.mapInArrow(lambda it, a=a: sums(it, lambda r, p, q: (r - a * q) ** 2), "data binary"), width)
        again = np.where(live & (rr > 0), new / np.where(rr > 0, rr, 1.0), 0.0)

        def step(batches, a=a, again=again):
            for b in batches:
                for k in range(b.num_rows):
                    u, r, p, q = (_array(b.column(c)[k].as_py(), (-1, width)) for c in (1, 2, 3, 4))
                    r = r - a * q
                    yield pa.RecordBatch.from_arrays([b.column(0)[k : k + 1], *[pa.array([x.tobytes()], pa.binary()) for x in (u + a * p, r, r + again * p)]], names=[axis, "u", "r", "p"])

        state, rr = state.mapInArrow(step, ddl), new
    out = checkpointed(state.select(axis, F.lit(0).alias("rank"), F.col("u").alias("data")))
    release(held)
    return Blocks(out, rhs.axes, rhs.sizes)


# --- decompositions ---------------------------------------------------------------------------------


def tucker(t: Blocks, ranks, long: tuple[str, ...], laplacians: dict[str, DataFrame] | None = None, alpha: float = 0.01, epsilon: float = 1e-2, rounds: int = 10) -> tuple[np.ndarray, dict, float]:
    """(core, factors, error). The factors of the axes in ``long`` are tables of rows, the others arrays. Axes with a Laplacian
    (src, dst, l over the axis' entries), which have to be among the long ones, are smoothed: column j of such a factor solves
    (alpha L'L + |g_j|^2 I) u = (Y G')_j, then the columns are made orthonormal, as ``kernels.geometry_tucker`` does."""
    names, laplacians = list(t.axes), laplacians or {}
    if set(laplacians) - set(long):
        raise ValueError("an axis with a Laplacian has to be a long one")
    ranks = dict(zip(names, K.validate_ranks(ranks, list(t.axes.values()))))
    edges = {a: edge_blocks(m, t.sizes[a]) for a, m in laplacians.items()}
    t = _kept(t)
    total = blocks.norm2(t)
    factors: dict = {a: leading(t, a, ranks[a]) if a in long else K.leading(blocks.gram(t, a), ranks[a]) for a in names}
    before, core, error = None, None, 0.0
    for _ in range(rounds):
        for a in names:
            part = multiply(t, {n: u for n, u in factors.items() if n != a})
            if a not in long:
                factors[a] = K.leading(blocks.gram(part, a), ranks[a])
                continue
            matrix = _kept(tall(part, a))
            if a in edges:
                g = inner(factors[a], matrix)
                u = smooth_solve(edges[a], times(matrix, g.T), alpha, (g * g).sum(axis=1) + 1e-12)
                factors[a] = _kept(orthonormal(u))
            else:
                factors[a] = _kept(left_vectors(matrix, ranks[a]))
        core = blocks.small(multiply(t, factors))
        error = float(np.sqrt(max(0.0, total - float(np.vdot(core, core))) / total)) if total else 0.0
        if before is not None and abs(before - error) < epsilon:
            break
        before = error
    factors = {a: _kept(signed(u)) if isinstance(u, Blocks) else K.signed(u) for a, u in factors.items()}
    return blocks.small(multiply(t, factors)), factors, error


def reconstruct(spark, core: np.ndarray, factors: dict) -> Blocks:
    """The tensor of a core, arrays and tables of factor rows."""
    axes = dict(zip(factors, core.shape))
    t = Blocks(spark.createDataFrame([(*[0] * core.ndim, np.ascontiguousarray(core, np.float64).tobytes())], _schema(list(axes))), axes, dict(axes))
    return multiply(t, factors, False)
