"""Tensors as tables of dense blocks.

A row is a block: its number along each axis (int columns named as the axes) and ``data``, its entries row-major as
float64 bytes. Blocks have ``sizes`` entries along the axes, fewer at the ends; blocks that hold only zeros need not be
there. Tasks read a block at a time, so what they hold is bounded by the block size, a factor's rows and one result; sums of
blocks are combined in a task for HELD blocks, then by key in sorted runs, a block at a time.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldspark.functions import kernels as K

#: Entries of a block where no sizes are given, blocks a task sums before it hands them on.
ENTRIES, HELD = 1 << 16, 64


@dataclass
class Blocks:
    frame: DataFrame
    axes: dict[str, int]
    sizes: dict[str, int]

    def counts(self) -> dict[str, int]:
        """Blocks along each axis."""
        return {a: -(-n // self.sizes[a]) for a, n in self.axes.items()}

    def schema(self) -> str:
        return _schema(list(self.axes))


def _schema(axes: list[str]) -> str:
    return ", ".join([*[f"{a} int" for a in axes], "data binary"])


def span(axes: dict[str, int], sizes: dict[str, int], axis: str, block: int) -> tuple[int, int]:
    return block * sizes[axis], min(axes[axis], (block + 1) * sizes[axis])


def shape(axes: dict[str, int], sizes: dict[str, int], at: tuple[int, ...]) -> tuple[int, ...]:
    return tuple(e - s for s, e in (span(axes, sizes, a, b) for a, b in zip(axes, at)))


def even_sizes(axes: dict[str, int], entries: int = ENTRIES) -> dict[str, int]:
    """Block sizes of about so many entries: the longest sides are halved first."""
    sizes = dict(axes)
    while math.prod(sizes.values()) > entries:
        longest = max(sizes, key=lambda a: sizes[a])
        sizes[longest] = -(-sizes[longest] // 2)
    return sizes


def _array(data: bytes, dims: tuple[int, ...]) -> np.ndarray:
    return np.frombuffer(data, np.float64).reshape(dims)


def _rows(batches, axes: list[str]) -> Iterator[tuple[tuple[int, ...], bytes]]:
    for b in batches:
        columns = [b.column(b.schema.get_field_index(a)).to_numpy() for a in axes]
        data = b.column(b.schema.get_field_index("data"))
        for i in range(b.num_rows):
            yield tuple(int(c[i]) for c in columns), data[i].as_py()


def _batch(at: tuple[int, ...], x: np.ndarray, axes: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*[pa.array([i], pa.int32()) for i in at], pa.array([np.ascontiguousarray(x, np.float64).tobytes()], pa.binary())], names=[*axes, "data"])


def _sum_runs(batches, axes: list[str], dims: Callable) -> Iterator[pa.RecordBatch]:
    """Sums of the blocks of a key, in batches sorted by key."""
    key, total = None, None
    for at, data in _rows(batches, axes):
        if at != key:
            if key is not None:
                yield _batch(key, total, axes)
            key, total = at, np.zeros(dims(at))
        total += _array(data, total.shape)
    if key is not None:
        yield _batch(key, total, axes)


def summed(frame: DataFrame, axes: dict[str, int], sizes: dict[str, int]) -> DataFrame:
    """Blocks of equal places added up."""
    names = list(axes)
    if not names:
        names, axes, sizes = ["_all"], {"_all": 1}, {"_all": 1}
    dealt = frame.repartition(*names).sortWithinPartitions(*names)
    return dealt.mapInArrow(lambda it: _sum_runs(it, names, lambda at: shape(axes, sizes, at)), _schema(names))


def from_coo(coo: DataFrame, axes: dict[str, int], sizes: dict[str, int] | None = None) -> Blocks:
    """Blocks of a coordinate table (axes..., v); entries of one place add up, nulls count as 0."""
    sizes = sizes or even_sizes(axes)
    names = list(axes)
    inner = reduce(lambda a, n: a * F.lit(sizes[n]) + F.col(n) % sizes[n], names, F.lit(0).cast("long"))
    keyed = coo.select(*[F.floor(F.col(a) / sizes[a]).cast("int").alias(a) for a in names], inner.alias("_at"), F.coalesce(F.col("v").cast("double"), F.lit(0.0)).alias("v"))
    dealt = keyed.repartition(*names).sortWithinPartitions(*names)
    full = tuple(sizes.values())

    def run(batches):
        key, x = None, None

        def out():
            return _batch(key, x.reshape(full)[tuple(slice(0, n) for n in shape(axes, sizes, key))], names)

        for b in batches:
            if not b.num_rows:
                continue
            at = np.stack([b.column(i).to_numpy() for i in range(len(names))], axis=1)
            cut = [0, *(np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1).tolist(), len(at)]
            for s, e in zip(cut[:-1], cut[1:]):
                now = tuple(int(i) for i in at[s])
                if now != key:
                    if key is not None:
                        yield out()
                    key, x = now, np.zeros(math.prod(full))
                np.add.at(x, b.column(len(names))[s:e].to_numpy(), b.column(len(names) + 1)[s:e].to_numpy())
        if key is not None:
            yield out()

    return Blocks(dealt.mapInArrow(run, _schema(names)), dict(axes), sizes)


def to_coo(t: Blocks, zeros: bool = False) -> DataFrame:
    """axes..., v of all entries that aren't 0, or of all in the blocks that are there."""
    axes, sizes, names = t.axes, t.sizes, list(t.axes)

    def run(batches):
        for at, data in _rows(batches, names):
            x = _array(data, shape(axes, sizes, at))
            where = np.indices(x.shape).reshape(len(names), -1) if zeros else np.stack(np.nonzero(x))
            yield pa.RecordBatch.from_arrays([*[pa.array((i + b * sizes[a]).astype(np.int32)) for i, b, a in zip(where, at, names)], pa.array(x[tuple(where)])], names=[*names, "v"])

    return t.frame.mapInArrow(run, ", ".join([*[f"{a} int" for a in names], "v double"]))


def reblock(t: Blocks, sizes: dict[str, int]) -> Blocks:
    """The same tensor in blocks of other sizes: each block is cut along the new borders, then pieces of a block meet."""
    axes, old, names = t.axes, t.sizes, list(t.axes)
    if sizes == old:
        return t

    def run(batches):
        for at, data in _rows(batches, names):
            x = _array(data, shape(axes, old, at))
            starts = [span(axes, old, a, b)[0] for a, b in zip(names, at)]
            ends = [span(axes, old, a, b)[1] for a, b in zip(names, at)]
            for cell in np.ndindex(*[(e - 1) // sizes[a] - s // sizes[a] + 1 for a, s, e in zip(names, starts, ends)]):
                to = tuple(s // sizes[a] + c for a, s, c in zip(names, starts, cell))
                area = [span(axes, sizes, a, b) for a, b in zip(names, to)]
                whole = np.zeros([e - s for s, e in area])
                both = [(max(s, u), min(e, w)) for s, e, (u, w) in zip(starts, ends, area)]
                whole[tuple(slice(u - s, w - s) for (u, w), (s, _) in zip(both, area))] = x[tuple(slice(u - s, w - s) for (u, w), s in zip(both, starts))]
                yield _batch(to, whole, names)

    return Blocks(summed(t.frame.mapInArrow(run, _schema(names)), axes, sizes), dict(axes), dict(sizes))


def _held_sums(rows: Iterator[tuple[tuple, np.ndarray]], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Blocks added up by place within a task, HELD places at a time."""
    held: dict[tuple, np.ndarray] = {}
    for at, x in rows:
        if at in held:
            held[at] = held[at] + x
        else:
            if len(held) >= HELD:
                for k, y in held.items():
                    yield _batch(k, y, names)
                held = {}
            held[at] = x
    for k, y in held.items():
        yield _batch(k, y, names)


def multiply(t: Blocks, factors: dict[str, np.ndarray], transpose: bool = True) -> Blocks:
    """Mode products along several axes: with ``transpose`` an axis' rows become ranks, else the other way round. Each block meets
    the factors' rows of its own places; blocks along a contracted axis add up. New axes have one block where they shrink."""
    axes, sizes, names = t.axes, t.sizes, list(t.axes)
    to = {a: (factors[a].shape[1] if transpose else factors[a].shape[0]) if a in factors else n for a, n in axes.items()}
    to_sizes = {a: (to[a] if transpose else min(to[a], max(1, sizes[a]))) if a in factors else sizes[a] for a in names}
    shared, turned = t.frame.sparkSession.sparkContext.broadcast(factors), set(factors)  # axis x rank numbers each
    parts = [-(-to[a] // to_sizes[a]) if a in factors else 1 for a in names]

    def run(batches):
        def rows():
            for at, data in _rows(batches, names):
                x = _array(data, shape(axes, sizes, at))
                if transpose:
                    for m, a in enumerate(names):
                        if a in turned:
                            s, e = span(axes, sizes, a, at[m])
                            x = K.mode_dot(x, shared.value[a][s:e].T, m)
                    yield tuple(0 if a in turned else b for a, b in zip(names, at)), x
                    continue
                for cell in np.ndindex(*parts):
                    y = x
                    for m, a in enumerate(names):
                        if a in turned:
                            s, e = span(axes, sizes, a, at[m])
                            u, w = span(to, to_sizes, a, cell[m])
                            y = K.mode_dot(y, shared.value[a][u:w, s:e], m)
                    yield tuple(c if a in turned else b for a, b, c in zip(names, at, cell)), y

        yield from _held_sums(rows(), names)

    return Blocks(summed(t.frame.mapInArrow(run, _schema(names)), to, to_sizes), to, to_sizes)


def gram(t: Blocks, axis: str) -> np.ndarray:
    """The Gram matrix of the unfolding along an axis, which is made whole in each block first: a partial matrix a task, added up
    in a tree, so the driver takes one matrix."""
    if t.sizes[axis] < t.axes[axis]:
        others = even_sizes({a: n for a, n in t.axes.items() if a != axis}, max(1, ENTRIES // t.axes[axis]))
        t = reblock(t, {a: others.get(a, n) for a, n in t.axes.items()})
    axes, sizes, names, m, n = t.axes, t.sizes, list(t.axes), list(t.axes).index(axis), t.axes[axis]

    def run(batches):
        total, some = np.zeros((n, n)), False
        for at, data in _rows(batches, names):
            x = K.unfold(_array(data, shape(axes, sizes, at)), m)
            total += x @ x.T
            some = True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["data"])

    return tree_sum(t.frame.mapInArrow(run, "data binary"), n * n).reshape(n, n)


def tasks_of(spark: SparkSession) -> int:
    """About how many tasks a stage has."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def tree_sum(parts: DataFrame, length: int, fan: int = 16) -> np.ndarray:
    """The sum of arrays (data, float64 bytes) of one length, by rounds that merge ``fan`` partitions each, until one is left."""
    left = tasks_of(parts.sparkSession)

    def add(batches):
        total = None
        for b in batches:
            for x in b.column(0):
                y = np.frombuffer(x.as_py(), np.float64)
                total = y.copy() if total is None else total + y
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["data"])

    while left > 1:
        left = -(-left // fan)
        parts = parts.repartition(left).mapInArrow(add, "data binary")
    rows = parts.collect()
    return sum((np.frombuffer(r[0], np.float64) for r in rows), np.zeros(length))


def norm2(t: Blocks) -> float:
    def run(batches):
        total = sum(float(np.vdot(x, x)) for x in (np.frombuffer(d, np.float64) for _, d in _rows(batches, [])))
        yield pa.RecordBatch.from_arrays([pa.array([total])], names=["n"])

    return float(t.frame.mapInArrow(run, "n double").agg(F.sum("n")).first()[0] or 0.0)


def small(t: Blocks) -> np.ndarray:
    """A tensor of few blocks (a core) as an array on the driver."""
    out = np.zeros(tuple(t.axes.values()))
    for r in t.frame.collect():
        at = tuple(r[a] for a in t.axes)
        out[tuple(slice(*span(t.axes, t.sizes, a, b)) for a, b in zip(t.axes, at))] = _array(r["data"], shape(t.axes, t.sizes, at))
    return out


def reconstruct(spark: SparkSession, core: np.ndarray, factors: dict[str, np.ndarray], sizes: dict[str, int] | None = None) -> Blocks:
    """The tensor of a core and a factor an axis. Each block is made where it is needed, from the factors' rows of its own places:
    nothing is shuffled."""
    axes = {a: len(u) for a, u in factors.items()}
    sizes = sizes or even_sizes(axes)
    names, counts = list(axes), [-(-n // sizes[a]) for a, n in axes.items()]
    shared = spark.sparkContext.broadcast((core, factors))

    def run(batches):
        core, factors = shared.value
        for b in batches:
            for i in b.column(0).to_pylist():
                at = tuple(int(x) for x in np.unravel_index(i, counts))
                yield _batch(at, K.multi_dot(core, [factors[a][slice(*span(axes, sizes, a, k))] for a, k in zip(names, at)]), names)

    return Blocks(spark.range(math.prod(counts)).mapInArrow(run, _schema(names)), axes, sizes)


def tucker(t: Blocks, ranks, epsilon: float = 1e-2, rounds: int = 10) -> tuple[np.ndarray, dict[str, np.ndarray], float]:
    """(core, factors, error) by higher-order orthogonal iteration over blocks, as ``decomposition.distributed`` over coordinates.
    A contraction along all axes but one leaves few blocks; the driver sees Gram matrices and the core."""
    names = list(t.axes)
    ranks = K.validate_ranks(ranks, list(t.axes.values()))
    total = norm2(t)
    factors = {a: K.leading(gram(t, a), r) for a, r in zip(names, ranks)}
    before, core, error = None, None, 0.0
    for _ in range(rounds):
        for a, r in zip(names, ranks):
            part = multiply(t, {n: u for n, u in factors.items() if n != a})
            factors[a] = K.leading(gram(part, a), r)
        core = small(multiply(t, factors))
        error = float(np.sqrt(max(0.0, total - float(np.vdot(core, core))) / total)) if total else 0.0
        if before is not None and abs(before - error) < epsilon:
            break
        before = error
    return core, factors, error
