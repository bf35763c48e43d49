"""Tucker decompositions of coordinate tables.

Many subjects: one numpy decomposition a subject. One large tensor: Gram matrices by
distributed sums and contractions by joins, only the small factors on the driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldspark.functions import kernels as K
from fieldspark.operators import sensing, tensor
from fieldspark.operators.cut import checkpointed


def dense(t: pd.DataFrame, axes: dict[str, int]) -> np.ndarray:
    x = np.zeros(tuple(axes.values()))
    np.add.at(x, tuple(t[a].to_numpy() for a in axes), t["v"].to_numpy(float))
    return x


RESULT = "part string, mode int, row int, rank int, value double"


def _rows(r: K.Tucker, x: np.ndarray) -> pd.DataFrame:
    parts = [pd.DataFrame({"part": "error", "mode": [-1, -2], "row": 0, "rank": 0, "value": [r.error(x), float(r.iterations)]})]
    parts.append(pd.DataFrame({"part": "core", "mode": -1, "row": np.arange(r.core.size), "rank": 0, "value": r.core.ravel()}))
    for m, u in enumerate(r.factors):
        i, j = np.indices(u.shape)
        parts.append(pd.DataFrame({"part": "factor", "mode": m, "row": i.ravel(), "rank": j.ravel(), "value": u.ravel()}))
    return pd.concat(parts)


def per_subject(coo: DataFrame, axes: dict[str, int], ranks=None, epsilon: float = 1e-2, edges: tuple | None = None, alpha: float = 0.01, spatial=(0,)) -> DataFrame:
    """Every subject's factors, core (row-major) and error; with ``edges`` (src, dst, entry) of a
    Laplacian the spatial factors are smoothed. A subject has to fit a task."""
    K.validate_ranks(ranks, list(axes.values()))

    def run(t: pd.DataFrame) -> pd.DataFrame:
        x = dense(t, axes)
        r = K.tucker(x, ranks, epsilon) if edges is None else K.geometry_tucker(x, ranks, edges, alpha, spatial, epsilon)
        out = _rows(r, x)
        out.insert(0, "subject", t["subject"].iloc[0])
        return out

    return coo.groupBy("subject").applyInPandas(run, f"subject string, {RESULT}")


#: Rows of a long axis whose R factor is one task's, and R factors that one task merges.
LONG_BLOCK, FAN = 1024, 16


def per_subject_long(coo: DataFrame, axes: dict[str, int], ranks=None, epsilon: float = 1e-2, block: int = LONG_BLOCK) -> DataFrame:
    """``per_subject`` where the first axis is too long for a task. With X = Q R of the unfolding along it, orthogonal iteration on R
    gives the core and the other factors, and Q times R's first factor is that of X: rows times a small matrix. R comes from QRs of blocks of rows,
    merged in a tree; a task holds a block or a few R, whose width is the product of the other axes. A few numbers a subject, as
    many as that width times the first rank, go to the tasks."""
    spark, (long, *others) = coo.sparkSession, list(axes)
    ranks = K.validate_ranks(ranks, list(axes.values()))
    shape, r0, n = [axes[a] for a in others], ranks[0], axes[long]
    width = int(np.prod(shape))
    flat = tensor.flatten(coo, {a: axes[a] for a in others}, "_col") if len(others) > 1 else coo.withColumnRenamed(others[0], "_col")
    tubes = checkpointed(tensor.tubes(flat, ["subject", long], width, "_col"))
    piece = "subject string, _b long, r binary"

    def stacked(t: pd.DataFrame) -> np.ndarray:
        return np.concatenate([np.frombuffer(x).reshape(-1, width) for x in sorted(t["r"])])

    def packed(t: pd.DataFrame, a: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"subject": t["subject"].iloc[:1], "_b": t["_b"].iloc[:1] // FAN, "r": [np.linalg.qr(a, mode="r").tobytes()]})

    def first(t: pd.DataFrame) -> pd.DataFrame:
        return packed(t, np.stack(t.sort_values(long)["tube"].to_numpy()))

    def merge(t: pd.DataFrame) -> pd.DataFrame:
        return packed(t, stacked(t))

    def solve(t: pd.DataFrame) -> pd.DataFrame:
        _, s, v = np.linalg.svd(stacked(t), full_matrices=False)
        rank = int((s > s[0] * 1e-13).sum())
        x = np.zeros((max(rank, r0), width))
        x[:rank] = s[:rank, None] * v[:rank]
        x = x.reshape(-1, *shape)
        found = K.tucker(x, ranks, epsilon)
        out = _rows(found, x)
        out = out[(out["part"] != "factor") | (out["mode"] != 0)]
        c = v[:rank].T / s[:rank]
        more = {"w": c @ found.factors[0][:rank]} | ({"c": c, "z": found.factors[0][rank:]} if rank < r0 else {})
        for name, m in more.items():
            i, j = np.indices(m.shape)
            out = pd.concat([out, pd.DataFrame({"part": name, "mode": 0, "row": i.ravel(), "rank": j.ravel(), "value": m.ravel()})])
        out.insert(0, "subject", t["subject"].iloc[0])
        return out

    r = tubes.withColumn("_b", F.floor(F.col(long) / F.lit(block))).groupBy("subject", "_b").applyInPandas(first, piece)
    count = -(-n // block)
    while count > FAN:
        count = -(-count // FAN)
        r = r.groupBy("subject", "_b").applyInPandas(merge, piece)
    solved = checkpointed(r.groupBy("subject").applyInPandas(solve, f"subject string, {RESULT}"))

    small = {key: t.sort_values(["row", "rank"]) for key, t in solved.filter(F.col("part").isin("w", "c", "z")).toPandas().groupby(["subject", "part"])}
    matrix = lambda t: t["value"].to_numpy().reshape(t["row"].max() + 1, -1)
    w = {key[0]: matrix(t) for key, t in small.items() if key[1] == "w"}
    add = {}
    lacking = [key[0] for key in small if key[1] == "z"]  # of lower rank than asked for: completed by vectors that are zero beyond the first rows
    if lacking:
        head = {(x["subject"], x[long]): x["tube"] for x in tubes.filter((F.col(long) < r0) & F.col("subject").isin(lacking)).collect()}
        for key in lacking:
            c = matrix(small[key, "c"]) if (key, "c") in small else np.zeros((width, 0))
            q = np.stack([head.get((key, i), np.zeros(width)) for i in range(r0)]) @ c
            add[key] = np.linalg.svd(q)[0][:, c.shape[1]:] @ matrix(small[key, "z"])

    def rows(signs):
        def run(batches):
            for t in batches:
                for key, g in t.groupby("subject"):
                    u = np.stack(g["tube"].to_numpy()) @ w[key]
                    at = g[long].to_numpy()
                    if key in add:
                        u[at < r0] += add[key][at[at < r0]]
                    yield pd.DataFrame({"subject": key, "row": np.repeat(at, r0), "rank": np.tile(np.arange(r0), len(at)), "value": (u * signs.get(key, 1.0)).ravel()})

        return every.mapInPandas(run, "subject string, row int, rank int, value double")

    every = spark.range(n).select(F.col("id").cast("int").alias(long)).crossJoin(F.broadcast(solved.select("subject").distinct()))  # a row a place
    zeros = F.array_repeat(F.lit(0.0), width)
    every = every.join(tubes, ["subject", long], "left").select("subject", long, F.coalesce("tube", zeros).alias("tube"))
    most = rows({}).groupBy("subject", "rank").agg(F.max_by("value", F.struct(F.abs("value"), -F.col("row"))).alias("v")).toPandas()
    signs = {key: np.where(g.sort_values("rank")["v"] < 0, -1.0, 1.0) for key, g in most.groupby("subject")}
    factor = rows(signs).select("subject", F.lit("factor").alias("part"), F.lit(0).alias("mode"), "row", "rank", "value")
    flips = spark.createDataFrame([(key, k, float(x)) for key, v in signs.items() for k, x in enumerate(v)], "subject string, _k int, _sign double")
    slices = F.when(F.col("part") == "core", F.floor(F.col("row") / F.lit(int(np.prod(ranks[1:]))))).cast("int").alias("_k")
    rest = solved.filter(~F.col("part").isin("w", "c", "z")).select("*", slices).join(F.broadcast(flips), ["subject", "_k"], "left")
    rest = rest.withColumn("value", F.col("value") * F.coalesce("_sign", F.lit(1.0))).drop("_k", "_sign")
    return rest.unionByName(factor)


def factor_frame(spark, u: np.ndarray) -> DataFrame:
    i, j = np.indices(u.shape)
    return spark.createDataFrame(pd.DataFrame({"row": i.ravel(), "rank": j.ravel(), "u": u.ravel()}), "row int, rank int, u double")


#: An axis beyond this has no Gram matrix that a task could sum.
LONGEST_AXIS = 8192


def _gram(coo: DataFrame, mode: str, axes: dict[str, int]) -> np.ndarray:
    """The Gram matrix of an unfolding: fibres along the axis as dense rows, a partial matrix a task."""
    if axes[mode] > LONGEST_AXIS:
        raise ValueError(f"axis {mode} has {axes[mode]} entries, more than {LONGEST_AXIS}: flatten or split it first")
    fibres = tensor.tubes(coo, [a for a in axes if a != mode], axes[mode], mode)
    return sensing.gram(fibres, axes[mode])


def distributed(coo: DataFrame, axes: dict[str, int], ranks=None, epsilon: float = 1e-2, rounds: int = 10) -> tuple[DataFrame, list[np.ndarray], float]:
    """(core table, factors, error) of one large tensor. What reaches the driver are Gram matrices of
    one axis each; errors come from norms, as the factors are orthonormal."""
    spark, names = coo.sparkSession, list(axes)
    ranks = K.validate_ranks(ranks, list(axes.values()))
    coo = coo.select(*names, "v").persist(StorageLevel.MEMORY_AND_DISK)
    norm2 = coo.agg(tensor.norm2(coo)).first()[0] or 0.0
    factors = [K.leading(_gram(coo, m, axes), r) for m, r in zip(names, ranks)]
    before, core = None, None
    for _ in range(rounds):
        for k, m in enumerate(names):
            others = {n: factor_frame(spark, factors[i]) for i, n in sorted(enumerate(names), key=lambda x: ranks[x[0]] / axes[x[1]]) if n != m}
            part = tensor.multiply(coo, others, transpose=True)
            shape = {n: axes[n] if n == m else ranks[i] for i, n in enumerate(names)}
            factors[k] = K.leading(_gram(part, m, shape), ranks[k])
        if core is not None:
            core.unpersist()
        core = tensor.multiply(coo, {n: factor_frame(spark, u) for n, u in zip(names, factors)}, transpose=True).persist(StorageLevel.MEMORY_AND_DISK)
        kept = core.agg(tensor.norm2(core)).first()[0] or 0.0
        error = float(np.sqrt(max(0.0, norm2 - kept) / norm2)) if norm2 else 0.0
        if before is not None and abs(before - error) < epsilon:
            break
        before = error
    coo.unpersist()
    return core, factors, error


def reconstruct(core: DataFrame, factors: dict[str, DataFrame]) -> DataFrame:
    return tensor.multiply(core, factors, transpose=False)


class Decomposer:
    """Decompose, then reconstruct, in that order; an error or ``reset`` is told by the state."""

    def __init__(self, axes: dict[str, int], ranks=None, epsilon: float = 1e-2):
        self.axes, self.epsilon, self.state = axes, K.validate_epsilon(epsilon), "initialized"
        self.ranks = K.validate_ranks(ranks, list(axes.values()))

    def set_ranks(self, ranks) -> None:
        if self.state != "initialized":
            raise RuntimeError("ranks can only be set before decomposing")
        self.ranks = K.validate_ranks(ranks, list(self.axes.values()))

    def reset(self) -> None:
        self.core = self.factors = self.error = None
        self.state = "initialized"

    def decompose(self, coo: DataFrame) -> "Decomposer":
        try:
            self.core, self.factors, self.error = distributed(coo, self.axes, self.ranks, self.epsilon)
        except Exception:
            self.state = "error"
            raise
        self.state = "decomposed"
        return self

    def reconstruct(self) -> DataFrame:
        if self.state not in ("decomposed", "reconstructed"):
            raise RuntimeError("decompose first")
        self.state = "reconstructed"
        spark = self.core.sparkSession
        return reconstruct(self.core, {n: factor_frame(spark, u) for n, u in zip(self.axes, self.factors)})


def modes(core: DataFrame, factors: dict[str, DataFrame]) -> DataFrame:
    """Time-insensitive modes: core (axes..., t) in the spatial factors; t numbers the modes."""
    return tensor.multiply(core, {n: u for n, u in factors.items() if n != "t"}, transpose=False)


def modes_by_subject(cores: DataFrame, factors: DataFrame, axes: list[str]) -> DataFrame:
    """The modes of every subject: cores (subject, axes..., v) with factors (subject, axis, row, rank, u); without a column
    ``subject`` there is one, named ``single_subject``. A subject without a factor for each spatial axis is an error."""
    if "subject" not in cores.columns:
        cores, factors = (x.withColumn("subject", F.lit("single_subject")) for x in (cores, factors))
    spatial = [a for a in axes if a != "t"]
    held = factors.filter(F.col("axis").isin(spatial)).groupBy("subject").agg(F.count_distinct("axis").alias("n"))
    lacking = cores.select("subject").distinct().join(held.filter(F.col("n") == len(spatial)), "subject", "left_anti").limit(1).collect()
    if lacking:
        raise ValueError(f"subject {lacking[0][0]!r} lacks a factor")
    for axis in spatial:
        u = factors.filter(F.col("axis") == axis).select("subject", F.col("rank").alias(axis), F.col("row").alias("_n"), "u")
        keep = [c for c in ("subject", *axes) if c != axis]
        cores = cores.join(u, ["subject", axis]).groupBy(*keep, F.col("_n").alias(axis)).agg(F.sum(F.col("v") * F.col("u")).alias("v"))
    return cores.select("subject", *axes, "v")


def standard_dictionary(u0: DataFrame, u1: DataFrame, width: int) -> DataFrame:
    """cell, k, v: the outer product of the k-th columns of two spatial factors."""
    b = u1.select(F.col("row").alias("_r"), "rank", F.col("u").alias("_u"))
    return u0.join(b, "rank").select((F.col("row").cast("long") * width + F.col("_r")).alias("cell"), F.col("rank").alias("k"), (F.col("u") * F.col("_u")).alias("v"))
