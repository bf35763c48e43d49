"""Approximate nearest neighbours by learned partitions.

A neighbour graph over a bounded sample is cut into balanced parts; a small classifier
learns the parts from the vectors. Every row goes to the part of its highest probability;
a query visits the most probable parts and all rows there are reranked by their exact
inner products. How many parts it visits is measured: the fewest at which a bounded set of
calibration queries, which the classifier hasn't seen, reach the recall asked for, compared
with all rows by brute force. Queries that this leaves with fewer than k rows visit all parts.

The number of parts grows with the rows, up to what the sample can tell apart (a part a 32
of its rows). The calibration queries (``CALIBRATION``) and the sample (``SAMPLE`` rows) are the
first in the order of a hash. Inner products that overflow are infinite and rank so; those that
aren't numbers rank last. Vectors that are null, zero, of another length than the first of the
sample, or hold null or non-finite components take no part. Ties go to the smaller vec_id;
of repeated vec_ids each row counts; a row is no neighbour of its own vec_id.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldspark.llm import store

SAMPLE, CALIBRATION, PARTS, GRAPH_K = 4096, 256, 16, 10
RECALL, NEIGHBOURS, QUERY_EVERY = 0.94, 20, 20
ROWS_A_BLOCK = 4096


def parts_for(rows: int, sample: int) -> int:
    """As many parts as the square root of the rows / 8, a power of two, PARTS at least where the sample allows it."""
    wanted = max(PARTS, 1 << max(0, round(math.log2(max(1.0, math.sqrt(rows) / 8)))))
    return max(1, min(wanted, sample // 32))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(1e-300, np.linalg.norm(x, axis=1, keepdims=True))


def neighbour_graph(x: np.ndarray, k: int = GRAPH_K) -> np.ndarray:
    """Symmetric weights (as a dense matrix over the sample) of each row's k nearest."""
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    k = min(k, len(x) - 1)
    w = np.zeros(s.shape, np.float32)
    if k > 0:
        near = np.argpartition(-s, k - 1, axis=1)[:, :k]
        w[np.repeat(np.arange(len(x)), k), near.ravel()] = 1
    return np.maximum(w, w.T)


def bisect(w: np.ndarray, x: np.ndarray, parts: int) -> np.ndarray:
    """Balanced parts of equal size (but for one row) by recursive bisection: a spectral order
    of the graph, split at the median, then swaps of the pairs that cut fewer edges."""
    out = np.zeros(len(w), np.int64)
    if parts < 2 or len(w) < 2 * parts:
        return out
    d = np.maximum(1.0, w.sum(axis=1))
    v = x @ np.random.default_rng(7).standard_normal(x.shape[1])
    for _ in range(40):  # second eigenvector of the random walk
        v = v - (d @ v) / d.sum()
        v = 0.5 * (v + (w @ v) / d)
        v /= max(1e-300, np.linalg.norm(v))
    side = np.zeros(len(w), bool)
    side[np.argsort(v, kind="stable")[len(v) // 2 :]] = True
    for _ in range(20):
        to = w @ side.astype(np.float32)
        gain = np.where(side, w.sum(axis=1) - 2 * to, 2 * to - w.sum(axis=1))  # edges no longer cut if it moves
        a, b = np.flatnonzero(~side), np.flatnonzero(side)
        a, b = a[np.argsort(-gain[a], kind="stable")], b[np.argsort(-gain[b], kind="stable")]
        n = min(len(a), len(b))
        good = gain[a[:n]] + gain[b[:n]] > 2
        m = min(int(good.sum()), max(1, n // 20))
        if not m:
            break
        side[a[:m]], side[b[:m]] = True, False
    half = parts // 2
    for chosen, count, base in ((~side, parts - half, 0), (side, half, parts - half)):
        at = np.flatnonzero(chosen)
        out[at] = base + bisect(w[np.ix_(at, at)], x[at], count)
    return out


@dataclass
class Index:
    width: int
    weights: np.ndarray  # of the classifier: (width + 1, parts)
    probes: int = 1
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return _unit(x) @ self.weights[:-1] + self.weights[-1]


def classify(x: np.ndarray, y: np.ndarray, parts: int, rounds: int = 150, ridge: float = 1e-3) -> np.ndarray:
    """Softmax regression by gradient descent with momentum."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w, v = np.zeros((x1.shape[1], parts)), 0.0
    one = np.eye(parts)[y]
    for _ in range(rounds):
        z = x1 @ w
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        v = 0.9 * v - 4.0 * (x1.T @ (p - one) / len(x) + ridge * w)
        w = w + v
    return w


def usable(rows: DataFrame) -> DataFrame:
    """vec_id and v (array<double>) of the rows that take part, but for their length."""
    v = F.col("embedding").cast("array<double>")
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    bad = F.exists("v", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return rows.filter(~bad & F.exists("v", lambda e: e != 0.0))


def _matrix(batch, column: int = 1) -> np.ndarray:
    c = batch.column(column)
    return pc.list_flatten(c).to_numpy(zero_copy_only=False).reshape(len(c), -1) if len(c) else np.zeros((0, 0))


def exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, summed in the order of the components, so equal vectors give equal values."""
    s = np.zeros(len(q))
    for d in range(q.shape[1]):
        s += q[:, d] * c[:, d]
    return s


def nearest(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query its k best candidates of other ids: (query's place, vec_id, score)."""
    out: list[tuple] = []
    with np.errstate(all="ignore"):  # how far a sum may be off in another order
        norm = np.linalg.norm(q, axis=1) * np.max(np.linalg.norm(c, axis=1), initial=0.0)
    for at in range(0, len(q), 256):
        with np.errstate(all="ignore"):  # products may overflow
            rough = np.nan_to_num(q[at : at + 256] @ c.T, nan=-np.inf, posinf=np.inf, neginf=-np.inf)
            own = qid[at : at + 256, None] == cid[None, :]
            rough[own] = -np.inf
            kk = min(k, rough.shape[1])
            low = -np.partition(-rough, kk - 1, axis=1)[:, kk - 1] - 1e-12 * norm[at : at + 256]
            i, j = np.nonzero((rough >= np.where(np.isfinite(low), low, -np.inf)[:, None]) & ~own)
            s = np.nan_to_num(exact(q[at + i], c[j]), nan=-np.inf, posinf=np.inf, neginf=-np.inf)
        order = np.lexsort((cid[j], -s, i))
        i, j, s = i[order], j[order], s[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i, side="left")
        keep = rank < k
        out.append((at + i[keep], cid[j[keep]], s[keep]))
    return tuple(np.concatenate([o[n] for o in out]) for n in range(3)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def fit(rows: DataFrame, parts: int | None = None, recall: float = RECALL, k: int = NEIGHBOURS) -> Index | None:
    """Index of usable rows (vec_id, v); None if there are none."""
    spark = rows.sparkSession
    h = F.xxhash64(F.lit("ann"), F.col("vec_id"))
    few = rows.orderBy(h, "vec_id").limit(CALIBRATION + SAMPLE).toPandas()
    if not len(few):
        return None
    width = len(few["v"].iloc[0])
    few = few[few["v"].map(len) == width]
    all_, ids = np.array(few["v"].tolist(), float).reshape(len(few), width), few["vec_id"].to_numpy()
    apart = min(CALIBRATION, len(few) // 8)  # calibration queries, which are not fitted on
    x = _unit(all_[apart:])
    y = bisect(neighbour_graph(x), x, parts or parts_for(rows.count(), len(x)))
    index = Index(width, classify(x, y, int(y.max()) + 1))
    q, qid = all_[:apart], ids[:apart]
    shared = spark.sparkContext.broadcast((index, q, qid))  # of CALIBRATION rows

    def brute(batches):
        index, q, qid = shared.value
        for b in batches:
            c, cid = _matrix(b), b.column(0).to_numpy()
            if len(c):
                i, j, s = nearest(qid, q, cid, c, k)
                home = dict(zip(cid.tolist(), index.logits(c).argmax(axis=1).tolist()))
                yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(s), pa.array([home[x] for x in j.tolist()], pa.int64())], names=["q", "vec_id", "score", "part"])

    # Each batch leaves k rows a calibration query; the best k are taken where all of a query's meet.
    found = store.in_arrow(rows.filter(F.size("v") == width), brute, "q long, vec_id long, score double, part long")
    best = found.groupBy("q").applyInPandas(lambda t: t.sort_values(["score", "vec_id"], ascending=[False, True]).head(k), "q long, vec_id long, score double, part long").toPandas()
    order = np.argsort(-index.logits(q), axis=1, kind="stable")
    place = np.argsort(order, axis=1)[best["q"].to_numpy(), best["part"].to_numpy()] if len(best) else np.zeros(0)
    for m in range(1, order.shape[1] + 1):
        index.probes = m
        if len(place) and (place < m).mean() >= recall:
            break
    return index


def search(rows: DataFrame, queries: DataFrame, index: Index, k: int = NEIGHBOURS) -> DataFrame:
    """query_id, rank, vec_id, score. Rows lie in blocks of a part, of ROWS_A_BLOCK rows on average, so
    a part with many rows is spread; a query goes to every block of the parts it visits."""
    rows, queries = (t.filter(F.size("v") == index.width) for t in (rows, queries))
    homes = store.table(_placed(rows, index, 1), "homes")
    found = store.table(_best(homes, _placed(queries, index, index.probes), k), "found")
    few = found.groupBy("query_id").agg(F.count("*").alias("n"))
    # A query of few candidates, which parts of uneven size may give, is searched again in all parts.
    short = queries.join(few, F.col("vec_id") == F.col("query_id"), "left").filter(F.coalesce("n", F.lit(0)) < k).select("vec_id", "v")
    short = store.table(short, "short")
    if index.probes < index.weights.shape[1] and short.limit(1).count():
        again = _best(homes, _placed(short, index, index.weights.shape[1]), k)
        found = found.join(short.select(F.col("vec_id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(again)
    return found


def _placed(rows: DataFrame, index: Index, probes: int) -> DataFrame:
    """vec_id, v, part: each row once for each of its ``probes`` most probable parts."""
    shared = rows.sparkSession.sparkContext.broadcast(index)

    def run(batches):
        index = shared.value
        m = min(probes, index.weights.shape[1])
        for b in batches:
            x = _matrix(b)
            if len(x):
                top = np.argsort(-index.logits(x), axis=1, kind="stable")[:, :m]
                take = pa.array(np.repeat(np.arange(len(x)), m))
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(top.ravel().astype(np.int32))], names=["vec_id", "v", "part"])

    return store.in_arrow(rows, run, "vec_id long, v array<double>, part int")


def _best(homes: DataFrame, placed: DataFrame, k: int) -> DataFrame:
    """The k best of each query among the rows of the parts it was placed in."""
    blocks = F.broadcast(homes.groupBy("part").agg(F.ceil(F.count("*") / F.lit(ROWS_A_BLOCK)).cast("int").alias("blocks")))  # a row a part
    left = homes.join(blocks, "part").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")).drop("blocks")
    right = placed.join(blocks, "part").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")

    def best(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(queries):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        qid = queries["vec_id"].to_numpy()
        i, j, s = nearest(qid, np.stack(queries["v"].to_numpy()).astype(float), rows["vec_id"].to_numpy(), np.stack(rows["v"].to_numpy()).astype(float), k)
        return pd.DataFrame({"query_id": qid[i], "vec_id": j, "score": s})

    found = left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInPandas(best, "query_id long, vec_id long, score double")
    # A query has k rows of each block it visited; the ranks are limited before and after the shuffle, in sorted runs.
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def neighbours(rows: DataFrame, every: int = QUERY_EVERY, k: int = NEIGHBOURS) -> DataFrame:
    """The k nearest of each row whose vec_id is divisible by ``every``."""
    ready = usable(rows)
    index = fit(ready, k=k)
    if index is None:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return search(ready, ready.filter(F.col("vec_id") % every == 0), index, k)
