"""Hard negatives: for each anchor and each of its nearest rows of the same label, the nearest rows of other labels whose score
lies in a window below that positive's.

Components are integers, floor(SCALE x), so scores are exact. Rows lie in blocks, range-partitioned by label and by their largest
component; each block is one or more tasks' ball tree, whose nodes (centre, radius, least and largest label) bound the
inner products with an anchor both above and below. A node is pruned if its bounds lie outside the query's window, if they are
strictly beneath the query's current k-th score, or by its labels. A query first visits the block that looks best
to it; with the k-th score found there it goes to those other blocks only whose own balls may hold something better. The driver
and tasks see one ball a block, of BLOCKS at most: blocks of at least ROWS rows grow with the table beyond that. Queries of a block
come in chunks of CHUNK, so a task holds a block and a chunk.

Rows with a null vec_id, label or vector, or with null or non-finite components, take no part. Shorter vectors count as filled up with zeros.
Components and scores beyond a long stand at its ends. Where vec_ids repeat, each row counts, each anchor row is an anchor of its
own, and no row of an anchor's vec_id is its positive or negative. Ties go to the smaller vec_id. An empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldspark.llm import store

SCALE, EVERY, POSITIVES, NEGATIVES = 256, 50, 5, 3
LOW, HIGH = 50, 95  # percent of the positive's score
ROWS, BLOCKS, CHUNK, LEAF = 4096, 4096, 2048, 128
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def usable(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label, v (whole numbers) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), v.alias("v"))
    rows = rows.dropna().filter(~F.exists("v", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))))
    return rows.withColumn("v", F.transform("v", lambda e: F.floor(e * scale).cast("long")))


def relabelled(rows: DataFrame) -> DataFrame:
    """The labels that the query asks for: one further in every seventh row."""
    return rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))


def matrix(column, width: int) -> np.ndarray:
    """Lists of whole numbers as rows, filled up with zeros."""
    n = np.fromiter((len(x) for x in column), np.int64, len(column))
    out = np.zeros((len(n), width), np.int64)
    if n.sum():
        out[np.arange(width) < n[:, None]] = np.concatenate([np.asarray(x, np.int64) for x in column])
    return out


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers."""
    if not q.size or not x.size:
        return np.zeros((len(q), len(x)), np.int64)
    most = float(np.abs(q.astype(float)).max()) * float(np.abs(x.astype(float)).max()) * q.shape[1]
    if most < 2.0**53:
        return (q.astype(float) @ x.T.astype(float)).astype(np.int64)
    return np.clip(q.astype(object) @ x.T.astype(object), LEAST, MOST).astype(np.int64)


@dataclass
class Node:
    start: int
    end: int
    centre: np.ndarray
    radius: float
    lo: int  # labels
    hi: int
    children: tuple = ()


def ball(x: np.ndarray, labels: np.ndarray, start: int, end: int) -> Node:
    centre = x.mean(axis=0)
    return Node(start, end, centre, float(np.sqrt(((x - centre) ** 2).sum(axis=1).max())), int(labels.min()), int(labels.max()))


def build(x: np.ndarray, labels: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, Node]:
    """An order of the rows, and the root of a tree over that order: halves along the line between two far rows."""
    order, x = np.arange(len(x)), x.astype(float)

    def split(start: int, end: int) -> Node:
        at = order[start:end]
        node = ball(x[at], labels[at], start, end)
        if end - start > leaf and node.radius > 0:
            a = x[at[((x[at] - node.centre) ** 2).sum(axis=1).argmax()]]
            b = x[at[((x[at] - a) ** 2).sum(axis=1).argmax()]]
            half = (end - start) // 2
            order[start:end] = at[np.argpartition(x[at] @ (b - a), half)]
            node.children = split(start, start + half), split(start + half, end)
        return node

    return order, split(0, len(x))


def bounds(q: np.ndarray, norms: np.ndarray, centre: np.ndarray, radius) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest inner products of queries with what a ball holds, a little wider for rounding."""
    middle, reach = q @ centre, norms * radius
    reach = reach + 1e-9 * (norms * (np.linalg.norm(centre, axis=0) + radius)) + 1e-6
    return middle - reach, middle + reach


class Search:
    """The k best rows of each query: scores in [lo, hi] and not beneath ``floor``; of the query's label or of others."""

    def __init__(self, vectors, of, ids, labels, lo, hi, floor, k: int, same: bool):
        self.vectors, self.of, self.ids, self.labels, self.k, self.same = vectors, of, ids, labels, k, same
        self.lo, self.hi = lo, hi
        self.kth = np.maximum(floor, lo)
        self.real = vectors.astype(float)
        self.norms = np.linalg.norm(self.real, axis=1)
        self.q, self.score, self.found = (np.zeros(0, np.int64) for _ in range(3))

    def visit(self, node: Node, x: np.ndarray, ids: np.ndarray, labels: np.ndarray, active: np.ndarray) -> None:
        own = self.labels[active]
        active = active[(own >= node.lo) & (own <= node.hi)] if self.same else active[~((own == node.lo) & (own == node.hi))]
        if not len(active):
            return
        least, most = bounds(self.real[self.of[active]], self.norms[self.of[active]], node.centre, node.radius)
        active = active[(most >= self.kth[active]) & (least <= self.hi[active])]
        if not len(active):
            return
        if node.children:
            near = [float((self.real[self.of[active]] @ c.centre).sum()) for c in node.children]
            for c in node.children if near[0] >= near[1] else node.children[::-1]:
                self.visit(c, x, ids, labels, active)
            return
        u, back = np.unique(self.of[active], return_inverse=True)
        s = products(self.vectors[u], x[node.start : node.end])[back]
        there = labels[node.start : node.end]
        fits = (there == self.labels[active][:, None]) if self.same else (there != self.labels[active][:, None])
        fits &= (s >= self.kth[active][:, None]) & (s <= self.hi[active][:, None]) & (ids[node.start : node.end] != self.ids[active][:, None])
        i, j = np.nonzero(fits)
        if not len(i):
            return
        q, score, found = np.append(self.q, active[i]), np.append(self.score, s[i, j]), np.append(self.found, ids[node.start + j])
        order = np.lexsort((found, ~score, q))  # ~ turns the order round without overflow
        q, score, found = q[order], score[order], found[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        keep = rank < self.k
        self.q, self.score, self.found = q[keep], score[keep], found[keep]
        last = rank == self.k - 1
        self.kth[q[last]] = np.maximum(self.kth[q[last]], score[last])


FOUND = "q long, vec_id long, score long"


def _searched(homes: DataFrame, routed: DataFrame, k: int, same: bool, width: int) -> DataFrame:
    """q, vec_id, score: the k best of each query among the rows of each block it was sent to."""
    chunks = F.broadcast(routed.groupBy("block").agg(F.ceil(F.count("*") / F.lit(CHUNK)).cast("int").alias("chunks")))  # a row a block
    left = homes.join(chunks, "block").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
    right = routed.join(chunks, "block").withColumn("chunk", F.pmod(F.xxhash64("uid"), F.col("chunks")).cast("int")).drop("chunks")

    def run(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(queries):
            return pd.DataFrame({c: pd.Series(dtype="int64") for c in ("q", "vec_id", "score")})
        x, labels, ids = matrix(rows["v"], width), rows["label"].to_numpy(), rows["vec_id"].to_numpy()
        order, root = build(x, labels)
        _, at, of = np.unique(queries["uid"].to_numpy(), return_index=True, return_inverse=True)
        search = Search(matrix(queries["v"].iloc[at], width), of, *(queries[c].to_numpy().copy() for c in ("vec_id", "label", "lo", "hi", "floor")), k, same)
        search.visit(root, x[order], ids[order], labels[order], np.arange(len(queries)))
        return pd.DataFrame({"q": queries["q"].to_numpy()[search.q], "vec_id": search.found, "score": search.score})

    return left.groupBy("block", "chunk").cogroup(right.groupBy("block", "chunk")).applyInPandas(run, FOUND)


def _routed(queries: DataFrame, balls: tuple, same: bool, width: int, best: bool) -> DataFrame:
    """Queries with a block each: the one of the best centre, or all others that may hold something."""
    shared = queries.sparkSession.sparkContext.broadcast(balls)  # a ball a block, BLOCKS at most

    def run(batches):
        blocks, centres, radii, lo, hi = shared.value
        for b in batches:
            get = lambda c: b.column(b.schema.get_field_index(c))  # noqa: E731, B023
            for s in range(0, b.num_rows, 256):
                part = b.slice(s, 256)
                q = matrix(get("v").slice(s, 256).to_pylist(), width).astype(float)
                label, floor, low, high = (get(c).slice(s, 256).to_numpy()[:, None] for c in ("label", "floor", "lo", "hi"))
                least, most = bounds(q, np.linalg.norm(q, axis=1)[:, None], centres.T, radii)
                fits = (label >= lo) & (label <= hi) if same else ~((label == lo) & (label == hi))
                fits &= (most >= low) & (least <= high)
                top = np.where(fits, most if not same else q @ centres.T, -np.inf)
                first = np.zeros(fits.shape, bool)
                first[np.arange(len(q)), top.argmax(axis=1)] = True
                fits &= first if best else ~first & (most >= floor)
                i, j = np.nonzero(fits)
                if len(i):
                    yield pa.RecordBatch.from_arrays([*part.take(pa.array(i)).columns, pa.array(blocks[j])], names=[*b.schema.names, "block"])

    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in queries.schema)
    return store.in_arrow(queries, run, f"{ddl}, block int")


def _balls(homes: DataFrame, width: int) -> tuple:
    """Block, centre, radius and labels' range of each block, in tasks."""

    def run(t: pd.DataFrame) -> pd.DataFrame:
        x = matrix(t["v"], width).astype(float)
        node = ball(x, t["label"].to_numpy(), 0, len(x))
        return pd.DataFrame({"block": [int(t["block"].iloc[0])], "centre": [node.centre.tolist()], "radius": [node.radius], "lo": [node.lo], "hi": [node.hi]})

    t = homes.groupBy("block").applyInPandas(run, "block int, centre array<double>, radius double, lo long, hi long").toPandas().sort_values("block")
    return t["block"].to_numpy(np.int32), np.array(t["centre"].tolist()).reshape(len(t), width), t["radius"].to_numpy(), t["lo"].to_numpy(), t["hi"].to_numpy()


def search(homes: DataFrame, balls: tuple, queries: DataFrame, k: int, same: bool, width: int) -> DataFrame:
    """q, place (from 1), vec_id, score of rows (q, uid, vec_id, label, v, lo, hi)."""
    queries = queries.withColumn("floor", F.lit(LEAST).cast("long"))
    near = store.table(_searched(homes, _routed(queries, balls, same, width, True), k, same, width), "near")
    kth = near.groupBy("q").agg(F.when(F.count("*") >= k, F.min("score")).alias("kth"))
    queries = queries.join(kth, "q", "left").withColumn("floor", F.coalesce("kth", "floor")).drop("kth")
    routed = store.table(_routed(queries, balls, same, width, False), "routed")
    found = near.unionByName(_searched(homes, routed, k, same, width))
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("place", place).filter(F.col("place") <= k)


def mine(rows: DataFrame, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of rows (vec_id, label, v): anchors are those
    whose vec_id is divisible by ``every``; a negative's score is ``low`` to ``high`` percent of its positive's."""
    spark = rows.sparkSession
    rows = store.table(rows.select(F.monotonically_increasing_id().alias("uid"), "vec_id", "label", "v"), "rows")
    total, width = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    if not total or not width:
        width = 1
    blocks = max(1, -(-total // max(ROWS, -(-total // BLOCKS))))
    largest = F.array_max(F.transform("v", lambda e: F.abs(e)))
    place = F.array_position(F.transform("v", lambda e: F.abs(e)), largest)
    homes = rows.repartitionByRange(blocks, "label", place, "uid").withColumn("block", F.spark_partition_id())
    homes = store.table(homes.select("block", "vec_id", "label", "v"), "homes")
    balls = _balls(homes, width)
    anchors = rows.filter(F.col("vec_id") % every == 0)
    ends = [F.lit(x).cast("long").alias(n) for n, x in (("lo", LEAST), ("hi", MOST))]
    if not len(balls[0]):
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    near = search(homes, balls, anchors.select(F.col("uid").alias("q"), "uid", "vec_id", "label", "v", *ends), positives, True, width)
    near = near.select(F.col("q").alias("uid"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), "place")
    p = F.col("positive_score")
    # Percentages of whole hundreds and of the rest, so that nothing overflows: ceil and floor of whole numbers.
    rest = F.pmod(p, F.lit(100))
    hundred = F.call_function("div", p - rest, F.lit(100))
    lo = F.lit(low) * hundred + F.ceil(F.lit(low) * rest / 100)
    hi = F.lit(high) * hundred + F.floor(F.lit(high) * rest / 100)
    asked = anchors.join(near, "uid").withColumn("lo", lo.cast("long")).withColumn("hi", hi.cast("long"))
    asked = store.table(asked.withColumn("q", F.monotonically_increasing_id()), "asked")
    hard = search(homes, balls, asked.select("q", "uid", "vec_id", "label", "v", "lo", "hi"), negatives, False, width)
    hard = hard.select("q", F.col("place").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = asked.select("q", F.col("vec_id").alias("anchor_id"), "positive_id", "positive_score")
    return named.join(hard, "q").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


SQL = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE)::BIGINT for x in embedding] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id, b.label, list_sum([z[1] * z[2] for z in list_zip(a.v, b.v)])::BIGINT AS score
  FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE label = own QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS r
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> s.own AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, r::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE r <= 3
"""
