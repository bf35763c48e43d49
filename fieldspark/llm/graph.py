"""Connected components of an edge table, by alternating large and small stars.

Edges stay in tables in the shared folder; the driver sees a count and a checksum a round.
Tables of at most SMALL edges, which are counted first, take one task instead of rounds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldspark.llm import store


SMALL = 1_000_000


def _in_one_task(batches):
    """Least labels by hooking and pointer jumping, for a bounded number of edges."""
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if not parts:
        return
    ends = np.concatenate([np.concatenate([u for u, _ in parts]), np.concatenate([v for _, v in parts])])
    nodes, at = np.unique(ends, return_inverse=True)
    u, v = at[: len(at) // 2], at[len(at) // 2 :]
    label, before = np.arange(len(nodes)), None
    while before is None or not np.array_equal(label, before):
        before = label.copy()
        least = np.minimum(label[u], label[v])
        for side in (label[u], label[v], u, v):
            np.minimum.at(label, side, least)
        label = label[label]
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(nodes[label], pa.int64())], names=["node", "component"])


def components(edges: DataFrame) -> DataFrame:
    """node and component (the least node it reaches) of every node of ``edges`` (a, b)."""
    now = store.table(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    if now.count() <= SMALL:
        return store.in_arrow(now.coalesce(1), _in_one_task, "node long, component long")
    before = None
    while True:  # each round brings every component nearer to a star
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if not mark[0] or mark == before:
            break
        before = mark
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # Now every edge points from a larger to a smaller node: each u keeps its least, the others join that.
        large = store.table(large, "stars")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.withColumnRenamed("m", "v"))
        now = store.table(small.filter("u <> v").distinct(), "edges")
    found = now.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return found.unionByName(found.select(F.col("component").alias("node"), "component").distinct())
