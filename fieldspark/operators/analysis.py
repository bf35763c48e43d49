"""Sensors against wells: overlap, rankings, clusters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldspark.functions import scalars as S
from fieldspark.operators import ranks


def wells(rows: DataFrame, height: int, width: int) -> DataFrame:
    """Wells inside the grid, each place once per subject, at its first index."""
    inside = rows.filter(F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1))
    return inside.groupBy("subject", "row", "col").agg(F.min("well_idx").alias("well_idx"))


def first_wells(rows: DataFrame, n: int, height: int, width: int, pooled: bool = False) -> DataFrame:
    """The first n wells of each subject, or of all subjects together."""
    if pooled:
        return ranks.head(wells(rows, height, width), ["well_idx", "subject", "row", "col"], n).drop("rank")
    w = Window.partitionBy("subject").orderBy("well_idx", "row", "col")
    return wells(rows, height, width).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def swap(rows: DataFrame) -> DataFrame:
    return rows.select(*[F.col({"row": "col", "col": "row"}.get(c, c)).alias(c) for c in rows.columns])


def within(sensors: DataFrame, points: DataFrame, radius: float, metric: str = "l2") -> DataFrame:
    """Points with each sensor within the radius and its distance (d), by buckets of the radius."""
    size = max(1, int(np.ceil(radius)))
    near = F.explode(F.array(*[F.array(F.lit(a), F.lit(b)) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    left = points.withColumn("_s", near).withColumn("_b", F.floor(F.col("row") / size) + F.col("_s")[0]).withColumn("_c", F.floor(F.col("col") / size) + F.col("_s")[1]).drop("_s")
    right = sensors.select(F.col("row").alias("s_row"), F.col("col").alias("s_col"), F.floor(F.col("row") / size).alias("_b"), F.floor(F.col("col") / size).alias("_c"))
    found = left.join(right, ["_b", "_c"]).drop("_b", "_c")
    return found.withColumn("d", S.distance(["row", "col"], ["s_row", "s_col"], metric)).filter(F.col("d") <= radius)


def overlap(sensors: DataFrame, points: DataFrame, radius: float = 2, metric: str = "l2") -> DataFrame:
    """One row: totals, exact hits, wells without a sensor, of those the ones with a sensor near, and the rest."""
    p = points.select("row", "col").distinct()
    s = sensors.select("row", "col").distinct()
    hit = p.join(s.withColumn("hit", F.lit(1)), ["row", "col"], "left")
    near = within(s, p, radius, metric).groupBy("row", "col").agg(F.min("d").alias("dmin"))
    marked = hit.join(near, ["row", "col"], "left")
    missed = F.col("hit").isNull()
    one = marked.agg(
        F.count("*").alias("total_wells"), F.count("hit").alias("exact_overlaps"), F.count_if(missed).alias("wells_without_sensor"),
        F.count_if(missed & F.col("dmin").isNotNull()).alias("wells_with_near_sensor"), F.count_if(missed & F.col("dmin").isNull()).alias("uncovered_wells"), F.min(F.when(missed, F.col("dmin"))).alias("min_near_distance"),
    ).crossJoin(s.agg(F.count("*").alias("total_sensors")))
    return one.withColumn("overlap_percent", F.when(F.col("total_wells") > 0, 100.0 * F.col("exact_overlaps") / F.col("total_wells")).otherwise(0.0))


def compare(placements: dict[str, DataFrame], points: DataFrame, radius: float = 2, metric: str = "l2") -> DataFrame:
    out = None
    for name, sensors in placements.items():
        one = overlap(sensors, points, radius, metric).withColumn("placement", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


NORMS = ("none", "max", "total_sensors", "local_area", "zscore", "minmax")


def _in_order(frame: DataFrame, order: list, top: int | None) -> DataFrame:
    return ranks.ranked(frame, order) if top is None else ranks.head(frame, order, top)


def rank_by_proximity(sensors: DataFrame, points: DataFrame, height: int, width: int, radius: int = 2, metric: str = "l2", normalize: str = "none", top: int | None = None) -> DataFrame:
    """row, col, well_idx, raw_count, score, rank: sensors near each well, in one of six scales; with ``top`` only the head of the ranking."""
    if normalize not in NORMS:
        raise ValueError(f"unknown normalisation: {normalize}")
    near = within(sensors, points, radius, metric).groupBy("well_idx").agg(F.count("*").alias("n"))
    counts = points.select("well_idx", "row", "col").join(near, "well_idx", "left").withColumn("raw_count", F.coalesce("n", F.lit(0)).cast("long")).drop("n")
    c = F.col("raw_count").cast("double")
    if normalize in ("max", "zscore", "minmax"):
        stats = counts.agg(F.max(c).alias("hi"), F.min(c).alias("lo"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"))
        counts = counts.crossJoin(F.broadcast(stats))
        score = {"max": F.when(F.col("hi") > 0, c / F.col("hi")), "zscore": F.when(F.col("std") > 0, (c - F.col("mean")) / F.col("std")), "minmax": F.when(F.col("hi") > F.col("lo"), (c - F.col("lo")) / (F.col("hi") - F.col("lo")))}[normalize]
    elif normalize == "total_sensors":
        counts = counts.crossJoin(F.broadcast(sensors.agg(F.count("*").alias("total"))))
        score = F.when(F.col("total") > 0, c / F.col("total"))
    elif normalize == "local_area":
        area = patch_sizes(points, height, width, radius, metric)
        counts = counts.join(area, "well_idx")
        score = F.when(F.col("area") > 0, c / F.col("area"))
    else:
        score = c
    out = counts.withColumn("score", F.coalesce(score, F.lit(0.0)))
    return _in_order(out.select("well_idx", "row", "col", "raw_count", "score"), [F.desc("score"), F.desc("raw_count"), "well_idx"], top)


def patches(points: DataFrame, height: int, width: int, radius: int, metric: str = "l2") -> DataFrame:
    """The cells within the radius of each well, clipped to the grid."""
    r = int(np.floor(radius))
    steps = lambda: F.explode(F.sequence(F.lit(-r), F.lit(r)))
    cells = points.select("well_idx", "row", "col", steps().alias("_a")).withColumn("_b", steps())
    cells = cells.withColumn("p_row", F.col("row") + F.col("_a")).withColumn("p_col", F.col("col") + F.col("_b"))
    inside = cells.filter(F.col("p_row").between(0, height - 1) & F.col("p_col").between(0, width - 1))
    return inside.filter(S.distance(["_a", "_b"], [0.0, 0.0], metric) <= radius).drop("_a", "_b")


def patch_sizes(points: DataFrame, height: int, width: int, radius: int, metric: str = "l2") -> DataFrame:
    return patches(points, height, width, radius, metric).groupBy("well_idx").agg(F.count("*").alias("area"))


def log_det_fisher(a: np.ndarray, ridge: float = 1e-6) -> float:
    sign, value = np.linalg.slogdet(a.T @ a + ridge * np.eye(a.shape[1]))
    return float(value) if sign > 0 else float("-inf")


def informativeness(sensors: DataFrame, points: DataFrame, basis: DataFrame, height: int, width: int, radius: int = 2, metric: str = "l2", forbidden: DataFrame | None = None, weights=(1.0, 1.0, 1.0, -0.5, 0.25), top: int | None = None) -> DataFrame:
    """Score of each well: sensors near, their Gaussian weights, log det of the local basis' Fisher matrix,
    redundancy of near sensors and a bonus for lying inside. ``basis`` has (row, col, tube)."""
    near = within(sensors, points, radius, metric)
    local = near.groupBy("well_idx").agg(F.count("*").alias("n"), F.sum(S.gaussian_kernel("d", radius / 2)).alias("weighted"))
    ids = near.select("well_idx", "s_row", "s_col")
    other = ids.select("well_idx", F.col("s_row").alias("r2"), F.col("s_col").alias("c2"))
    pairs = ids.join(other, "well_idx").filter("s_row < r2 or (s_row = r2 and s_col < c2)").withColumn("d", S.distance(["s_row", "s_col"], ["r2", "c2"], "l2"))
    tau = pairs.groupBy("well_idx").agg(F.greatest(F.lit(1.0), F.median("d")).alias("tau"))
    redundant = pairs.join(tau, "well_idx").groupBy("well_idx").agg(F.sum(F.exp(-F.col("d") / F.col("tau"))).alias("redundancy"))
    cells = patches(points, height, width, radius, metric).select("well_idx", F.col("p_row").alias("row"), F.col("p_col").alias("col")).join(basis, ["row", "col"])

    def fisher(t: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"well_idx": t["well_idx"].iloc[:1], "logdet": [log_det_fisher(np.stack(t["tube"].to_numpy()).astype(float))]})

    det = cells.groupBy("well_idx").applyInPandas(fisher, "well_idx long, logdet double")
    centre = [(height - 1) / 2, (width - 1) / 2]
    most = max(1e-12, float(np.hypot(*centre)))
    out = points.select("well_idx", "row", "col").join(local, "well_idx", "left").join(redundant, "well_idx", "left").join(det, "well_idx", "left")
    bonus = F.lit(0.1) * (F.lit(1.0) - S.distance(["row", "col"], centre, "l2") / F.lit(most))
    if forbidden is not None:
        out = out.join(forbidden.select("row", "col").distinct().withColumn("_no", F.lit(1)), ["row", "col"], "left")
        bonus = F.when(F.col("_no").isNotNull(), -1.0).otherwise(bonus)
    zero = F.lit(0.0)
    parts = [F.coalesce(F.col("n").cast("double"), zero), F.coalesce("weighted", zero), F.coalesce("logdet", zero), F.coalesce("redundancy", zero), bonus]
    score = sum((F.lit(w) * p for w, p in zip(weights, parts)), zero)
    named = out.select("well_idx", "row", "col", *[p.alias(n) for p, n in zip(parts, ("count", "weighted", "logdet", "redundancy", "boundary"))], score.alias("score"))
    return _in_order(named, [F.desc("score"), F.desc("count"), F.desc("weighted"), "well_idx"], top)


def nearest_centre(cells: DataFrame, centres: DataFrame) -> DataFrame:
    """cluster of each cell (row, col): the nearest centre, ties to the smaller id. Centres are a handful (k)."""
    pairs = cells.crossJoin(F.broadcast(centres.select("cluster", F.col("row").cast("double").alias("c_row"), F.col("col").cast("double").alias("c_col"))))
    d = S.distance(["row", "col"], ["c_row", "c_col"], "l2")
    return pairs.groupBy("row", "col").agg(F.min_by("cluster", F.struct(d.alias("d"), "cluster")).alias("cluster"))


def kmeans(points: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """cluster, row, col of k centres."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    x = points.select(array_to_vector(F.array(F.col("row").cast("double"), F.col("col").cast("double"))).alias("features"))
    centres = KMeans(k=k, seed=seed, initMode="k-means||", maxIter=100).fit(x).clusterCenters()
    return points.sparkSession.createDataFrame([(i, float(c[0]), float(c[1])) for i, c in enumerate(centres)], "cluster int, row double, col double")


def cluster_probabilities(cells: DataFrame, centres: DataFrame, sensors: DataFrame) -> DataFrame:
    """Per cluster: count, area, P(C|S), P(S|C), P(C) and P(C|S) by Bayes, of active cells (row, col)."""
    placed = nearest_centre(cells, centres)
    marked = placed.join(sensors.select("row", "col").distinct().withColumn("s", F.lit(1)), ["row", "col"], "left")
    per = marked.groupBy("cluster").agg(F.count("s").alias("sensors"), F.count("*").alias("area"))
    total = per.agg(F.sum("sensors").alias("all_s"), F.sum("area").alias("all_a"))
    out = per.crossJoin(F.broadcast(total))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    out = out.select("cluster", "sensors", "area", ratio("sensors", "all_s").alias("p_c_s"), ratio("sensors", "area").alias("p_s_c"), ratio("area", "all_a").alias("p_c"))
    joint = F.col("p_s_c") * F.col("p_c")
    evidence = out.agg(F.sum(joint).alias("evidence"))
    return out.crossJoin(F.broadcast(evidence)).withColumn("bayes", F.when(F.col("evidence") > 0, joint / F.col("evidence")).otherwise(0.0)).drop("evidence")
