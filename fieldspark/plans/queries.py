"""One query an operator, with SQL where it can express it."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldspark.functions import kernels as K
from fieldspark.functions import scalars as S
from fieldspark.operators import analysis, decomposition, experiments, graph, placement, ranks, sensing, stats, tensor, triangulation
from fieldspark.plans import tables as T
from fieldspark.sources import generators, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
AXES = {"i0": T.NATIONS, "i1": T.PRIORITIES, "t": T.MONTHS}
CELLS = T.NATIONS * T.PRIORITIES


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


def _r(frame: DataFrame, digits: int = 6, *names: str) -> DataFrame:
    """Doubles rounded, negative zeros made positive."""
    return frame.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" and (not names or c in names) else F.col(c) for c, t in frame.dtypes])


def _sales(spark, d, subject: bool = False) -> DataFrame:
    s = T.sales(spark, d)
    return s.withColumn("subject", F.col("i0").cast("string")) if subject else s


# --- tensors and their shapes --------------------------------------------------------------------


@query(f"WITH {T.SALES} SELECT i0, i1, t, round(v, 6) AS v FROM sales")
def tensor_build_sales(spark, d):
    return _r(T.sales(spark, d))


@query(f"WITH {T.ACTIVITY} SELECT i0, i1, t, round(v, 6) AS v FROM activity")
def tensor_build_activity(spark, d):
    return _r(T.activity(spark, d))


@query(f"WITH {T.SHIPMENTS} SELECT subject, i0, t, round(v, 6) AS v FROM shipments")
def tensor_build_shipments(spark, d):
    return _r(T.shipments(spark, d))


FULL = f"{T.SALES}, g AS (SELECT a.range::INT AS i0, b.range::INT AS i1, c.range::INT AS t FROM range(25) a, range(5) b, range({T.MONTHS}) c), dense AS (SELECT i0, i1, t, coalesce(v, 0.0::DOUBLE) AS v FROM g LEFT JOIN sales USING (i0, i1, t))"


def _full(spark, d) -> DataFrame:
    return tensor.zero_fill(T.sales(spark, d), AXES)


@query(f"WITH {FULL} SELECT i0, i1, t, round(v, 6) AS v FROM dense")
def grid_zero_fill(spark, d):
    return _r(_full(spark, d))


@query(f"WITH {T.SALES} SELECT i0, i1, round(v, 6) AS v FROM sales WHERE t = 7")
def time_slice(spark, d):
    return _r(tensor.time_slice(T.sales(spark, d), 7))


@query(f"WITH {T.SALES} SELECT i0, i1, t, round(v, 6) AS v FROM sales WHERE t % 12 = 0")
def frame_step(spark, d):
    return _r(tensor.frame_step(T.sales(spark, d), 12))


@query(f"WITH {T.SALES} SELECT (i0 * 5 + i1)::BIGINT AS cell, t, round(v, 6) AS v FROM sales")
def flatten_cell_id(spark, d):
    return _r(tensor.flatten(T.sales(spark, d), {"i0": 25, "i1": 5}).select("cell", "t", "v"))


@query(f"WITH {T.SALES} SELECT i0, i1, t, round(v, 6) AS v FROM sales")
def unflatten_cell_id(spark, d):
    axes = {"i0": 25, "i1": 5}
    return _r(tensor.unflatten(tensor.flatten(T.sales(spark, d), axes), axes))


@query(f"WITH {FULL}, u AS (SELECT (i0 * 5 + i1)::BIGINT AS cell, list(v ORDER BY t) AS x FROM dense GROUP BY 1) SELECT cell, len(x)::BIGINT AS n, round(list_sum(x), 6) AS s, round(x[8], 6) AS x8 FROM u")
def tubes_build(spark, d):
    t = tensor.tubes(tensor.flatten(T.sales(spark, d), {"i0": 25, "i1": 5}), ["cell"], T.MONTHS)
    return _r(t.select("cell", F.size("tube").cast("long").alias("n"), F.aggregate("tube", F.lit(0.0), lambda a, x: a + x).alias("s"), F.col("tube")[7].alias("x8")))


@query(f"WITH {T.SHIPMENTS} SELECT subject || '_slice_' || (t // 12)::VARCHAR AS subject, round(sum(v), 6) AS v FROM shipments GROUP BY 1")
def split_slices(spark, d):
    s = T.shipments(spark, d).withColumn("year", F.floor(F.col("t") / 12).cast("int"))
    return _r(tensor.split_slices(s, "year").groupBy("subject").agg(F.sum("v").alias("v")))


@query(f"WITH {T.SALES} SELECT 0 AS channel, i0, i1, t, round(v, 6) AS v FROM sales UNION ALL SELECT 1, i0, i1, t, round(v * 2, 6) FROM sales")
def channel_stack(spark, d):
    s = T.sales(spark, d)
    return _r(tensor.stack_channels([s, s.withColumn("v", F.col("v") * 2)]).select("channel", "i0", "i1", "t", "v"))


@query(f"WITH {T.SALES} SELECT i0, t, round(0.2125 * sum(v) FILTER (i1 = 0) + 0.7154 * sum(v) FILTER (i1 = 1) + 0.0721 * sum(v) FILTER (i1 = 2), 6) AS v FROM {'dense'} GROUP BY ALL".replace(f"WITH {T.SALES}", f"WITH {FULL}"))
def rgb_to_gray(spark, d):
    x = _full(spark, d).filter("i1 < 3").withColumnRenamed("i1", "channel")
    return _r(tensor.rgb_to_gray(x, ["i0", "t"]))


@query(f"WITH {T.SALES} SELECT i0, t, c.range::INT AS channel, round(v, 6) AS v FROM sales, range(3) c WHERE i1 = 0")
def gray_to_rgb(spark, d):
    return _r(tensor.gray_to_rgb(T.sales(spark, d).filter("i1 = 0").drop("i1")).select("i0", "t", "channel", "v"))


@query(f"WITH {T.SALES} SELECT (i0 + (t // 4) * 25)::INT AS row, (i1 + t % 4 * 5)::INT AS col, round(v, 6) AS v FROM sales WHERE t < 12")
def mosaic_frames(spark, d):
    return _r(tensor.mosaic(T.sales(spark, d), 3, 4, 25, 5))


@query(f"WITH {T.SHIPMENTS}, l AS (SELECT subject, sum({T.MONTHS}) OVER (ORDER BY subject ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS o FROM (SELECT DISTINCT subject FROM shipments)) SELECT subject, i0, (t + coalesce(o, 0))::INT AS t, round(v, 6) AS v FROM shipments JOIN l USING (subject)")
def stack_subjects(spark, d):
    s = T.shipments(spark, d)
    return _r(tensor.stack_subjects(s, s.select("subject").distinct().withColumn("place", F.col("subject")).withColumn("n", F.lit(T.MONTHS))).select("subject", "i0", "t", "v"))


@query()
def noisy_union(spark, d):
    return tensor.noisy_union(T.sales(spark, d), [0.1, 0.2], seed=42)


MASK = "p AS (SELECT a.range::INT AS i0, b.range::INT AS i1 FROM range(25) a, range(5) b WHERE (a.range * 5 + b.range) % 7 = 0)"


def _mask(spark) -> DataFrame:
    return tensor.grid(spark, {"i0": 25, "i1": 5}).filter((F.col("i0") * 5 + F.col("i1")) % 7 == 0)


@query(f"WITH {FULL}, {MASK} SELECT i0, i1, t, CASE WHEN (i0 * 5 + i1) % 7 = 0 THEN round(v, 6) ELSE 0.0::DOUBLE END AS v FROM dense")
def sensor_mask_dense(spark, d):
    return _r(tensor.measured(_full(spark, d), _mask(spark), ["i0", "i1"], dense=True))


@query(f"WITH {T.SALES}, {MASK} SELECT i0, i1, t, round(v, 6) AS v FROM sales SEMI JOIN p USING (i0, i1)")
def sensor_mask_sparse(spark, d):
    return _r(tensor.measured(T.sales(spark, d), _mask(spark), ["i0", "i1"]).select("i0", "i1", "t", "v"))


@query(f"WITH {T.SALES}, {MASK} SELECT i0, i1, t, round(v, 6) AS v FROM sales ANTI JOIN p USING (i0, i1)")
def rejection_anti(spark, d):
    return _r(tensor.available(T.sales(spark, d), _mask(spark), ["i0", "i1"]).select("i0", "i1", "t", "v"))


@query(f"WITH {T.SALES} SELECT i0, i1, t, CASE WHEN abs(v) < 10.0 THEN 0.0::DOUBLE ELSE round(v, 6) END AS v FROM sales")
def zero_suppress(spark, d):
    return _r(T.sales(spark, d).withColumn("v", S.zero_suppress("v", 10.0, None)))


@query(f"WITH {T.SALES} SELECT i0, i1, t, round(sign(v - 2) * greatest(abs(v - 2) - 0.5::DOUBLE, 0), 6) + 0.0::DOUBLE AS v FROM sales")
def soft_threshold(spark, d):
    return _r(T.sales(spark, d).withColumn("v", S.soft_threshold(F.col("v") - 2, 0.5)))


@query("SELECT p_partkey, coalesce(TRY_CAST(nullif(regexp_extract('part_' || p_partkey || '_x', '_(\\d+)', 1), '') AS INT), 0) AS step, 0 AS none FROM part")
def step_numbers(spark, d):
    p = T.read(spark, d, "part").select("p_partkey", F.concat(F.lit("part_"), "p_partkey", F.lit("_x")).alias("n"))
    return p.select("p_partkey", S.step_number("n").alias("step"), S.step_number(F.lit("plain")).alias("none"))


# --- statistics and normalisation ----------------------------------------------------------------

STATS = "coalesce(min(v), 0) AS lo, coalesce(max(v), 0) AS hi, round(coalesce(avg(v), 0), 6) AS mean, round(coalesce(stddev_pop(v), 1), 6) AS std"


@query(f"WITH {FULL} SELECT i0, round(coalesce(min(v) FILTER (v <> 0), 0), 6) AS lo, round(coalesce(max(v) FILTER (v <> 0), 0), 6) AS hi, round(coalesce(avg(v) FILTER (v <> 0), 0), 6) AS mean, round(coalesce(stddev_pop(v) FILTER (v <> 0), 1), 6) AS std FROM dense GROUP BY i0")
def foreground_stats_bg(spark, d):
    return _r(stats.foreground_stats(_full(spark, d), ["i0"], background=0.0))


@query(f"WITH {T.SALES} SELECT round(min(v), 6) AS lo, round(max(v), 6) AS hi FROM sales")
def global_minmax(spark, d):
    return _r(stats.global_minmax(_sales(spark, d, True)))


@query(f"WITH {T.SALES} SELECT round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std FROM sales")
def global_zscore(spark, d):
    return _r(stats.global_zscore(T.sales(spark, d)))


@query(f"WITH {T.SALES}, m AS (SELECT min(v) AS lo, max(v) AS hi FROM sales) SELECT i0, i1, t, round((v - lo) / (hi - lo + 1e-8::DOUBLE), 6) AS v FROM sales, m")
def norm_minmax(spark, d):
    s = T.sales(spark, d)
    return _r(stats.apply(s, stats.fit(s), "minmax"))


@query(f"WITH {T.SALES}, m AS (SELECT i0, avg(v) AS mean, stddev_samp(v) AS std FROM sales GROUP BY i0) SELECT i0, i1, t, round((v - mean) / (std + 1e-8::DOUBLE), 6) + 0.0::DOUBLE AS v FROM sales JOIN m USING (i0)")
def norm_zscore(spark, d):
    s = T.sales(spark, d)
    return _r(stats.apply(s, stats.fit(s, ["i0"]), "zscore", ["i0"]))


@query(f"WITH {T.SALES}, m AS (SELECT max(abs(v)) AS most FROM sales) SELECT i0, i1, t, round(v / (most + 1e-8::DOUBLE), 6) AS v FROM sales, m")
def norm_maxabs(spark, d):
    s = T.sales(spark, d)
    return _r(stats.apply(s, stats.fit(s), "maxabs"))


@query(f"WITH {T.SALES} SELECT i0, i1, t, round(v, 6) AS v FROM sales")
def norm_inverse(spark, d):
    s = T.sales(spark, d)
    p = stats.fit(s)
    return _r(stats.apply(stats.apply(s, p, "zscore"), p, "zscore", inverse=True))


@query(f"WITH {T.SALES} SELECT i0, i1, t, round(CASE WHEN v <> 0 THEN (v - 2.0::DOUBLE) / (51.0::DOUBLE - 2.0::DOUBLE) ELSE v END, 6) + 0.0::DOUBLE AS v FROM sales")
def process_given(spark, d):
    """Frames normalised by given parameters, without the background."""
    s = T.sales(spark, d)
    return _r(stats.process(s, ["t"], method="minmax", params={"min": 2.0, "max": 51.0}, background=0.0).select("i0", "i1", "t", "v"))


@query(f"WITH {T.SALES} SELECT i0, i1, t, round(CASE WHEN v > 1 THEN v * 3.0::DOUBLE + 7.0::DOUBLE ELSE v END, 6) AS v FROM sales")
def restore_masked(spark, d):
    s = T.sales(spark, d).withColumn("m", F.col("v") > 1)
    return _r(stats.restore(s, "zscore", {"mean": 7.0, "std": 3.0}, mask="m").drop("m"))


@query(f"WITH {T.SALES} SELECT i0, round(coalesce(min(v) FILTER (v > 0), 0), 6) AS lo, round(max(v), 6) AS hi FROM sales GROUP BY i0")
def positive_range(spark, d):
    return _r(stats.positive_range(T.sales(spark, d), ["i0"]))


@query(f"WITH {T.WELLS} SELECT a.range::INT AS row, b.range::INT AS col, CASE WHEN w.row IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS v FROM range(100) a, range(100) b LEFT JOIN (SELECT DISTINCT row, col FROM wells) w ON w.row = a.range AND w.col = b.range")
def wells_matrix(spark, d):
    return tensor.wells_matrix(T.places(spark, d), 100, 100)


@query(f"WITH {T.ACTIVITY}, m AS (SELECT i1, t, min(v) AS lo, max(v) AS hi FROM activity GROUP BY 1, 2) SELECT i0, i1, t, round(CASE WHEN hi > lo THEN (v - lo) / (hi - lo) ELSE v END, 6) AS v FROM activity JOIN m USING (i1, t)")
def norm_per_frame(spark, d):
    return _r(stats.per_frame(T.activity(spark, d), "minmax", ["i1", "t"]).select("i0", "i1", "t", "v"))


@query(f"WITH {T.ACTIVITY} SELECT i0, i1, t, round(v - avg(v) OVER (PARTITION BY i0, i1), 6) + 0.0::DOUBLE AS v FROM activity")
def demean_series(spark, d):
    return _r(stats.demean(T.activity(spark, d), ["i0", "i1"]))


@query(f"WITH {T.ACTIVITY}, x AS (SELECT *, t::DOUBLE / 30.0::DOUBLE AS x FROM activity), l AS (SELECT i0, i1, regr_slope(v, x) AS a, regr_intercept(v, x) AS b, avg(v) AS m FROM x GROUP BY 1, 2) SELECT i0, i1, t, round(v - (coalesce(CASE WHEN isnan(a) THEN NULL ELSE a END, 0) * x + coalesce(CASE WHEN isnan(b) THEN NULL ELSE b END, m)), 6) + 0.0::DOUBLE AS v FROM x JOIN l USING (i0, i1)")
def detrend_series(spark, d):
    return _r(stats.detrend(T.activity(spark, d), ["i0", "i1"], T.DAYS).select("i0", "i1", "t", "v"))


@query(f"WITH {T.SALES}, f AS (SELECT i0, t, row_number() OVER (PARTITION BY i0 ORDER BY t) - 1 AS r, count(*) OVER (PARTITION BY i0) AS n FROM (SELECT DISTINCT i0, t FROM sales)) SELECT i0, i1, t, CASE WHEN r < floor(n * 0.8::DOUBLE + 1e-9) THEN 'train' ELSE 'test' END AS part FROM sales JOIN f USING (i0, t)")
def split_ordered(spark, d):
    return stats.split_ordered(T.sales(spark, d), 0.8, ["i0"]).select("i0", "i1", "t", "part")


@query(f"WITH {T.SALES}, f AS (SELECT i0, t, row_number() OVER (PARTITION BY i0 ORDER BY t) - 1 AS r, count(*) OVER (PARTITION BY i0) AS n FROM (SELECT DISTINCT i0, t FROM sales)) SELECT i0, i1, t, CASE WHEN r < floor(n * 0.7::DOUBLE + 1e-9) THEN 'train' WHEN r < floor(n * 0.7::DOUBLE + 1e-9) + floor(n * 0.2::DOUBLE + 1e-9) THEN 'val' ELSE 'test' END AS part FROM sales JOIN f USING (i0, t)")
def split_three_way(spark, d):
    return stats.split_three(T.sales(spark, d), 0.7, 0.2, None, ["i0"]).select("i0", "i1", "t", "part")


@query()
def split_random_experiments(spark, d):
    return stats.split_random(T.sales(spark, d), 3, 0.8, ["i0"]).groupBy("experiment", "i0", "part").agg(F.countDistinct("t").alias("frames"))


PAIRS = f"{T.SALES}, pairs AS (SELECT i0, i1, t, v AS ref, avg(v) OVER (PARTITION BY i0, i1) AS rec FROM sales)"


def _pairs(spark, d) -> DataFrame:
    from pyspark.sql import Window

    return T.sales(spark, d).withColumn("rec", F.avg("v").over(Window.partitionBy("i0", "i1"))).withColumnRenamed("v", "ref")


METRICS = "round(sqrt(sum((rec - ref) ** 2)) / sqrt(sum(ref ** 2)), 6) AS error, round(avg((rec - ref) ** 2), 6) AS mse, round(sqrt(avg((rec - ref) ** 2)), 6) AS rmse, round(20 * log10((max(ref) - min(ref)) / sqrt(avg((rec - ref) ** 2))), 4) AS psnr"


@query(f"WITH {PAIRS} SELECT i0, {METRICS} FROM pairs GROUP BY i0")
def error_metrics(spark, d):
    return _r(_r(stats.metrics(_pairs(spark, d), ["i0"]), 6, "error", "mse", "rmse"), 4, "psnr")


@query(f"WITH {PAIRS} SELECT i0, round(sqrt(sum((rec - ref) ** 2) FILTER (ref > 1)) / sqrt(sum(ref ** 2) FILTER (ref > 1)), 6) AS error, round(avg((rec - ref) ** 2) FILTER (ref > 1), 6) AS mse FROM pairs GROUP BY i0")
def masked_metrics(spark, d):
    p = _pairs(spark, d).withColumn("m", F.col("ref") > 1)
    return _r(stats.metrics(p, ["i0"], mask="m").select("i0", "error", "mse"))


@query(f"WITH {PAIRS}, e AS (SELECT i0, t, sqrt(sum((rec - ref) ** 2)) / sqrt(sum(ref ** 2)) AS e FROM pairs GROUP BY 1, 2) SELECT i0, round(avg(e), 6) AS error_mean, round(stddev_samp(e), 6) AS error_std, round(avg(e) - 1.96::DOUBLE * stddev_samp(e) / sqrt(count(*)), 6) AS error_ci_lower, round(avg(e) + 1.96::DOUBLE * stddev_samp(e) / sqrt(count(*)), 6) AS error_ci_upper, count(*) AS num_samples FROM e GROUP BY i0")
def ci_summary(spark, d):
    e = stats.metrics(_pairs(spark, d), ["i0", "t"]).select("i0", "t", "error")
    return _r(stats.summary(e, ["i0"], ["error"]).select("i0", "error_mean", "error_std", "error_ci_lower", "error_ci_upper", "num_samples"))


def _blur_sql(n: int, name: str, sigma: float = 1.5, radius: int = 5) -> str:
    """Weights of a Gaussian filter with mirrored borders: row i of the result takes u of row j."""
    size = sum(math.exp(-0.5 * (o / sigma) ** 2) for o in range(-radius, radius + 1))
    at = f"a.range + o.range"
    mirrored = f"CASE WHEN {at} < 0 THEN -({at}) - 1 WHEN {at} >= {n} THEN {2 * n - 1} - ({at}) ELSE {at} END"
    return f"{name} AS (SELECT a.range::INT AS i, ({mirrored})::INT AS j, sum(exp(-0.5::DOUBLE * (o.range / {sigma}::DOUBLE) ** 2) / {size!r}::DOUBLE) AS u FROM range({n}) a, range({-radius}, {radius + 1}) o GROUP BY 1, 2)"


_MOMENTS = ", ".join(f"sum(p.u * q.u * {x}) AS {n}" for n, x in (("ma", "rec"), ("mb", "ref"), ("aa", "rec * rec"), ("bb", "ref * ref"), ("ab", "rec * ref")))
_SSIM_SQL = (
    f"WITH {PAIRS}, {_blur_sql(25, 'p')}, {_blur_sql(5, 'q')}, g AS (SELECT a.range::INT AS i0, b.range::INT AS i1, c.range::INT AS t FROM range(25) a, range(5) b, range({T.MONTHS}) c), "
    "z AS (SELECT i0, i1, t, coalesce(rec, 0) AS rec, coalesce(ref, 0) AS ref FROM g LEFT JOIN pairs USING (i0, i1, t) WHERE t IN (SELECT t FROM pairs)), "
    f"m AS (SELECT t, p.i AS i0, q.i AS i1, {_MOMENTS} FROM z JOIN p ON p.j = z.i0 JOIN q ON q.j = z.i1 WHERE p.i BETWEEN 2 AND 22 AND q.i = 2 GROUP BY 1, 2, 3), "
    "c AS (SELECT *, 25 / 24::DOUBLE * (aa - ma * ma) AS va, 25 / 24::DOUBLE * (bb - mb * mb) AS vb, 25 / 24::DOUBLE * (ab - ma * mb) AS vab FROM m) "
    "SELECT t, round(avg((2 * ma * mb + 0.012::DOUBLE) * (2 * vab + 0.032::DOUBLE) / ((ma * ma + mb * mb + 0.012::DOUBLE) * (va + vb + 0.032::DOUBLE))), 6) AS ssim FROM c GROUP BY t"
)


@query(_SSIM_SQL)
def ssim_frames(spark, d):
    import pandas as pd

    def run(t):
        a, b = decomposition.dense(t.assign(v=t["rec"]), {"i0": 25, "i1": 5}), decomposition.dense(t.assign(v=t["ref"]), {"i0": 25, "i1": 5})
        return pd.DataFrame({"t": t["t"].iloc[:1], "ssim": [K.ssim(a, b)]})

    return _r(_pairs(spark, d).groupBy("t").applyInPandas(run, "t int, ssim double"))


# --- meshes ----------------------------------------------------------------------------------------

EDGES = "g AS (SELECT a.range::BIGINT AS r, b.range::BIGINT AS c FROM range(25) a, range(5) b), s(dr, dc) AS (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)), e AS (SELECT r * 5 + c AS src, (r + dr) * 5 + c + dc AS dst FROM g, s WHERE r + dr BETWEEN 0 AND 24 AND c + dc BETWEEN 0 AND 4), deg AS (SELECT src AS cell, count(*)::DOUBLE AS degree FROM e GROUP BY 1)"
FIELD = f"{T.SALES}, f AS (SELECT (i0 * 5 + i1)::BIGINT AS cell, avg(v) AS v FROM sales GROUP BY 1)"


def _edges(spark) -> DataFrame:
    return graph.grid_edges(spark, [25, 5])


def _cells(spark, d) -> DataFrame:
    return tensor.flatten(T.sales(spark, d), {"i0": 25, "i1": 5})


def _field(spark, d) -> DataFrame:
    return _cells(spark, d).groupBy("cell").agg(F.avg("v").alias("v"))


@query(f"WITH {EDGES}, {FIELD} SELECT src, dst, round(b.v - a.v, 2) + 0.0::DOUBLE AS gap FROM e JOIN f a ON a.cell = src JOIN f b ON b.cell = dst")
def grid_edges_2d(spark, d):
    """Neighbours on the grid of nations and priorities, with the step of mean sales between them."""
    a, b = (_field(spark, d).select(F.col("cell").alias(c), F.col("v").alias(f"_{c}")) for c in ("src", "dst"))
    return _r(_edges(spark).join(a, "src").join(b, "dst").select("src", "dst", (F.col("_dst") - F.col("_src")).alias("gap")), 2)


@query(f"WITH {T.SALES}, s(a, b, c) AS (VALUES (-1, 0, 0), (1, 0, 0), (0, -1, 0), (0, 1, 0), (0, 0, -1), (0, 0, 1)), k AS (SELECT ((i0 * 5 + i1) * {T.MONTHS} + t)::BIGINT AS cell, * FROM sales) SELECT p.cell AS src, q.cell AS dst, round(q.v - p.v, 6) + 0.0::DOUBLE AS gap FROM k p, s JOIN k q ON q.i0 = p.i0 + s.a AND q.i1 = p.i1 + s.b AND q.t = p.t + s.c")
def grid_edges_3d(spark, d):
    """Neighbours in nation, priority and month that both have sales."""
    k = tensor.flatten(T.sales(spark, d), AXES)
    a, b = (k.select(F.col("cell").alias(c), F.col("v").alias(f"_{c}")) for c in ("src", "dst"))
    return _r(graph.grid_edges(spark, list(AXES.values())).join(a, "src").join(b, "dst").select("src", "dst", (F.col("_dst") - F.col("_src")).alias("gap")), 6)


@query(f"WITH {EDGES}, {FIELD} SELECT a.cell, round(sqrt(avg((b.v - a.v) ** 2)), 6) AS v FROM e JOIN f a ON a.cell = src JOIN f b ON b.cell = dst GROUP BY 1")
def fd_gradient(spark, d):
    return _r(graph.fd_gradient(_edges(spark), _field(spark, d)))


@query(f"WITH {EDGES}, {FIELD} SELECT a.cell, round(abs(max(degree) * max(a.v) - sum(b.v)), 5) AS v FROM e JOIN f a ON a.cell = src JOIN f b ON b.cell = dst JOIN deg ON deg.cell = src GROUP BY 1")
def graph_gradient(spark, d):
    return _r(graph.graph_gradient(graph.laplacian(_edges(spark), graph.grid_vertices(spark, [25, 5])), _field(spark, d)), 5)


@query(f"WITH {T.SALES}, a AS (SELECT (i0 * 5 + i1)::BIGINT AS cell, sqrt(avg(v * v)) AS v FROM sales GROUP BY 1) SELECT cell, round(v / max(v) OVER (), 6) AS v FROM a")
def amplitude_weight(spark, d):
    return _r(graph.amplitude_weight(_cells(spark, d)))


@query(f"WITH {EDGES}, {T.SALES}, o AS (SELECT (i0 * 5 + i1)::BIGINT AS cell, avg(v * v) AS v FROM sales GROUP BY 1), n AS (SELECT src AS cell, sum(v) AS n FROM e JOIN o ON o.cell = dst GROUP BY 1) SELECT cell, round((v + n) / max(v + n) OVER (), 6) AS v FROM o JOIN n USING (cell)")
def energy_weight(spark, d):
    return _r(graph.energy_weight(_cells(spark, d), _edges(spark)))


@query(f"WITH {EDGES}, {FIELD}, gw AS (SELECT a.cell, sqrt(avg((b.v - a.v) ** 2)) AS v FROM e JOIN f a ON a.cell = src JOIN f b ON b.cell = dst GROUP BY 1) SELECT cell, round(v / max(v) OVER (), 6) AS v FROM gw")
def gradient_weight(spark, d):
    return _r(graph.gradient_weight(_cells(spark, d), _edges(spark)))


POINTS = "v AS (SELECT vec_id AS cell, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings)"


def _points(spark, d) -> DataFrame:
    return T.embeddings(spark, d).select("cell", F.slice("tube", 1, 2).alias("coord"))


@query(f"WITH {POINTS} SELECT a.cell AS src, b.cell AS dst, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 6) AS dist FROM v a JOIN v b ON a.cell <> b.cell AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 0.02")
def radius_graph(spark, d):
    return _r(graph.radius_graph(_points(spark, d), 0.02).select("src", "dst", "dist"))


@query(f"WITH {POINTS} SELECT round(avg(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)), 6) AS length FROM v a JOIN v b ON a.cell <> b.cell WHERE sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 0.02")
def char_length(spark, d):
    return _r(graph.characteristic_length(graph.radius_graph(_points(spark, d), 0.02)))


MESH = f"{POINTS}, e AS (SELECT a.cell AS src, b.cell AS dst FROM v a JOIN v b ON a.cell <> b.cell AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 0.02), deg AS (SELECT src AS cell, count(*)::DOUBLE AS degree FROM e GROUP BY 1), every AS (SELECT cell, coalesce(degree, 0) AS degree FROM v LEFT JOIN deg USING (cell))"


def _mesh(spark, d) -> DataFrame:
    return graph.radius_graph(_points(spark, d), 0.02)


@query(f"WITH {MESH} SELECT cell, degree FROM deg")
def degree(spark, d):
    return graph.degree(_mesh(spark, d))


@query(f"WITH {MESH} SELECT src, dst, -1.0::DOUBLE AS l FROM e UNION ALL SELECT cell, cell, degree FROM every")
def laplacian(spark, d):
    return graph.radius_laplacian(_points(spark, d), 0.02)


@query(f"WITH {MESH} SELECT src, dst, round(-1 / sqrt(x.degree * y.degree), 6) AS l FROM e JOIN deg x ON x.cell = src JOIN deg y ON y.cell = dst UNION ALL SELECT cell, cell, 1.0::DOUBLE FROM every")
def laplacian_norm(spark, d):
    return _r(graph.radius_laplacian(_points(spark, d), 0.02, normalised=True))


@query(f"WITH {POINTS} SELECT a.cell, round(exp(-min(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) / (0.1::DOUBLE + 1e-10::DOUBLE)), 6) AS v FROM v a, v b WHERE b.cell % 100 = 0 GROUP BY 1")
def proximity_penalty(spark, d):
    p = _points(spark, d)
    return _r(graph.proximity(p, p.filter("cell % 100 = 0").select("coord"), 0.1))


@query(f"WITH {POINTS}, p AS (SELECT a.cell AS src, b.cell AS dst, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM v a JOIN v b ON a.cell <> b.cell), k AS (SELECT src, dst, d FROM p QUALIFY row_number() OVER (PARTITION BY src ORDER BY d, dst) <= 6), u AS (SELECT least(src, dst) AS s, greatest(src, dst) AS t, sum(d) / 2 AS d FROM k GROUP BY 1, 2) SELECT s AS src, t AS dst, round(d, 6) AS dist FROM u UNION ALL SELECT t, s, round(d, 6) FROM u")
def knn_graph(spark, d):
    return _r(graph.knn_graph(_points(spark, d), 6).select("src", "dst", "dist"))


@query()
def delaunay_graph(spark, d):
    labelled = T.embeddings(spark, d).select("cell", F.slice("tube", 1, 2).alias("coord"), "label")
    return triangulation.delaunay(labelled, by=("label",))


# --- decomposition -----------------------------------------------------------------------------------


@query(f"WITH {T.SALES} SELECT i1::BIGINT AS row, (i0 * {T.MONTHS} + t)::BIGINT AS col, round(v, 6) AS v FROM sales")
def unfold_mode(spark, d):
    return _r(tensor.unfold(T.sales(spark, d), "i1", AXES))


@query(f"WITH {T.SALES} SELECT x.i1 AS a, y.i1 AS b, round(sum(x.v * y.v), 4) AS g FROM sales x JOIN sales y USING (i0, t) GROUP BY 1, 2")
def gram_mode(spark, d):
    return _r(tensor.gram(T.sales(spark, d), "i1", AXES), 4)


def _cos(rows: int, ranks: int, name: str) -> str:
    return f"{name} AS (SELECT a.range::INT AS row, b.range::INT AS rank, CASE WHEN b.range = 0 THEN {math.sqrt(1 / rows)!r}::DOUBLE ELSE {math.sqrt(2 / rows)!r}::DOUBLE END * cos({math.pi!r}::DOUBLE * (a.range + 0.5::DOUBLE) * b.range / {rows}.0::DOUBLE) AS u FROM range({rows}) a, range({ranks}) b)"


@query(f"WITH {T.SALES}, {_cos(25, 4, 'c')} SELECT c.rank AS i0, i1, t, round(sum(v * u), 5) + 0.0::DOUBLE AS v FROM sales JOIN c ON c.row = i0 GROUP BY 1, 2, 3")
def mode_product_dct(spark, d):
    return _r(tensor.mode_product(T.sales(spark, d), generators.cosine_factor(spark, 25, 4), "i0", True).select("i0", "i1", "t", "v"), 5)


def _dct(spark) -> dict[str, DataFrame]:
    return {"i0": generators.cosine_factor(spark, 25, 4), "i1": generators.cosine_factor(spark, 5, 3), "t": generators.cosine_factor(spark, T.MONTHS, 6)}


CORE = f"{T.SALES}, {_cos(25, 4, 'ca')}, {_cos(5, 3, 'cb')}, {_cos(T.MONTHS, 6, 'cc')}, core AS (SELECT ca.rank AS i0, cb.rank AS i1, cc.rank AS t, sum(v * ca.u * cb.u * cc.u) AS v FROM sales JOIN ca ON ca.row = i0 JOIN cb ON cb.row = i1 JOIN cc ON cc.row = t GROUP BY 1, 2, 3)"


@query(f"WITH {CORE} SELECT i0, i1, t, round(v, 4) + 0.0::DOUBLE AS v FROM core")
def tucker_core_dct(spark, d):
    return _r(tensor.multiply(T.sales(spark, d), _dct(spark), True).select("i0", "i1", "t", "v"), 4)


@query(f"WITH {CORE} SELECT ca.row AS i0, cb.row AS i1, cc.row AS t, round(sum(v * ca.u * cb.u * cc.u), 4) + 0.0::DOUBLE AS v FROM core JOIN ca ON ca.rank = i0 JOIN cb ON cb.rank = i1 JOIN cc ON cc.rank = t GROUP BY 1, 2, 3")
def tucker_reconstruct_dct(spark, d):
    f = _dct(spark)
    return _r(decomposition.reconstruct(tensor.multiply(T.sales(spark, d), f, True), f).select("i0", "i1", "t", "v"), 4)


@query(f"WITH {CORE} SELECT ca.row AS i0, cb.row AS i1, t, round(sum(v * ca.u * cb.u), 4) + 0.0::DOUBLE AS v FROM core JOIN ca ON ca.rank = i0 JOIN cb ON cb.rank = i1 GROUP BY 1, 2, 3")
def modes_time_insensitive(spark, d):
    f = _dct(spark)
    return _r(decomposition.modes(tensor.multiply(T.sales(spark, d), f, True), f).select("i0", "i1", "t", "v"), 4)


@query(f"WITH {T.SALES}, a AS (SELECT i0, i1 AS k, avg(v) AS u FROM sales GROUP BY 1, 2), b AS (SELECT i1, t // 12 AS k, avg(v) AS u FROM sales WHERE t < 60 GROUP BY 1, 2) SELECT (a.i0 * 5 + b.i1)::BIGINT AS cell, a.k, round(a.u * b.u, 4) + 0.0::DOUBLE AS v FROM a JOIN b USING (k)")
def standard_dictionary(spark, d):
    """Nations by priority with priorities by year: column k is the outer product of both k-th columns."""
    s = T.sales(spark, d)
    a = s.groupBy(F.col("i0").alias("row"), F.col("i1").alias("rank")).agg(F.avg("v").alias("u"))
    b = s.filter("t < 60").groupBy(F.col("i1").alias("row"), F.floor(F.col("t") / 12).cast("int").alias("rank")).agg(F.avg("v").alias("u"))
    return _r(decomposition.standard_dictionary(a, b, 5), 4)


@query()
def hooi_fit(spark, d):
    core, _, error = decomposition.distributed(T.sales(spark, d), AXES, [5, 3, 6])
    return core.withColumn("error", F.lit(error))


RANK_ONE = f"{T.SALES}, a AS (SELECT i0, avg(v) AS x FROM sales GROUP BY 1), b AS (SELECT i1, avg(v) AS y FROM sales GROUP BY 1), c AS (SELECT t, avg(v) AS z FROM sales GROUP BY 1), m AS (SELECT avg(v) AS w FROM sales)"


def _rank_one(spark, d) -> DataFrame:
    """The product of the sales' means along each axis: a tensor of rank one."""
    s = T.sales(spark, d)
    a, b, c = (s.groupBy(n).agg(F.avg("v").alias(m)) for n, m in (("i0", "x"), ("i1", "y"), ("t", "z")))
    scaled = a.crossJoin(F.broadcast(s.agg(F.avg("v").alias("w"))))  # 25 x 1, then 5 and 84 rows
    return scaled.crossJoin(F.broadcast(b)).crossJoin(F.broadcast(c)).select("i0", "i1", "t", (F.col("x") * F.col("y") * F.col("z") / (F.col("w") * F.col("w"))).alias("v"))


@query(f"WITH {RANK_ONE} SELECT i0, i1, k.range::INT AS t, round(coalesce(x * y * z / (w * w), 0), 4) + 0.0::DOUBLE AS v FROM a, b, m, range({T.MONTHS}) k LEFT JOIN c ON c.t = k.range")
def hooi_rank_one(spark, d):
    """Decomposed with one rank an axis and rebuilt, a tensor of rank one is itself."""
    return _r(decomposition.Decomposer(AXES, [1, 1, 1]).decompose(_rank_one(spark, d)).reconstruct().select("i0", "i1", "t", "v"), 4)


@query(f"WITH {FULL} SELECT i0, i1, t, round(v, 6) + 0.0::DOUBLE AS v FROM dense")
def hooi_full_rank(spark, d):
    """With all ranks nothing is lost."""
    return _r(decomposition.Decomposer(AXES, list(AXES.values())).decompose(_full(spark, d)).reconstruct().select("i0", "i1", "t", "v"))


@query(f"WITH {CORE} SELECT CASE WHEN s.range = 0 THEN 'one' ELSE 'two' END AS subject, ca.row AS i0, cb.row AS i1, t, round((1 + s.range) * sum(v * ca.u * cb.u), 4) + 0.0::DOUBLE AS v FROM core JOIN ca ON ca.rank = i0 JOIN cb ON cb.rank = i1, range(2) s GROUP BY s.range, ca.row, cb.row, t")
def modes_by_subject(spark, d):
    core = tensor.multiply(T.sales(spark, d), _dct(spark), True).select("i0", "i1", "t", "v")
    cores = core.withColumn("subject", F.lit("one")).unionByName(core.withColumn("v", 2 * F.col("v")).withColumn("subject", F.lit("two")))
    named = [u.withColumn("axis", F.lit(n)) for n, u in _dct(spark).items() if n != "t"]
    factors = named[0].unionByName(named[1]).crossJoin(spark.createDataFrame([("one",), ("two",)], "subject string"))
    return _r(decomposition.modes_by_subject(cores, factors, ["i0", "i1", "t"]), 4)


@query()
def hooi_subjects(spark, d):
    least, most = T.read(spark, d, "supplier").agg(F.min("s_suppkey"), F.max("s_suppkey")).first()
    rows = T.shipments(spark, d).withColumn("i0", (F.col("i0") + 1 - F.lit(least)).cast("int"))  # of the least key, 0 or 1
    return decomposition.per_subject_long(rows, {"i0": int(most - least + 1), "t": T.MONTHS}, [4, 4])


# --- placement and sensing --------------------------------------------------------------------------


@query("WITH n AS (SELECT vec_id::BIGINT AS cell, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS score FROM embeddings) SELECT cell, round(score, 4) AS score FROM n ORDER BY round(score, 9) DESC, cell LIMIT 1")
def qr_first_pivot(spark, d):
    norm = F.sqrt(F.aggregate("tube", F.lit(0.0), lambda a, x: a + x * x))
    return T.embeddings(spark, d).select("cell", norm.alias("score")).orderBy(F.desc(F.round("score", 9)), "cell").limit(1).select("cell", F.round("score", 4).alias("score"))


def _placed(spark, p: placement.Placement) -> DataFrame:
    return spark.createDataFrame([(i, c, s) for i, (c, s) in enumerate(zip(p.cells, p.scores))], "step int, cell long, score double")


def _pivots_sql(steps: int) -> str:
    """Greedy pivots: the longest remaining tube, whose direction is then taken out of the others."""
    norm = "sqrt(list_inner_product(tube, tube))"
    return (
        "WITH RECURSIVE s(step, cell, tube) AS (SELECT 0, vec_id::BIGINT, list_transform(embedding, lambda x: x::DOUBLE) FROM embeddings UNION ALL "
        "SELECT s.step + 1, s.cell, list_transform(list_zip(s.tube, p.tube), lambda z: z[1] - z[2] * list_inner_product(s.tube, p.tube) / list_inner_product(p.tube, p.tube)) "
        f"FROM s, (SELECT cell, tube FROM s ORDER BY round({norm}, 9) DESC, cell LIMIT 1) p WHERE s.cell <> p.cell AND s.step < {steps - 1}) "
        f"SELECT step, cell, round({norm}, 5) AS score FROM s QUALIFY row_number() OVER (PARTITION BY step ORDER BY round({norm}, 9) DESC, cell) = 1"
    )


@query(_pivots_sql(20))
def qr_placement(spark, d):
    return _r(_placed(spark, placement.place(T.embeddings(spark, d), 20)), 5)


@query(_pivots_sql(20))
def qr_distributed(spark, d):
    """The same pivots, found in passes over the rows."""
    return _r(_placed(spark, placement.place(T.embeddings(spark, d), 20, small=0)), 5)


def _basis(spark, d, r: int = 10) -> DataFrame:
    """Spatial modes of the sales tensor: its leading directions over time, per cell."""
    t = tensor.tubes(_cells(spark, d), ["cell"], T.MONTHS)
    g = sensing.gram(t, T.MONTHS)
    u = K.leading(g, r)
    return placement.project(t, u)


@query()
def qr_uniform(spark, d):
    return _placed(spark, placement.place(_basis(spark, d), 10, opt=placement.Options(uniform=True, shape=[25, 5])))


_AXIS_COUNTS = [f"len(list_filter(chosen, lambda x: {e('x')} = {e('cell')}))" for e in (lambda c: f"({c} // 16)", lambda c: f"(({c} // 4) % 4)", lambda c: f"({c} % 4)")]
_UNIFORM_SQL = (
    "WITH RECURSIVE s(step, cell, tube, chosen) AS (SELECT 0, vec_id::BIGINT, list_transform(embedding, lambda x: x::DOUBLE), []::BIGINT[] FROM embeddings UNION ALL "
    "SELECT s.step + 1, s.cell, list_transform(list_zip(s.tube, p.tube), lambda z: z[1] - z[2] * list_inner_product(s.tube, p.tube) / list_inner_product(p.tube, p.tube)), list_append(s.chosen, p.cell) "
    "FROM s, (SELECT cell, tube FROM (SELECT cell, tube, {score} AS score FROM s) ORDER BY round(score, 9) DESC, cell LIMIT 1) p WHERE s.cell <> p.cell AND s.step < 9) "
    "SELECT step, cell, round(score, 5) AS score FROM (SELECT step, cell, {last} AS score FROM s) QUALIFY row_number() OVER (PARTITION BY step ORDER BY round(score, 9) DESC, cell) = 1"
)
_NORM = "sqrt(list_inner_product(tube, tube))"
_CROWDED = f"CASE WHEN len(chosen) = 0 THEN 0 ELSE greatest(0, {_AXIS_COUNTS[2]} - len(chosen) / 4::DOUBLE) * 0.8::DOUBLE + ({' + '.join(_AXIS_COUNTS)})::DOUBLE / len(chosen) * 0.5::DOUBLE END"


@query(_UNIFORM_SQL.format(score=f"{_NORM} - max({_NORM}) OVER () * ({_CROWDED})", last=f"{_NORM} - max({_NORM}) OVER (PARTITION BY step) * ({_CROWDED})"))
def qr_uniform_passes(spark, d):
    """Even spreading on a grid of three axes, found in passes over the rows."""
    t = T.embeddings(spark, d)
    layers = t.agg(F.floor(F.max("cell") / 16) + 1).first()[0]
    return _r(_placed(spark, placement.place(t, 10, opt=placement.Options(uniform=True, shape=[layers, 4, 4]), small=0)), 5)


_W = {"gradient": 4, "amplitude": 5, "energy": 6}


def _geometry_sql(steps: int) -> str:
    """Pivots by sums of magnitudes with weights and a penalty near sensors; tubes are reflected step by step."""
    def scored(source: str, over: str) -> str:
        base = f"SELECT *, list_sum(list_transform(tube, lambda x: abs(x))) AS s0, CASE WHEN isinf(dmin) THEN 0 ELSE exp(-dmin / (2 + 1e-10::DOUBLE)) END AS near FROM {source}"
        for k, term in enumerate(("0.5::DOUBLE * g", "1.0::DOUBLE * a", "0.5::DOUBLE * e", "-1.0::DOUBLE * near")):
            base = f"SELECT *, s{k} + max(s{k}) OVER ({over}) * {term} AS s{k + 1} FROM ({base})"
        return base

    u = "list_transform(list_zip(p.tube, range(len(p.tube))), lambda z: (z[1] + CASE WHEN z[2] = 0 THEN (CASE WHEN abs(p.tube[1]) < 1e-6 THEN 1 ELSE sign(p.tube[1]) END) * p.norm ELSE 0 END) / sqrt(2 * p.norm * (p.norm + abs(p.tube[1]))))"
    return (
        "WITH RECURSIVE s(step, cell, tube, x, y, g, a, e, dmin) AS (SELECT 0, vec_id::BIGINT, list_transform(embedding, lambda v: v::DOUBLE), embedding[1]::DOUBLE * 10, embedding[2]::DOUBLE * 10, "
        "abs(embedding[4]::DOUBLE), abs(embedding[5]::DOUBLE), abs(embedding[6]::DOUBLE), 'inf'::DOUBLE FROM embeddings UNION ALL "
        "SELECT s.step + 1, s.cell, list_transform(list_zip(s.tube, p.u), lambda z: z[1] - 2 * z[2] * list_inner_product(s.tube, p.u))[2:], s.x, s.y, s.g, s.a, s.e, least(s.dmin, sqrt((s.x - p.x) ** 2 + (s.y - p.y) ** 2)) "
        f"FROM s, (SELECT *, {u} AS u FROM (SELECT cell, tube, x, y, sqrt(list_inner_product(tube, tube)) AS norm FROM ({scored('s', '')}) ORDER BY round(s4, 9) DESC, cell LIMIT 1) p) p WHERE s.cell <> p.cell AND s.step < {steps - 1}) "
        f"SELECT step, cell, round(s4, 5) AS score FROM ({scored('s', 'PARTITION BY step')}) QUALIFY row_number() OVER (PARTITION BY step ORDER BY round(s4, 9) DESC, cell) = 1"
    )


def _weighted(spark, d) -> DataFrame:
    t = T.embeddings(spark, d)
    at = F.array(F.col("tube")[0] * 10, F.col("tube")[1] * 10)
    return t.select("cell", "tube", at.alias("coord"), *[F.abs(F.col("tube")[k - 1]).alias(n) for n, k in _W.items()])


@query(_geometry_sql(8))
def qr_geometry_dense(spark, d):
    return _r(_placed(spark, placement.place(_weighted(spark, d), 8, opt=placement.Options(geometry=True))), 5)


@query(_geometry_sql(8))
def qr_geometry_passes(spark, d):
    """The same placement, found in passes over the rows."""
    return _r(_placed(spark, placement.place(_weighted(spark, d), 8, opt=placement.Options(geometry=True), small=0)), 5)


@query()
def qr_geometry(spark, d):
    cells, edges = _cells(spark, d), _edges(spark)
    w = {}
    for name, frame in (("gradient", graph.gradient_weight(cells, edges)), ("amplitude", graph.amplitude_weight(cells)), ("energy", graph.energy_weight(cells, edges))):
        w[name] = frame.orderBy("cell").toPandas()["v"].to_numpy()  # a mesh that fits the driver
    b = _basis(spark, d).orderBy("cell").toPandas()
    ids = b["cell"].to_numpy()
    coords = np.stack([ids % 5, ids // 5], axis=1).astype(float)
    return _placed(spark, placement.place_array(np.stack(b["tube"].to_numpy()), 10, ids, (), placement.Options(geometry=True), w, coords))


@query()
def qr_check(spark, d):
    t = T.embeddings(spark, d)
    c = placement.check(t, placement.place(t, 20))
    return spark.createDataFrame([(c["valid"], c["relative_error"], c["orthogonality"], c["sensors"])], "valid boolean, relative_error double, orthogonality double, sensors int")


@query("WITH l AS (SELECT vec_id, g.i, embedding[g.i + 1]::DOUBLE AS x FROM embeddings, (SELECT range::INT AS i FROM range(64)) g WHERE label < 3) SELECT a.i, b.i AS j, round(sum(a.x * b.x), 5) + 0.0::DOUBLE AS g FROM l a JOIN l b USING (vec_id) GROUP BY 1, 2")
def cs_gram(spark, d):
    g = sensing.gram(T.embeddings(spark, d).filter("label < 3"), 64)
    i, j = np.indices(g.shape)
    import pandas as pd

    return _r(spark.createDataFrame(pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "g": g.ravel()}), "i int, j int, g double"), 5)


def _sensing(spark, d, cfg=K.Sensing(), matrix=None):
    basis = _basis(spark, d).cache()
    sensors = spark.createDataFrame([(c,) for c in placement.place(basis, 10).cells], "cell long")
    truth = tensor.flatten(_full(spark, d), {"i0": 25, "i1": 5})
    return basis, truth, sensing.sense(basis, sensors, truth, ["t"], 10, cfg, matrix)


_ORTHONORMAL = f"{FULL}, {_cos(25, 3, 'a')}, {_cos(5, 3, 'b')}, u AS (SELECT a.row AS i0, b.row AS i1, a.rank AS k, a.u * b.u AS u FROM a JOIN b USING (rank)), y AS (SELECT t, k, sum(v * u) AS y FROM dense JOIN u USING (i0, i1) GROUP BY 1, 2), x AS (SELECT t, k, sign(y) * greatest(abs(y) - 0.01::DOUBLE, 0) / (1 + 1e-8::DOUBLE) AS x FROM y)"
_TIGHT = K.Sensing(tol=1e-10, max_iter=5000)


def _months(spark, d) -> DataFrame:
    """t, cell, v of the months that have sales: an empty field has no relative error."""
    return tensor.flatten(_full(spark, d).join(T.sales(spark, d).select("t").distinct(), "t", "left_semi"), {"i0": 25, "i1": 5})


def _cosines(spark) -> DataFrame:
    """An orthonormal basis of three modes, for which sparse recovery from all cells is a soft threshold."""
    return tensor.tubes(decomposition.standard_dictionary(generators.cosine_factor(spark, 25, 3), generators.cosine_factor(spark, 5, 3), 5), ["cell"], 3, "k")


@query(f"WITH {_ORTHONORMAL} SELECT t, k::INT AS k, round(x, 4) + 0.0::DOUBLE AS x FROM x")
def cs_orthonormal(spark, d):
    basis = _cosines(spark)
    solved = sensing.sense(basis, basis.select("cell"), tensor.flatten(_full(spark, d), {"i0": 25, "i1": 5}), ["t"], 3, _TIGHT)
    return _r(solved.select("t", F.posexplode("x").alias("k", "x")), 4)


def _rounds_sql(configs: list[tuple[str, str]], cfg: K.Sensing) -> str:
    """ADMM round by round on an orthonormal basis, whose Gram matrix is the identity: lists of three numbers a month."""
    soft = lambda v, k: f"list_transform({v}, lambda z: sign(z) * greatest(abs(z) - {k}, 0))"
    gap = lambda a, b: f"sqrt(list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))"
    zip3 = lambda a, b, c, f: f"list_transform(list_zip({a}, {b}, {c}), lambda z: {f})"
    relative = f"it > {cfg.window} AND (h[-{cfg.window}] - h[-1]) / greatest(h[-{cfg.window}], 1e-12) < {cfg.drop}"
    values = ", ".join(f"('{p}', '{s}')" for p, s in configs)
    return (
        f"WITH RECURSIVE {_ORTHONORMAL.replace(', x AS (', ', unused AS (')}, side AS (SELECT t, list(y ORDER BY k) AS b FROM y GROUP BY t), cfg(policy, stop) AS (VALUES {values}), "
        f"r(t, b, policy, stop, it, x, d, p, delta, h, done) AS (SELECT t, b, policy, stop, 0, [0.0::DOUBLE, 0, 0], [0.0::DOUBLE, 0, 0], [0.0::DOUBLE, 0, 0], {cfg.delta}::DOUBLE, []::DOUBLE[], false FROM side, cfg UNION ALL "
        f"SELECT t, b, policy, stop, it, x, dn, list_transform(pn, lambda z: z * f), nd, h, CASE WHEN stop IN ('residual', 'both') AND h[-1] < {cfg.tol} THEN true WHEN stop IN ('relative', 'both') THEN {relative} ELSE false END FROM ("
        f"SELECT *, list_append(h0, greatest(primal, dual)) AS h, CASE WHEN policy = 'cap_only' THEN delta WHEN primal > 10 * dual THEN least(2 * delta, {cfg.delta_max}) WHEN dual > 10 * primal THEN greatest(delta / 2, 1e-12) ELSE least(delta, {cfg.delta_max}) END AS nd, "
        f"CASE WHEN nd = delta THEN 1.0 WHEN primal > 10 * dual THEN 0.5 WHEN dual > 10 * primal THEN 2.0 ELSE 1.0 END AS f FROM ("
        f"SELECT *, {gap('x', 'dn')} AS primal, delta * {gap('dn', 'd')} AS dual, {zip3('p', 'm', 'dn', 'z[1] + z[2] - z[3]')} AS pn FROM ("
        f"SELECT *, {soft(zip3('m', 'p', 'p', 'z[1] + z[2]'), f'{cfg.epsilon} / delta')} AS dn FROM ("
        f"SELECT *, {zip3('x', 'd', 'd', f'{cfg.relax} * z[1] + (1 - {cfg.relax}::DOUBLE) * z[2]')} AS m FROM ("
        f"SELECT t, b, policy, stop, it + 1 AS it, {zip3('b', 'd', 'p', f'(z[1] + delta * (z[2] - z[3])) / (1 + delta + {cfg.reg}::DOUBLE)')} AS x, d, p, delta, h AS h0 FROM r WHERE NOT done AND it < {cfg.max_iter}))))))"
    )


_STOPS = [("boyd", "residual"), ("boyd", "both"), ("cap_only", "residual"), ("cap_only", "relative"), ("cap_only", "both")]
_SLOW = K.Sensing(delta=5.0, delta_max=5.0, max_iter=30, tol=1e-2, drop=0.6)  # stops before rounding decides
_ROUNDS = K.Sensing(delta=0.5, max_iter=12, tol=0.0, policy="boyd")


def _all_cells(spark, d) -> tuple[DataFrame, np.ndarray]:
    """Right-hand sides of every month on the orthonormal basis, and its Gram matrix."""
    basis = _cosines(spark)
    return sensing.right_sides(basis, tensor.flatten(_full(spark, d), {"i0": 25, "i1": 5}), ["t"]), sensing.gram(basis, 3)


@query(f"{_rounds_sql(_STOPS, _SLOW)} SELECT t, policy || '/' || stop AS config, max(it)::INT AS iterations, bool_or(done) AS converged, round(arg_max(delta, it), 6) AS delta, round(arg_max(h[-1], it), 6) AS residual FROM r GROUP BY 1, 2")
def cs_stops(spark, d):
    """Every policy and stop: how many rounds each takes, where it ends."""
    sides, g = _all_cells(spark, d)
    out = [sensing.solve(sides, g, ["t"], replace(_SLOW, policy=p, stop=s)).select("t", F.lit(f"{p}/{s}").alias("config"), "iterations", "converged", "delta", F.element_at("history", -1).alias("residual")) for p, s in _STOPS]
    for x in out[1:]:
        out[0] = out[0].unionByName(x)
    return _r(out[0])


@query(f"{_rounds_sql([('boyd', 'residual')], _ROUNDS)} SELECT t, k.range::INT AS k, round(x[k.range + 1], 6) + 0.0::DOUBLE AS x, len(h)::INT AS rounds FROM r, range(3) k WHERE it = {_ROUNDS.max_iter}")
def cs_continued(spark, d):
    """Five rounds, then seven more from where they ended: as twelve at once."""
    sides, g = _all_cells(spark, d)
    first = sensing.solve(sides, g, ["t"], replace(_ROUNDS, max_iter=5), keep=True)
    done = sensing.solve(sides, g, ["t"], replace(_ROUNDS, max_iter=_ROUNDS.max_iter - 5), before=first)
    return _r(done.select("t", F.posexplode("x").alias("k", "x"), F.size("history").alias("rounds")))


@query(f"{_rounds_sql([('boyd', 'residual')], _SLOW)} SELECT t, it::INT AS iteration, round(delta, 6) AS delta, round(h[-1], 6) AS residual FROM r WHERE it > 0")
def cs_trace(spark, d):
    """A row a round of every solve."""
    sides, g = _all_cells(spark, d)
    rows = sensing.trace(sides, g, ["t"], replace(_SLOW, policy="boyd"))
    return _r(rows.select("t", "iteration", "delta", F.greatest("primal", "dual").alias("residual")))


_SWEPT = f"{_ORTHONORMAL}, rec AS (SELECT t, i0, i1, sum(x * u) AS rec FROM x JOIN u USING (k) GROUP BY 1, 2, 3), f AS (SELECT t, sqrt(sum((rec - v) ** 2)) / sqrt(sum(v ** 2)) AS error, avg((rec - v) ** 2) AS mse, 20 * log10((max(v) - min(v)) / sqrt(avg((rec - v) ** 2))) AS psnr FROM rec JOIN dense USING (t, i0, i1) WHERE t IN (SELECT t FROM sales) GROUP BY t)"
_SUMMED = ", ".join(f"round(avg({n}), 4) AS {n}_mean, round(stddev_samp({n}), 4) AS {n}_std, round(avg({n}) - 1.96::DOUBLE * stddev_samp({n}) / sqrt(count(*)), 4) AS {n}_ci_lower, round(avg({n}) + 1.96::DOUBLE * stddev_samp({n}) / sqrt(count(*)), 4) AS {n}_ci_upper" for n in ("error", "psnr", "mse"))


@query(f"WITH {_SWEPT} SELECT 125 AS sensors, {_SUMMED}, count(*) AS num_samples FROM f")
def sweep_all_cells(spark, d):
    """A sweep whose one set of sensors is every cell, on the orthonormal basis."""
    basis, truth = _cosines(spark), _months(spark, d)
    cfg = experiments.Config(tol=1e-10, max_iter=5000, delta=1.0)
    out = experiments.sweep(basis, truth, ["t"], 3, [CELLS], cfg, lambda n: basis.select("cell"), (25, 5))
    return _r(out.drop(*[c for c in out.columns if c.startswith("ssim")]), 4)


@query(f"WITH {_SWEPT} SELECT basis, placement, round(avg(sqrt(mse)), 4) AS rmse, round(avg(error), 4) AS error FROM f, (VALUES ('cosines', 'all'), ('cosines', 'again')) n(basis, placement) GROUP BY 1, 2")
def cross_cases(spark, d):
    """Bases against sets of sensors."""
    basis, truth = _cosines(spark), _months(spark, d)
    sets = {"all": basis.select("cell"), "again": basis.select("cell").unionByName(basis.select("cell"))}
    table = experiments.cases({"cosines": (basis, 3)}, sets, truth, ["t"], experiments.Config(tol=1e-10, max_iter=5000, delta=1.0), (25, 5))
    return _r(table.select("basis", "placement", "rmse", "error"), 4)


@query(f"WITH {_ORTHONORMAL}, o AS (SELECT t, (SELECT sum(v * v) FROM dense g WHERE g.t = x.t) AS yy, sum(x * x) AS xx, sum(x * y) AS xy, sum(abs(x)) AS l FROM x JOIN y USING (t, k) GROUP BY t) SELECT t, 0.01::DOUBLE AS epsilon, round(0.5::DOUBLE * (xx - 2 * xy + yy) + 0.01::DOUBLE * l, 2) AS objective FROM o")
def grid_search_best(spark, d):
    """Of two weights of sparsity, the smaller gives the lesser objective in every month."""
    basis = _cosines(spark)
    sides = sensing.right_sides(basis, tensor.flatten(_full(spark, d), {"i0": 25, "i1": 5}), ["t"])
    table = experiments.grid_search(sides, sensing.gram(basis, 3), ["t"], [0.5, 0.01], [0.95])
    return _r(table.filter("place = 1").select("t", "epsilon", "objective"), 2)


@query()
def cs_solve(spark, d):
    return _sensing(spark, d)[2]


@query()
def cs_policies(spark, d):
    out = None
    for solver, policy, stop in (("cholesky", "boyd", "residual"), ("direct", "cap_only", "relative"), ("svd", "boyd", "both")):
        one = _sensing(spark, d, K.Sensing(solver=solver, policy=policy, stop=stop, delta=0.1))[2].select("t", F.lit(f"{solver}/{policy}/{stop}").alias("config"), "iterations", "converged", "objective")
        out = one if out is None else out.unionByName(one)
    return out


@query()
def cs_geometry(spark, d):
    m = graph.laplacian(_edges(spark), graph.grid_vertices(spark, [25, 5]), True)
    return _sensing(spark, d, matrix=m)[2].select("t", "x", "iterations", "converged")


@query()
def cs_field(spark, d):
    basis, truth, solved = _sensing(spark, d)
    return experiments.scores(basis, truth, solved, ["t"], (25, 5))


@query()
def experiment_sweep(spark, d):
    truth = tensor.flatten(_full(spark, d), {"i0": 25, "i1": 5})
    return experiments.analytics(experiments.sweep(_basis(spark, d), truth, ["t"], 10, [4, 8], shape=(25, 5)))


# --- sensors and wells -------------------------------------------------------------------------------

PLACED = f"{T.WELLS}, {T.SENSORS}, w AS (SELECT row, col, min(well_idx) AS well_idx FROM wells WHERE row < 100 AND col < 100 GROUP BY 1, 2), near AS (SELECT w.*, sqrt((w.row - s.row) ** 2 + (w.col - s.col) ** 2) AS d, s.row AS s_row, s.col AS s_col FROM w JOIN sensors s ON abs(w.row - s.row) <= 2 AND abs(w.col - s.col) <= 2 WHERE sqrt((w.row - s.row) ** 2 + (w.col - s.col) ** 2) <= 2)"


def _wells(spark, d) -> DataFrame:
    return analysis.wells(T.places(spark, d), 100, 100).groupBy("row", "col").agg(F.min("well_idx").alias("well_idx"))


def _sensors(spark, d) -> DataFrame:
    return T.places(spark, d, "sensors")


@query(f"WITH {T.WELLS}, w AS (SELECT subject, row, col, min(well_idx) AS well_idx FROM wells WHERE row BETWEEN 0 AND 99 AND col BETWEEN 0 AND 99 GROUP BY 1, 2, 3) SELECT subject, row, col, well_idx FROM w QUALIFY row_number() OVER (PARTITION BY subject ORDER BY well_idx, row, col) <= 3")
def wells_first_n(spark, d):
    return analysis.first_wells(T.places(spark, d), 3, 100, 100)


@query(f"WITH {PLACED} SELECT well_idx, s_row, s_col, round(d, 6) AS d FROM near")
def sensors_within_radius(spark, d):
    return _r(analysis.within(_sensors(spark, d), _wells(spark, d), 2).select("well_idx", "s_row", "s_col", "d"))


@query(f"WITH {PLACED}, m AS (SELECT w.well_idx, s.row IS NOT NULL AS hit, (SELECT min(d) FROM near n WHERE n.well_idx = w.well_idx) AS dmin FROM w LEFT JOIN sensors s USING (row, col)) SELECT count(*) AS total_wells, count(*) FILTER (hit) AS exact_overlaps, count(*) FILTER (NOT hit) AS wells_without_sensor, count(*) FILTER (NOT hit AND dmin IS NOT NULL) AS wells_with_near_sensor, count(*) FILTER (NOT hit AND dmin IS NULL) AS uncovered_wells, round(min(dmin) FILTER (NOT hit), 6) AS min_near_distance, (SELECT count(*) FROM sensors) AS total_sensors, round(100.0::DOUBLE * count(*) FILTER (hit) / count(*), 6) AS overlap_percent FROM m")
def overlap_stats(spark, d):
    return _r(analysis.overlap(_sensors(spark, d), _wells(spark, d), 2))


@query(f"WITH {PLACED} SELECT row, col, well_idx FROM w ANTI JOIN sensors USING (row, col)")
def wells_uncovered(spark, d):
    return tensor.available(_wells(spark, d), _sensors(spark, d), ["row", "col"])


_LEFT_SQL = SQL["overlap_stats"].replace("JOIN sensors s", "JOIN (SELECT * FROM sensors WHERE col < 50) s").replace("FROM sensors)", "FROM sensors WHERE col < 50)")


@query(f"SELECT *, 'all' AS placement FROM ({SQL['overlap_stats']}) UNION ALL SELECT *, 'left' FROM ({_LEFT_SQL})")
def compare_placements(spark, d):
    s = _sensors(spark, d)
    return _r(analysis.compare({"all": s, "left": s.filter("col < 50")}, _wells(spark, d)))


COUNTED = f"{PLACED}, c AS (SELECT w.well_idx, w.row, w.col, count(n.d) AS raw_count FROM w LEFT JOIN near n USING (well_idx) GROUP BY 1, 2, 3)"
_NORM_SQL = {
    "none": "raw_count::DOUBLE",
    "max": "CASE WHEN max(raw_count) OVER () > 0 THEN raw_count::DOUBLE / max(raw_count) OVER () ELSE 0 END",
    "total_sensors": "raw_count::DOUBLE / (SELECT count(*) FROM sensors)",
    "local_area": "raw_count::DOUBLE / (SELECT count(*) FROM range(-2, 3) a, range(-2, 3) b WHERE a.range ** 2 + b.range ** 2 <= 4 AND c.row + a.range BETWEEN 0 AND 99 AND c.col + b.range BETWEEN 0 AND 99)",
    "zscore": "coalesce((raw_count - avg(raw_count) OVER ()) / nullif(stddev_samp(raw_count) OVER (), 0), 0)",
    "minmax": "coalesce((raw_count - min(raw_count) OVER ())::DOUBLE / nullif(max(raw_count) OVER () - min(raw_count) OVER (), 0), 0)",
}


def _ranking(norm: str):
    def run(spark, d):
        return _r(analysis.rank_by_proximity(_sensors(spark, d), _wells(spark, d), 100, 100, 2, "l2", norm))

    run.__name__ = f"rank_proximity_{norm}"
    return query(f"WITH {COUNTED}, s AS (SELECT well_idx, row, col, raw_count, {_NORM_SQL[norm]} AS score FROM c) SELECT well_idx, row, col, raw_count, round(score, 6) + 0.0::DOUBLE AS score, (row_number() OVER (ORDER BY score DESC, raw_count DESC, well_idx))::INT AS rank FROM s")(run)


for _n in analysis.NORMS:
    _ranking(_n)


@query(f"WITH {COUNTED} SELECT well_idx, row, col, raw_count, raw_count::DOUBLE AS score, (row_number() OVER (ORDER BY raw_count DESC, well_idx))::INT AS rank FROM c ORDER BY raw_count DESC, well_idx LIMIT 10")
def rank_head(spark, d):
    """The head of a ranking, from the first rows of each task."""
    return analysis.rank_by_proximity(_sensors(spark, d), _wells(spark, d), 100, 100, 2, top=10)


@query("SELECT c_custkey AS cell, c_acctbal AS v, (row_number() OVER (ORDER BY c_acctbal DESC, c_custkey))::INT AS rank FROM customer")
def rank_global(spark, d):
    """Ranks over a whole table by range partitions and the counts before them."""
    return ranks.ranked(T.read(spark, d, "customer").select(F.col("c_custkey").alias("cell"), F.col("c_acctbal").alias("v")), [F.desc("v"), "cell"])


@query(f"WITH {T.SENSORS} SELECT 'S' || row_number() OVER (ORDER BY row, col) AS name, row, col FROM sensors")
def ranking_sensor_points(spark, d):
    wells = _wells(spark, d)
    maps = sinks.ranking_maps(tensor.grid(spark, {"row": 100, "col": 100}).withColumn("v", F.lit(1.0)), _sensors(spark, d), analysis.rank_by_proximity(_sensors(spark, d), wells, 100, 100))
    return maps["sensors_points"]



@query()
def rank_informativeness(spark, d):
    basis = tensor.grid(spark, {"row": 100, "col": 100}).withColumn("tube", F.array(*[F.cos(F.col("row") * (0.01 * k) + F.col("col") * (0.02 * k)) for k in range(1, 5)]))
    return analysis.informativeness(_sensors(spark, d), _wells(spark, d), basis, 100, 100)


CENTRES = "c(cluster, r, k) AS (VALUES (0, 20.0::DOUBLE, 20.0::DOUBLE), (1, 70.0::DOUBLE, 30.0::DOUBLE), (2, 50.0::DOUBLE, 80.0::DOUBLE)), g AS (SELECT a.range::INT AS row, b.range::INT AS col FROM range(100) a, range(100) b), p AS (SELECT row, col, arg_min(cluster, sqrt((row - r) ** 2 + (col - k) ** 2) + cluster * 1e-9) AS cluster FROM g, c GROUP BY 1, 2)"


def _centres(spark) -> DataFrame:
    return spark.createDataFrame([(0, 20.0, 20.0), (1, 70.0, 30.0), (2, 50.0, 80.0)], "cluster int, row double, col double")


def _grid100(spark) -> DataFrame:
    return tensor.grid(spark, {"row": 100, "col": 100})


@query(f"WITH {CENTRES}, {T.SENSORS} SELECT row, col, cluster, (s.row IS NOT NULL)::INT AS sensor FROM p LEFT JOIN sensors s USING (row, col)")
def cluster_nearest(spark, d):
    """The cluster of every cell of the grid, and whether a sensor is there."""
    marked = _sensors(spark, d).withColumn("_s", F.lit(1))
    return analysis.nearest_centre(_grid100(spark), _centres(spark)).join(marked, ["row", "col"], "left").select("row", "col", "cluster", F.coalesce("_s", F.lit(0)).alias("sensor"))


@query(f"WITH {CENTRES}, {T.SENSORS}, m AS (SELECT cluster, count(s.row) AS sensors, count(*) AS area FROM p LEFT JOIN sensors s USING (row, col) GROUP BY 1), q AS (SELECT *, sensors::DOUBLE / sum(sensors) OVER () AS p_c_s, sensors::DOUBLE / area AS p_s_c, area::DOUBLE / sum(area) OVER () AS p_c FROM m) SELECT cluster, sensors, area, round(p_c_s, 6) AS p_c_s, round(p_s_c, 6) AS p_s_c, round(p_c, 6) AS p_c, round(p_s_c * p_c / sum(p_s_c * p_c) OVER (), 6) AS bayes FROM q")
def cluster_bayes(spark, d):
    return _r(analysis.cluster_probabilities(_grid100(spark), _centres(spark), _sensors(spark, d)))


@query()
def cluster_kmeans(spark, d):
    return analysis.kmeans(_wells(spark, d), 5)


@query(f"WITH {T.SALES} SELECT (i1 + 1)::INT AS \"I\", (i0 + 1)::INT AS \"J\", 1 AS \"K\", printf('%.6f', round(v, 2)) AS \"Value\" FROM sales WHERE t = 7")
def export_ijk(spark, d):
    s = tensor.time_slice(T.sales(spark, d), 7).select(F.col("i0").alias("row"), F.col("i1").alias("col"), F.round("v", 2).alias("v"))
    return sinks.ijk(s)


@query(f"WITH {CENTRES}, {T.SENSORS} SELECT row, col, (cluster + 1)::INT AS region, (s.row IS NOT NULL)::INT AS mask FROM p LEFT JOIN sensors s USING (row, col)")
def export_cluster_map(spark, d):
    m = sinks.cluster_maps(analysis.nearest_centre(_grid100(spark), _centres(spark)), _wells(spark, d), _sensors(spark, d), _centres(spark))
    return m["cluster_region"].join(m["sensors_mask"], ["row", "col"])


# --- generators ------------------------------------------------------------------------------------


def entry(spark: SparkSession, d: str) -> DataFrame:
    """Prices by nation, priority and month, normalised, split in time, and the error of each
    nation's mean over its training months on the test months."""
    s = T.sales(spark, d)
    parts = stats.split_ordered(stats.apply(s, stats.fit(s), "minmax"), 0.8, ["i0"])
    mean = parts.filter("part = 'train'").groupBy("i0", "i1").agg(F.avg("v").alias("rec"))
    pairs = parts.filter("part = 'test'").join(mean, ["i0", "i1"]).withColumnRenamed("v", "ref")
    return _r(stats.metrics(pairs, ["i0"]).select("i0", "error", "mse"))


QUERIES["flagship"] = entry
SQL["flagship"] = f"WITH {T.SALES}, m AS (SELECT min(v) AS lo, max(v) AS hi FROM sales), n AS (SELECT i0, i1, t, (v - lo) / (hi - lo + 1e-8::DOUBLE) AS v FROM sales, m), f AS (SELECT i0, t, row_number() OVER (PARTITION BY i0 ORDER BY t) - 1 AS r, count(*) OVER (PARTITION BY i0) AS k FROM (SELECT DISTINCT i0, t FROM n)), p AS (SELECT n.*, r < floor(k * 0.8::DOUBLE + 1e-9) AS train FROM n JOIN f USING (i0, t)), a AS (SELECT i0, i1, avg(v) AS rec FROM p WHERE train GROUP BY 1, 2) SELECT i0, round(sqrt(sum((rec - v) ** 2)) / sqrt(sum(v ** 2)), 6) AS error, round(avg((rec - v) ** 2), 6) AS mse FROM p JOIN a USING (i0, i1) WHERE NOT train GROUP BY i0"
