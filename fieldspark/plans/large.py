"""Queries of tensors in blocks and of axes whose factors are tables."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldspark.operators import blocks, graph, placement, stats, tall, tensor, triangulation
from fieldspark.plans import tables as T
from fieldspark.plans.queries import AXES, CELLS, CORE, POINTS, _points, _r, query

SIZES = {"i0": 8, "i1": 5, "t": 30}


def cosines(rows: int, ranks: int) -> np.ndarray:
    i, k = np.arange(rows)[:, None], np.arange(ranks)
    return np.where(k == 0, math.sqrt(1 / rows), math.sqrt(2 / rows)) * np.cos(math.pi * (i + 0.5) * k / rows)


DCT = {"i0": cosines(25, 4), "i1": cosines(5, 3), "t": cosines(T.MONTHS, 6)}


def _sales(spark, d) -> blocks.Blocks:
    return blocks.from_coo(T.sales(spark, d), AXES, SIZES)


@query(f"WITH {T.SALES} SELECT i0, i1, t, round(v, 6) AS v FROM sales")
def blocks_roundtrip(spark, d):
    """To blocks, to blocks of other sizes, and back."""
    return _r(blocks.to_coo(blocks.reblock(_sales(spark, d), {"i0": 6, "i1": 2, "t": T.MONTHS})))


@query(f"WITH {CORE} SELECT i0, i1, t, round(v, 4) + 0.0::DOUBLE AS v FROM core")
def blocks_core(spark, d):
    return _r(blocks.to_coo(blocks.multiply(_sales(spark, d), DCT), zeros=True), 4)


@query(f"WITH {CORE} SELECT ca.row AS i0, cb.row AS i1, cc.row AS t, round(sum(v * ca.u * cb.u * cc.u), 4) + 0.0::DOUBLE AS v FROM core JOIN ca ON ca.rank = i0 JOIN cb ON cb.rank = i1 JOIN cc ON cc.rank = t GROUP BY 1, 2, 3")
def blocks_reconstruct(spark, d):
    core = blocks.small(blocks.multiply(_sales(spark, d), DCT))
    return _r(blocks.to_coo(blocks.reconstruct(spark, core, DCT, SIZES), zeros=True), 4)


@query(f"WITH {T.SALES}, g AS (SELECT x.t AS a, y.t AS b, sum(x.v * y.v) AS g FROM sales x JOIN sales y USING (i0, i1) GROUP BY 1, 2) SELECT p.range::INT AS a, q.range::INT AS b, round(coalesce(g, 0), 3) + 0.0::DOUBLE AS g FROM range({T.MONTHS}) p CROSS JOIN range({T.MONTHS}) q LEFT JOIN g ON g.a = p.range AND g.b = q.range")
def blocks_gram(spark, d):
    g = blocks.gram(_sales(spark, d), "t")
    i, j = np.indices(g.shape)
    rows = list(zip(i.ravel().tolist(), j.ravel().tolist(), g.ravel().tolist()))
    return _r(spark.createDataFrame(rows, "a int, b int, g double"), 3)


BUYERS = "o AS (SELECT (o_custkey - 1)::INT AS c, ((year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1)::INT AS t, o_totalprice / 1e3::DOUBLE AS v FROM orders), a AS (SELECT c, sum(v) AS x FROM o GROUP BY 1), b AS (SELECT t, sum(v) AS y FROM o GROUP BY 1), w AS (SELECT sum(v) AS z FROM o)"


def _buyers(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    o = T.read(spark, d, "orders").select((F.col("o_custkey") - 1).cast("int").alias("c"), T.month("o_orderdate").alias("t"), (F.col("o_totalprice") / F.lit(1e3)).alias("v"))
    return o.groupBy("c").agg(F.sum("v").alias("x")), o.groupBy("t").agg(F.sum("v").alias("y")), o.agg(F.sum("v").alias("z"))


@query(f"WITH {BUYERS} SELECT c, t, round(x * y / z, 3) AS v FROM a, b, w")
def tucker_long_axis(spark, d):
    """Customers by months, with the customers' factor as a table: decomposed and rebuilt, a tensor of rank one is itself."""
    a, b, w = _buyers(spark, d)
    coo = a.crossJoin(F.broadcast(b)).crossJoin(F.broadcast(w)).select("c", "t", (F.col("x") * F.col("y") / F.col("z")).alias("v"))  # 84 months, one sum
    most = T.read(spark, d, "orders").agg(F.max("o_custkey")).first()[0]
    t = blocks.from_coo(coo, {"c": int(most), "t": T.MONTHS}, {"c": 256, "t": T.MONTHS})
    core, factors, _ = tall.tucker(t, [1, 1], ("c",))
    return _r(blocks.to_coo(tall.reconstruct(spark, core, factors)), 3)


def _path(spark, cells: int) -> DataFrame:
    """The Laplacian of cells in a line, whose eigenvectors are cosines."""
    return graph.laplacian(graph.grid_edges(spark, [cells]), graph.grid_vertices(spark, [cells]))


ALPHA, BETA = 0.3, (5.0, 20.0)
LINE = f"""f AS (SELECT i0 * 5 + i1 AS cell, sum(v) AS x, sum(CASE WHEN t < 42 THEN v ELSE 0 END) AS y FROM sales GROUP BY 1),
e AS (SELECT a.range::INT AS cell, k.range::INT AS k, CASE WHEN k.range = 0 THEN {math.sqrt(1 / CELLS)!r}::DOUBLE ELSE {math.sqrt(2 / CELLS)!r}::DOUBLE END * cos({math.pi!r}::DOUBLE * (a.range + 0.5::DOUBLE) * k.range / {CELLS}.0::DOUBLE) AS u,
  pow(2 - 2 * cos({math.pi!r}::DOUBLE * k.range / {CELLS}.0::DOUBLE), 2) AS l2 FROM range({CELLS}) a, range({CELLS}) k),
c AS (SELECT k, any_value(l2) AS l2, sum(x * u) AS x, sum(y * u) AS y FROM e JOIN f USING (cell) GROUP BY 1)"""


@query(f"WITH {T.SALES}, {LINE} SELECT cell, round(sum(u * x / ({BETA[0]} + {ALPHA} * l2)), 3) + 0.0::DOUBLE AS x, round(sum(u * y / ({BETA[1]} + {ALPHA} * e.l2)), 3) + 0.0::DOUBLE AS y FROM e JOIN (SELECT k, x, y FROM c) c USING (k) GROUP BY 1")
def smooth_solve(spark, d):
    """Two fields smoothed at once by conjugate gradients over blocks of edges; in the eigenvectors the solution is a division."""
    s = tensor.flatten(T.sales(spark, d), {"i0": 25, "i1": 5})
    both = s.select("cell", F.lit(0).alias("rank"), "v").unionByName(s.filter("t < 42").select("cell", F.lit(1).alias("rank"), "v"))
    rhs = blocks.from_coo(both, {"cell": CELLS, "rank": 2}, {"cell": 16, "rank": 2})
    found = tall.smooth_solve(tall.edge_blocks(_path(spark, CELLS), 16), rhs, ALPHA, np.array(BETA), tol=1e-7)
    coo = blocks.to_coo(found, zeros=True).groupBy("cell").agg(*[F.sum(F.when(F.col("rank") == k, F.col("v"))).alias(n) for k, n in ((0, "x"), (1, "y"))])
    return _r(coo, 3)


@query(f"WITH {T.SALES}, m AS (SELECT t, sum(v) AS y FROM sales GROUP BY 1) SELECT k.range::INT AS cell, s.range::INT AS t, round(coalesce(y, 0) * cos({math.pi!r}::DOUBLE * (k.range + 0.5::DOUBLE) * 3 / {CELLS}.0::DOUBLE), 4) + 0.0::DOUBLE AS v FROM range({CELLS}) k CROSS JOIN range({T.MONTHS}) s LEFT JOIN m ON m.t = s.range WHERE k.range <> 62")
def geometry_tucker_eigen(spark, d):
    """A field along an eigenvector of the mesh stays as it is when it is smoothed; cell 62, the middle, is a zero of it."""
    m = T.sales(spark, d).groupBy("t").agg(F.sum("v").alias("y"))
    cells = spark.range(CELLS).filter("id <> 62").select(F.col("id").cast("int").alias("cell"), F.cos(F.lit(math.pi) * (F.col("id") + F.lit(0.5)) * F.lit(3) / F.lit(float(CELLS))).alias("u"))
    coo = cells.crossJoin(F.broadcast(m)).select("cell", "t", (F.col("u") * F.col("y")).alias("v"))  # 84 months
    t = blocks.from_coo(coo, {"cell": CELLS, "t": T.MONTHS}, {"cell": 32, "t": T.MONTHS})
    core, factors, _ = tall.tucker(t, [1, 1], ("cell",), {"cell": _path(spark, CELLS)}, alpha=0.5)
    return _r(blocks.to_coo(tall.reconstruct(spark, core, factors), zeros=True).filter("cell <> 62"), 4)


@query()
def geometry_tucker(spark, d):
    """The sales' cells on their grid, smoothed by its normalised Laplacian: part, mode, row, rank, value as ``decomposition.per_subject``."""
    t = blocks.from_coo(tensor.flatten(T.sales(spark, d), {"i0": 25, "i1": 5}).withColumn("cell", F.col("cell").cast("int")), {"cell": CELLS, "t": T.MONTHS}, {"cell": 32, "t": T.MONTHS})
    mesh = graph.laplacian(graph.grid_edges(spark, [25, 5]), graph.grid_vertices(spark, [25, 5]), True)
    core, factors, error = tall.tucker(t, [5, 5], ("cell",), {"cell": mesh}, rounds=50)
    rows = [("error", -1, 0, 0, error)] + [("core", -1, i, 0, float(x)) for i, x in enumerate(core.ravel())]
    rows += [("factor", 1, int(i), int(k), float(x)) for (i, k), x in np.ndenumerate(factors["t"])]
    out = blocks.to_coo(factors["cell"], zeros=True).select(F.lit("factor").alias("part"), F.lit(0).alias("mode"), F.col("cell").alias("row"), "rank", F.col("v").alias("value"))
    return out.unionByName(spark.createDataFrame(rows, "part string, mode int, row int, rank int, value double")).select(F.lit("sales").alias("subject"), "*")


@query(f"""WITH {POINTS}, e AS (SELECT a.cell AS src, b.cell AS dst, (a.x + b.x) / 2 AS mx, (a.y + b.y) / 2 AS my, (b.x - a.x) / 2 AS hx, (b.y - a.y) / 2 AS hy FROM v a JOIN v b ON a.cell < b.cell),
c AS (SELECT src, dst, hx, hy, hx * (y - my) - hy * (x - mx) AS s, (x - mx) ** 2 + (y - my) ** 2 - hx * hx - hy * hy AS f FROM e, v WHERE cell <> src AND cell <> dst),
d AS (SELECT src, dst, 2 * sqrt(any_value(hx) ** 2 + any_value(hy) ** 2) AS dist FROM c GROUP BY 1, 2 HAVING coalesce(max(CASE WHEN s < 0 THEN f / (2 * s) END), '-infinity'::DOUBLE) < coalesce(min(CASE WHEN s > 0 THEN f / (2 * s) END), 'infinity'::DOUBLE))
SELECT src, dst, round(dist, 6) AS dist FROM d UNION ALL SELECT dst, src, round(dist, 6) FROM d""")
def delaunay_tiles(spark, d):
    """An edge is in the triangulation where some circle through its ends holds no other point."""
    return _r(triangulation.delaunay(_points(spark, d), 48).select("src", "dst", "dist"))


@query(f"""WITH {T.SALES}, m AS (SELECT *, avg(v) OVER (PARTITION BY i0, t) AS a, avg(v) OVER (PARTITION BY i0, i1) AS b, avg(v) OVER (PARTITION BY i0) AS c FROM sales),
r AS (SELECT 'nation' AS name, c AS rec, v FROM m UNION ALL SELECT 'month', a, v FROM m UNION ALL SELECT 'priority', b, v FROM m UNION ALL SELECT 'both', a + b - c, v FROM m),
s AS (SELECT name, sqrt(avg((rec - v) ** 2)) AS rmse, avg(abs(rec - v)) AS mae, sqrt(sum((rec - v) ** 2)) / sqrt(sum(v * v)) AS error FROM r GROUP BY 1)
SELECT name, round(s.rmse, 4) AS rmse, round(mae, 4) AS mae, round(error, 6) AS error, round(100 * (x.rmse - s.rmse) / x.rmse, 4) + 0.0::DOUBLE AS improvement FROM s, (SELECT rmse FROM s WHERE name = 'nation') x""")
def physical_cases(spark, d):
    """Four rebuilt fields, each made in the nations' own scales, compared in prices, and how much better than the first each is."""
    s = T.sales(spark, d)
    params = stats.fit(s, ["i0"])
    n = stats.apply(s, params, "minmax", ["i0"])
    for name, keys in (("month", ["i0", "t"]), ("priority", ["i0", "i1"]), ("nation", ["i0"])):
        n = n.join(n.groupBy(*keys).agg(F.avg("v").alias(name)), keys)
    both = (F.col("month") + F.col("priority") - F.col("nation")).alias("both")
    cases = n.select("i0", F.col("v").alias("ref"), "nation", "month", "priority", both).unpivot(["i0", "ref"], ["nation", "month", "priority", "both"], "name", "rec")
    out = stats.improvements(stats.physical(cases, params, "minmax", ["i0"], ["name"]), "name", "nation")
    return _r(_r(out.select("name", "rmse", "mae", "error", "improvement"), 4, "rmse", "mae", "improvement"), 6, "error")


@query("""SELECT dataset, (SELECT count(*) FROM sales) AS n, true AS near FROM (VALUES ('noisy_dataset_1'), ('noisy_dataset_2'), ('noisy_dataset_3')) d(dataset)""".replace("SELECT dataset", f"WITH {T.SALES} SELECT dataset", 1))
def noisy_invariants(spark, d):
    """Each copy has every cell once; the noise is that of its level: none, or of a mean and deviation within six standard errors."""
    s = T.sales(spark, d)
    level = F.when(F.col("dataset") == "noisy_dataset_1", 0.0).when(F.col("dataset") == "noisy_dataset_2", 0.5).otherwise(4.0)
    gap = tensor.noisy_union(s, [0.5, 4.0]).join(s.withColumnRenamed("v", "_v"), ["i0", "i1", "t"]).withColumn("e", F.col("v") - F.col("_v")).withColumn("level", level)
    out = gap.groupBy("dataset", "level").agg(F.count("*").alias("n"), F.avg("e").alias("mean"), F.stddev_samp("e").alias("std"), F.count_distinct("i0", "i1", "t").alias("cells"))
    off = F.lit(6.0) * F.col("level") / F.sqrt("n") + F.lit(1e-9)
    near = (F.abs("mean") <= off) & (F.abs(F.col("std") - F.col("level")) <= off) & (F.col("n") == F.col("cells"))
    return out.select("dataset", "n", near.alias("near"))


@query("SELECT true AS valid, true AS orthonormal, 20 AS sensors FROM (SELECT count(*) AS n FROM embeddings) WHERE n >= 20")
def qr_invariants(spark, d):
    """What every factorisation of the embeddings has to hold: R from A and Q, Q's columns orthonormal, as many sensors as asked for."""
    t = T.embeddings(spark, d)
    c = placement.check(t, placement.place(t, 20))
    return spark.createDataFrame([(bool(c["valid"]), bool(c["orthogonality"] < 1e-8), int(c["sensors"]))], "valid boolean, orthonormal boolean, sensors int")
