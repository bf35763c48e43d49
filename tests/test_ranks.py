"""Ranks without a task that sees the whole table."""

import random

from pyspark.sql import functions as F

from fieldspark.operators import analysis, ranks
from fieldspark.sources import sinks


def rows(n=500):
    r = random.Random(2)
    return [(i, r.choice([1.5, 2.0, -3.0, None, float("nan")]) if i % 3 else 2.0) for i in range(n)]


def test_ranked_over_partitions(spark):
    frame = spark.createDataFrame(rows(), "k long, v double").repartition(7)
    order = [F.desc("v"), "k"]
    got = ranks.ranked(frame, order, partitions=6)
    assert got.columns == ["k", "v", "rank"]
    want = [r["k"] for r in frame.orderBy(*order).collect()]
    assert [r["k"] for r in got.orderBy("rank").collect()] == want
    assert [r["rank"] for r in got.orderBy("rank").collect()] == list(range(1, 501))
    assert ranks.ranked(frame.limit(0), order).count() == 0


def test_head_is_the_beginning(spark):
    frame = spark.createDataFrame(rows(), "k long, v double").repartition(7)
    order = [F.desc("v"), "k"]
    got = ranks.head(frame, order, 12)
    want = [(r["k"], i) for i, r in enumerate(frame.orderBy(*order).limit(12).collect(), 1)]
    assert sorted(((r["k"], r["rank"]) for r in got.collect()), key=lambda x: x[1]) == want
    assert ranks.head(frame, order, 1000).count() == 500


def test_rankings_have_no_window_over_all(spark):
    wells = spark.createDataFrame([("a", i, i % 7, i // 7) for i in range(40)], "subject string, well_idx long, row int, col int")
    sensors = spark.createDataFrame([(1, 1), (2, 2), (6, 0), (3, 3)], "row int, col int")
    whole = analysis.rank_by_proximity(sensors, wells, 10, 10)
    few = analysis.rank_by_proximity(sensors, wells, 10, 10, top=5)
    plans = [f._jdf.queryExecution().toString() for f in (whole, few, analysis.first_wells(wells, 3, 10, 10, pooled=True))]
    assert not any("Window" in p for p in plans)
    assert [tuple(r) for r in few.orderBy("rank").collect()] == [tuple(r) for r in whole.orderBy("rank").limit(5).collect()]
    points = sinks.ranking_maps(spark.createDataFrame([(0, 0, 1.0), (0, 1, 0.0)], "row int, col int, v double"), sensors, whole)
    assert [r["name"] for r in points["sensors_points"].orderBy("row", "col").collect()] == ["S1", "S2", "S3", "S4"]
    assert [r["active"] for r in points["background"].orderBy("col").collect()] == [True, False]
    assert points["wells_weight"].agg(F.max("weight")).first()[0] == 1.0
