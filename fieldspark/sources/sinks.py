"""Sinks: simulator CSVs, maps, reports, datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldspark.operators import ranks


def ijk(field: DataFrame, order: str = "JI") -> DataFrame:
    """I, J, K, Value (1-based, six decimals) of a field (row, col, v); IJ swaps the two indices."""
    if order not in ("JI", "IJ"):
        raise ValueError("order is JI or IJ")
    i, j = ("col", "row") if order == "JI" else ("row", "col")
    return field.select((F.col(i) + 1).alias("I"), (F.col(j) + 1).alias("J"), F.lit(1).alias("K"), F.format_string("%.6f", F.col("v").cast("double")).alias("Value"))


def save_ijk(original: DataFrame, rebuilt: DataFrame, path: str, shape: tuple[int, int], order: str = "JI") -> None:
    """Original, reconstruction and their difference, J the outer order. One slice is one file."""
    for name, f in (("original", original), ("reconstructed", rebuilt)):
        n = f.count()
        if n != shape[0] * shape[1]:
            raise ValueError(f"{name} has {n} cells, not {shape[0]} x {shape[1]}")
    difference = original.join(rebuilt.withColumnRenamed("v", "_r"), ["row", "col"]).select("row", "col", (F.col("v") - F.col("_r")).alias("v"))
    for name, f in (("original", original), ("reconstructed", rebuilt), ("difference", difference)):
        ijk(f, order).orderBy("J", "I").coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/{name}")


def cluster_maps(cells: DataFrame, wells: DataFrame, sensors: DataFrame, centres: DataFrame) -> dict[str, DataFrame]:
    """Region map (clusters from 1), masks of wells and sensors, and the wells named C{cluster}_w{n}."""
    named = wells.join(cells, ["row", "col"]).withColumn("n", F.row_number().over(Window.partitionBy("cluster").orderBy("well_idx")))
    mask = lambda p: cells.select("row", "col").join(p.select("row", "col").distinct().withColumn("_m", F.lit(1)), ["row", "col"], "left").select("row", "col", F.coalesce("_m", F.lit(0)).alias("mask"))
    return {
        "cluster_region": cells.select("row", "col", (F.col("cluster") + 1).alias("region")),
        "wells_mask": mask(wells), "sensors_mask": mask(sensors),
        "centers_points": named.select(F.format_string("C%d_w%d", F.col("cluster") + 1, F.col("n")).alias("name"), "row", "col"),
    }


def ranking_maps(background: DataFrame, sensors: DataFrame, ranked: DataFrame) -> dict[str, DataFrame]:
    """Background (active where finite and not 0), points S{i} and W{idx}, and min-max well weights."""
    span = ranked.agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    active = F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") < float("inf")) & (F.col("v") != 0)
    weighted = ranked.crossJoin(F.broadcast(span)).withColumn("weight", F.when(F.col("hi") > F.col("lo"), (F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0))
    return {
        "background": background.select("row", "col", "v", active.alias("active")),
        "sensors_points": ranks.ranked(sensors.select("row", "col"), ["row", "col"]).select(F.concat(F.lit("S"), "rank").alias("name"), "row", "col"),
        "wells_points": ranked.select(F.concat(F.lit("W"), "well_idx").alias("name"), "row", "col"),
        "wells_weight": weighted.select("well_idx", "row", "col", "weight"),
    }


def save_maps(maps: dict[str, DataFrame], path: str) -> None:
    for name, frame in maps.items():
        frame.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/{name}")


def append_report(rows: DataFrame, path: str) -> None:
    """Summary rows, numbers rounded to two decimals."""
    rows.select(*[F.round(c, 2).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes]).write.mode("append").option("header", True).csv(path)


def save_noisy(rows: DataFrame, path: str, experiment: str | None = None) -> None:
    """One folder a dataset, below the experiment's where there is one."""
    rows.write.mode("overwrite").partitionBy("dataset").parquet(f"{path}/noisy_datasets" + (f"/{experiment}" if experiment else ""))
