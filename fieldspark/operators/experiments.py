"""Experiment sweeps: sensors placed, fields rebuilt, errors summarised."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldspark.functions import kernels as K
from fieldspark.operators import analysis, placement, sensing, stats


@dataclass
class Config:
    epsilon: float = 1e-2
    relax: float = 0.95
    delta: float = 0.1
    delta_max: float = 1.0
    noise: float = 0.0
    samples: int = 0
    noise_threshold: float = 1e-6
    confidence: float = 0.95
    tol: float = 1e-7
    max_iter: int = 1000
    seed: int = 0

    def sensing(self) -> K.Sensing:
        return K.Sensing(max_iter=self.max_iter, tol=self.tol, epsilon=self.epsilon, delta=self.delta, delta_max=self.delta_max, relax=self.relax)


def add_noise(measured: DataFrame, keys: list[str], level: float, threshold: float = 1e-6, seed: int = 0) -> DataFrame:
    """Normal noise of level * the largest value of each right-hand side, where a value is above the threshold."""
    if level == 0:
        return measured
    most = measured.groupBy(*keys).agg(F.max(F.abs("v")).alias("_m"))
    noisy = F.when(F.abs("v") > threshold, F.col("v") + F.randn(seed) * F.lit(level) * F.col("_m")).otherwise(F.col("v"))
    return measured.join(most, keys).withColumn("v", noisy).drop("_m")


COLUMNS = [f"{n}_{s}" for n in ("error", "ssim", "psnr", "mse") for s in ("mean", "std", "ci_lower", "ci_upper")]


def scores(tubes: DataFrame, truth: DataFrame, solutions: DataFrame, keys: list[str], shape: tuple[int, int] | None = None) -> DataFrame:
    """keys, error, mse, psnr, ssim of rebuilt fields against rows (keys..., cell, v). One field is a group."""
    base = [k for k in keys if k in truth.columns]
    found = sensing.fields(tubes, solutions, keys).withColumnRenamed("v", "rec")
    pairs = found.join(truth.withColumnRenamed("v", "ref"), [*base, "cell"])

    def run(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("cell")
        a, b = t["rec"].to_numpy(), t["ref"].to_numpy()
        d, span = a - b, float(np.ptp(b))
        mse, size = float((d * d).mean()), np.linalg.norm(b)
        side = shape if shape and shape[0] * shape[1] == len(b) else (1, len(b))
        psnr = 0.0 if span < 1e-12 else float("inf") if mse == 0 else 20 * np.log10(span / np.sqrt(mse))
        out = t[keys].iloc[:1].reset_index(drop=True)
        return out.assign(error=np.linalg.norm(d) / size if size > 0 else np.inf, mse=mse, psnr=psnr, ssim=K.ssim(a.reshape(side), b.reshape(side)))

    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema}
    return pairs.groupBy(*keys).applyInPandas(run, ", ".join([*[f"{k} {kinds[k]}" for k in keys], "error double, mse double, psnr double, ssim double"]))


def sweep(tubes: DataFrame, truth: DataFrame, keys: list[str], width: int, counts: list[int], cfg: Config = Config(), sensors_of=None, shape=None) -> DataFrame:
    """A summary row a number of sensors, over every field of the truth: once as measured and, with noise, ``samples`` times
    more. ``sensors_of(n)`` gives the cells, per subject where it has that column (a placement by default).
    The loop is over the few numbers of sensors; all fields of one are solved together."""
    spark, out = tubes.sparkSession, None
    placed = None if sensors_of else placement.place(tubes, max(counts)).cells
    for n in counts:
        sensors = sensors_of(n) if sensors_of else spark.createDataFrame([(c,) for c in placed[:n]], "cell long")
        runs = _runs(tubes, truth, keys, width, sensors, cfg, shape)
        row = stats.summary(runs, [], ["error", "ssim", "psnr", "mse"], cfg.confidence).select(F.lit(n).alias("sensors"), *COLUMNS, "num_samples")
        out = row if out is None else out.unionByName(row)
    return out


def _runs(tubes, truth, keys, width, sensors, cfg, shape) -> DataFrame:
    on = [c for c in ("subject", "cell") if c in sensors.columns and c in truth.columns]
    sensors = sensors.select(*on).distinct()
    measured = truth.join(sensors, on, "left_semi")
    runs = None
    for k in range(cfg.samples + 1):
        noisy = add_noise(measured, keys, cfg.noise if k else 0.0, cfg.noise_threshold, cfg.seed + k)
        if "subject" in on:
            solved = sensing.sense_by(tubes, sensors, noisy, keys, width, cfg.sensing(), "subject")
        else:
            solved = sensing.sense(tubes, sensors, noisy, keys, width, cfg.sensing())
        one = scores(tubes, truth, solved, keys, shape)
        runs = one if runs is None else runs.unionByName(one)
    return runs


def sweep_slice(tubes: DataFrame, truth: DataFrame, subject: str, t: int, width: int, counts: list[int], cfg: Config = Config(), sensors_of=None, shape=None) -> DataFrame:
    """The sweep over one frame of one subject of rows (subject, t, cell, v); an unknown frame is an error."""
    frame = truth.filter((F.col("subject") == subject) & (F.col("t") == t))
    if not frame.limit(1).count():
        raise ValueError(f"no frame {t} of {subject}")
    out = sweep(tubes, frame, ["subject", "t"], width, counts, cfg, sensors_of, shape)
    return out.select("sensors", F.lit(subject).alias("subject"), F.lit(t).alias("slice_idx"), *COLUMNS, "num_samples")


def well_sensors(wells: DataFrame, height: int, width: int, subject: str | None = None):
    """For a sweep: the first n wells of each subject (subject, row, col, well_idx), or of one, as sensor cells."""
    if subject is not None:
        wells = wells.filter(F.col("subject") == subject)

    def pick(n: int) -> DataFrame:
        first = analysis.first_wells(wells, n, height, width)
        return first.select("subject", (F.col("row").cast("long") * width + F.col("col")).alias("cell"))

    return pick


def cases(bases: dict[str, tuple[DataFrame, int]], sensor_sets: dict[str, DataFrame], truth: DataFrame, keys: list[str], cfg: Config = Config(), shape=None) -> DataFrame:
    """A row for each basis (tubes, width) under each set of sensor cells: the mean rmse, ssim and error over all fields."""
    out = None
    for basis, (tubes, width) in bases.items():
        for placed, sensors in sensor_sets.items():
            runs = _runs(tubes, truth, keys, width, sensors, cfg, shape)
            one = runs.agg(*[F.avg(c).alias(n) for n, c in (("rmse", F.sqrt("mse")), ("ssim", "ssim"), ("error", "error"))]).select(F.lit(basis).alias("basis"), F.lit(placed).alias("placement"), "rmse", "ssim", "error")
            out = one if out is None else out.unionByName(one)
    return out


def best(table: DataFrame, by: str = "rmse") -> DataFrame:
    """The row of the least figure; values that are not numbers come last."""
    return table.orderBy(F.when(F.isnan(by), None).otherwise(F.col(by)).asc_nulls_last(), *[c for c in table.columns if c != by and dict(table.dtypes)[c] in ("string", "int", "double")]).limit(1)


def analytics(summary: DataFrame, name: str = "error") -> DataFrame:
    """The mean on the scale of the sweep's interval bounds; a range of 0 counts as 1."""
    span = summary.agg(F.min(f"{name}_ci_lower").alias("_lo"), F.max(f"{name}_ci_upper").alias("_hi"))
    size = F.when(F.col("_hi") > F.col("_lo"), F.col("_hi") - F.col("_lo")).otherwise(1.0)
    return summary.crossJoin(F.broadcast(span)).withColumn(f"{name}_normalised", (F.col(f"{name}_mean") - F.col("_lo")) / size).drop("_lo", "_hi")


def grid_search(sides: DataFrame, gram: np.ndarray, keys: list[str], epsilons: list[float], relaxes: list[float]) -> DataFrame:
    """Every pair of parameters on every right-hand side, with its place: converged pairs by their objective, then the others."""
    out = None
    for e in epsilons:
        for r in relaxes:
            one = sensing.solve(sides, gram, keys, K.Sensing(epsilon=e, relax=r)).select(*keys, F.lit(e).alias("epsilon"), F.lit(r).alias("relax"), "converged", "iterations", "objective")
            out = one if out is None else out.unionByName(one)
    w = Window.partitionBy(*keys).orderBy(F.desc("converged"), "objective", "epsilon", "relax")
    return out.withColumn("place", F.row_number().over(w))
