"""Statistics, normalisation of tables, metrics and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldspark.functions import scalars as S
from fieldspark.operators import tensor


def foreground(value: str = "v", background: float | None = None, mask: str | None = None) -> Column:
    if mask is not None:
        return F.col(mask)
    return F.col(value) != F.lit(background) if background is not None else F.lit(True)


def foreground_stats(coo: DataFrame, by: list[str] = (), background: float | None = None, mask: str | None = None) -> DataFrame:
    """lo, hi, mean, std (population) over the foreground; 0, 0, 0, 1 where it is empty."""
    v = F.when(foreground("v", background, mask), F.col("v"))
    aggs = [F.coalesce(F.min(v), F.lit(0.0)).alias("lo"), F.coalesce(F.max(v), F.lit(0.0)).alias("hi"), F.coalesce(F.avg(v), F.lit(0.0)).alias("mean"), F.coalesce(F.stddev_pop(v), F.lit(1.0)).alias("std")]
    return coo.groupBy(*by).agg(*aggs) if by else coo.agg(*aggs)


def global_minmax(coo: DataFrame, background: float | None = None, mask: str | None = None) -> DataFrame:
    """Least of the subjects' minima, greatest of their maxima; a subject without foreground counts as 0, 0."""
    per = foreground_stats(coo, ["subject"], background, mask)
    return per.agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def global_zscore(coo: DataFrame, mask: str | None = None) -> DataFrame:
    v = F.when(foreground("v", None, mask), F.col("v"))
    return coo.agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"))


def fit(coo: DataFrame, by: list[str] = ()) -> DataFrame:
    """All parameters of the three methods, global (one row) or per dimension; std is the sample's."""
    aggs = [F.min("v").alias("lo"), F.max("v").alias("hi"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.max(F.abs("v")).alias("most")]
    return coo.groupBy(*by).agg(*aggs) if by else coo.agg(*aggs)


def apply(coo: DataFrame, params: DataFrame, method: str, by: list[str] = (), inverse: bool = False) -> DataFrame:
    """Normalise with fitted parameters: one row, or one a dimension."""
    f = S.denormalise if inverse else S.normalise
    joined = coo.join(params, list(by)) if by else coo.crossJoin(F.broadcast(params.limit(1)))
    return joined.withColumn("v", f(method, "v", lo="lo", hi="hi", mean="mean", std="std", most="most")).select(*coo.columns)


def per_frame(coo: DataFrame, method: str = "minmax", frame: list[str] = ("subject", "t"), background: float | None = None) -> DataFrame:
    """Each frame by its own foreground, without a constant: left alone where the range or deviation is 0; background is untouched."""
    w = Window.partitionBy(*frame)
    front = foreground("v", background)
    v = F.when(front, F.col("v"))
    if method == "minmax":
        lo, hi = F.min(v).over(w), F.max(v).over(w)
        new = F.when(front & (hi > lo), (F.col("v") - lo) / (hi - lo)).otherwise(F.col("v"))
    elif method == "zscore":
        mean, std = F.avg(v).over(w), F.stddev_pop(v).over(w)
        new = F.when(front & (std != 0), (F.col("v") - mean) / std).otherwise(F.col("v"))
    else:
        raise ValueError(f"unknown normalisation: {method}")
    return coo.withColumn("v", new)


def given(coo: DataFrame, method: str, params: dict[str, float], background: float | None = None, mask: str | None = None) -> DataFrame:
    """Normalise by given parameters (min and max, or mean and std) without a constant; a range or deviation of 0 leaves the values alone."""
    return _linear(coo, method, params, background, mask, False)


def restore(coo: DataFrame, method: str, params: dict[str, float], background: float | None = None, mask: str | None = None) -> DataFrame:
    """The inverse of ``given``; background, or cells outside the mask, stay as they are."""
    return _linear(coo, method, params, background, mask, True)


def _linear(coo, method, params, background, mask, inverse):
    names = {"minmax": ("min", "max"), "zscore": ("mean", "std")}.get(method)
    if names is None:
        raise ValueError(f"unknown normalisation: {method}")
    if not set(names) <= set(params):
        raise ValueError(f"{method} needs {names[0]} and {names[1]}")
    a, b = (float(params[n]) for n in names)
    shift, size = a, b - a if method == "minmax" else b
    if not inverse and (size <= 0 if method == "minmax" else size == 0):
        return coo
    new = F.col("v") * F.lit(size) + F.lit(shift) if inverse else (F.col("v") - F.lit(shift)) / F.lit(size)
    return coo.withColumn("v", F.when(foreground("v", background, mask), new).otherwise(F.col("v")))


def process(coo: DataFrame, frame: list[str] = ("subject", "t"), size: tuple[int, int] | None = None, to: tuple[int, int] | None = None, gray: bool = False, method: str | None = None, params: dict[str, float] | None = None, background: float | None = None) -> DataFrame:
    """Frames to grey, resized from ``size`` to ``to``, normalised by given parameters or by each frame's own."""
    frame = list(frame)
    if gray and "channel" in coo.columns:
        coo = tensor.rgb_to_gray(coo, [*frame, "i0", "i1"])
    if to is not None:
        coo = tensor.resize(coo, [*frame, *(["channel"] if "channel" in coo.columns else [])], size, to)
    if method is None:
        return coo
    if method not in ("minmax", "zscore"):
        raise ValueError(f"unknown normalisation: {method}")
    needed = {"min", "max"} if method == "minmax" else {"mean", "std"}
    return given(coo, method, params, background) if params and needed <= set(params) else per_frame(coo, method, frame, background)


def positive_range(coo: DataFrame, by: list[str] = ()) -> DataFrame:
    """lo, hi: the least positive value, or 0 without one, and the largest value."""
    aggs = [F.coalesce(F.min(F.when(F.col("v") > 0, F.col("v"))), F.lit(0.0)).alias("lo"), F.max("v").alias("hi")]
    return coo.groupBy(*by).agg(*aggs) if by else coo.agg(*aggs)


def least_frames(split: DataFrame) -> DataFrame:
    """part, frames: the fewest frames any subject has in each part of a split (subject, t, part)."""
    return split.groupBy("part", "subject").agg(F.count_distinct("t").alias("n")).groupBy("part").agg(F.min("n").alias("frames"))


def demean(coo: DataFrame, series: list[str]) -> DataFrame:
    return coo.withColumn("v", F.col("v") - F.avg("v").over(Window.partitionBy(*series)))


def detrend(coo: DataFrame, series: list[str], length: int) -> DataFrame:
    """Subtract each series' least-squares line over t scaled to [0, 1]."""
    x = F.col("t").cast("double") / F.lit(float(max(1, length - 1)))
    lines = coo.withColumn("x", x).groupBy(*series).agg(F.regr_slope("v", "x").alias("slope"), F.regr_intercept("v", "x").alias("start"), F.avg("v").alias("level"))
    fitted = F.coalesce(F.col("slope"), F.lit(0.0)) * x + F.coalesce(F.col("start"), F.col("level"))
    return coo.join(lines, list(series)).withColumn("v", F.col("v") - fitted).select(*coo.columns)


def preprocess(coo: DataFrame, series: list[str], length: int, remove_mean=False, remove_trend=False, normalize=False) -> DataFrame:
    if remove_mean:
        coo = demean(coo, series)
    if remove_trend:
        coo = detrend(coo, series, length)
    if normalize:
        coo = apply(coo, fit(coo), "minmax")
    return coo


def metrics(pairs: DataFrame, by: list[str] = (), background: float | None = None, mask: str | None = None, max_val: float | None = None) -> DataFrame:
    """error, mse, rmse, psnr of rows (rec, ref): errors over the foreground, the range over the whole reference."""
    front = foreground("ref", background, mask)
    d2 = F.when(front, (F.col("rec") - F.col("ref")) * (F.col("rec") - F.col("ref")))
    r2 = F.when(front, F.col("ref") * F.col("ref"))
    g = pairs.groupBy(*by) if by else pairs.groupBy()
    base = g.agg(F.sqrt(F.sum(d2)).alias("d"), F.sqrt(F.sum(r2)).alias("r"), F.avg(d2).alias("mse"), (F.lit(float(max_val)) if max_val is not None else F.max("ref") - F.min("ref")).alias("range"))
    inf = F.lit(float("inf"))
    psnr = F.when(F.col("range") < 1e-12, 0.0).when(F.col("mse") == 0, inf).otherwise(20.0 * F.log10(F.col("range") / F.sqrt("mse")))
    return base.select(*by, F.when(F.col("r") > 0, F.col("d") / F.col("r")).otherwise(inf).alias("error"), "mse", F.sqrt("mse").alias("rmse"), psnr.alias("psnr"))


def physical(pairs: DataFrame, params: DataFrame, method: str, by: list[str] = (), cases: list[str] = ()) -> DataFrame:
    """cases..., error, mse, rmse, psnr, mae in physical units, of rows (rec, ref) normalised with ``params`` (one row, or one for each of
    ``by``). No foreground at all is an error, as there is nothing to measure."""
    joined = pairs.join(params, list(by)) if by else pairs.crossJoin(F.broadcast(params.limit(1)))
    names = dict(lo="lo", hi="hi", mean="mean", std="std", most="most")
    units = joined.withColumns({c: S.denormalise(method, c, **names) for c in ("rec", "ref")})
    if not units.limit(1).count():
        raise ValueError("there is nothing to measure")
    mae = (units.groupBy(*cases) if cases else units.groupBy()).agg(F.avg(F.abs(F.col("rec") - F.col("ref"))).alias("mae"))
    found = metrics(units, list(cases))
    return found.join(mae, list(cases)) if cases else found.crossJoin(mae)


def improvements(scores: DataFrame, case: str, baseline: str, value: str = "rmse") -> DataFrame:
    """``scores`` with the percentage by which each case's error lies below the baseline's."""
    base = scores.filter(F.col(case) == baseline).agg(F.first(value).alias("_base"))
    better = F.when(F.col("_base") > 0, 100 * (F.col("_base") - F.col(value)) / F.col("_base")).otherwise(0.0)
    return scores.crossJoin(F.broadcast(base)).withColumn("improvement", better).drop("_base")


def summary(runs: DataFrame, by: list[str], names: list[str], level: float = 0.95) -> DataFrame:
    """Mean, sample deviation and interval of each name."""
    aggs = [a for n in names for a in (F.avg(n).alias(f"{n}_mean"), F.stddev_samp(n).alias(f"{n}_std"))]
    out = runs.groupBy(*by).agg(*aggs, F.count("*").alias("num_samples"))
    for n in names:
        lo, hi = S.confidence(f"{n}_mean", f"{n}_std", "num_samples", level)
        out = out.withColumn(f"{n}_ci_lower", lo).withColumn(f"{n}_ci_upper", hi)
    return out


def split_ordered(coo: DataFrame, ratio: float = 0.8, by: list[str] = ("subject",)) -> DataFrame:
    """A column ``part``: the first floor(n * ratio) frames of each subject train, the rest test. Frames are
    ranked in a table of their own, with one row each."""
    return _split(coo, [("train", ratio)], "test", F.col("t"), by)


def split_three(coo: DataFrame, train: float = 0.8, val: float = 0.1, shuffle_seed: int | None = None, by: list[str] = ("subject",)) -> DataFrame:
    if train < 0 or val < 0 or train + val > 1 + 1e-9:
        raise ValueError("ratios must be in [0, 1] and sum to 1")
    order = F.col("t") if shuffle_seed is None else F.xxhash64(F.lit(shuffle_seed), *by, "t")
    return _split(coo, [("train", train), ("val", val)], "test", order, by)


def _split(coo, shares, rest, order, by):
    frames = coo.select(*by, "t").distinct()
    w = Window.partitionBy(*by)
    frames = frames.withColumn("_r", F.row_number().over(w.orderBy(order, "t")) - 1).withColumn("_n", F.count("*").over(w))
    part, start = F.lit(rest), F.lit(0).cast("long")
    cases = []
    for name, ratio in shares:
        end = start + F.floor(F.col("_n") * F.lit(float(ratio)) + F.lit(1e-9))
        cases.append((end, name))
        start = end
    for end, name in reversed(cases):
        part = F.when(F.col("_r") < end, name).otherwise(part)
    return coo.join(frames.withColumn("part", part).drop("_r", "_n"), [*by, "t"])


def split_random(coo: DataFrame, experiments: int, ratio: float = 0.8, by: list[str] = ("subject",)) -> DataFrame:
    """For each experiment a shuffle of the frames of its own: ceil(n * (1 - ratio)) of them test."""
    spread = coo.select(*by, "t").distinct().withColumn("experiment", F.explode(F.sequence(F.lit(0), F.lit(experiments - 1))))
    w = Window.partitionBy("experiment", *by)
    ranked = spread.withColumn("_r", F.row_number().over(w.orderBy(F.xxhash64("experiment", *by, "t"), "t"))).withColumn("_n", F.count("*").over(w))
    part = F.when(F.col("_r") <= F.ceil(F.col("_n") * F.lit(1.0 - ratio) - F.lit(1e-9)), "test").otherwise("train")
    return coo.join(ranked.withColumn("part", part).drop("_r", "_n"), [*by, "t"])
