"""Tensors as coordinate tables (axes..., v): reshaping, masks, set operations, mode products."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldspark.functions import kernels as K
from fieldspark.functions import scalars as S


def axis(spark, name: str, size: int) -> DataFrame:
    return spark.range(size).select(F.col("id").cast("int").alias(name))


def grid(spark, axes: dict[str, int]) -> DataFrame:
    """All cells of a shape, from one range, so it is dealt out evenly."""
    total = reduce(lambda a, b: a * b, axes.values(), 1)
    cells = S.unravel("id", list(axes.values()))
    return spark.range(total).select(*[c.alias(n) for n, c in zip(axes, cells)])


def zero_fill(coo: DataFrame, axes: dict[str, int], value: str = "v") -> DataFrame:
    """Dense form: every cell of the shape, 0 where the table has none (or a null)."""
    full = grid(coo.sparkSession, axes)
    return full.join(coo, list(axes), "left").withColumn(value, F.coalesce(value, F.lit(0.0)))


def time_slice(coo: DataFrame, k: int) -> DataFrame:
    return coo.filter(F.col("t") == k).drop("t")


def frame_step(coo: DataFrame, step: int) -> DataFrame:
    return coo.filter(F.col("t") % step == 0)


def flatten(coo: DataFrame, axes: dict[str, int], name: str = "cell") -> DataFrame:
    """Spatial axes to one row-major cell id."""
    return coo.withColumn(name, S.row_major(list(axes), list(axes.values()))).drop(*axes)


def unflatten(coo: DataFrame, axes: dict[str, int], name: str = "cell") -> DataFrame:
    return coo.select(*[c.alias(n) for n, c in zip(axes, S.unravel(name, list(axes.values())))], *[c for c in coo.columns if c != name])


def tubes(coo: DataFrame, keys: list[str], length: int, along: str = "t", value: str = "v") -> DataFrame:
    """One row a cell with its dense vector along the last axis. Whole tubes are copied in order; where entries are missing, each place is looked up."""
    entries = F.collect_list(F.struct(F.col(along).alias("i"), F.col(value).alias("x")))
    pairs = coo.groupBy(*keys).agg(F.array_sort(entries).alias("e"), F.map_from_entries(entries).alias("m"))
    whole = (F.size("e") == length) & F.forall(F.transform("e", lambda e, j: e["i"] == j), lambda b: b)
    copied = F.transform("e", lambda e: F.coalesce(e["x"].cast("double"), F.lit(0.0)))
    sought = F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: F.coalesce(F.col("m")[i].cast("double"), F.lit(0.0)))
    return pairs.select(*keys, F.when(whole, copied).otherwise(sought).alias("tube"))


def untube(frame: DataFrame, along: str = "t", value: str = "v") -> DataFrame:
    return frame.select(*[c for c in frame.columns if c != "tube"], F.posexplode("tube").alias(along, value))


def stack_channels(fields: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), [f.withColumn("channel", F.lit(k)) for k, f in enumerate(fields)])


def stack_subjects(coo: DataFrame, lengths: DataFrame, along: str = "t") -> DataFrame:
    """Subjects one after another along the last axis. ``lengths`` (subject, place, n) gives order and size; it has a row a subject."""
    before = F.sum("n").over(Window.orderBy("place")) - F.sum("n").over(Window.partitionBy("place"))  # one row a subject
    return coo.join(lengths.select("subject", before.alias("offset")), "subject").withColumn(along, (F.col(along) + F.col("offset")).cast("int")).drop("offset")


def split_slices(coo: DataFrame, along: str) -> DataFrame:
    """Every index of an axis as a subject of its own."""
    return coo.withColumn("subject", F.concat_ws("_slice_", "subject", along)).drop(along)


def noisy_union(coo: DataFrame, levels: list[float], seed: int = 0, value: str = "v") -> DataFrame:
    """The table itself as ``noisy_dataset_1``, then one copy a level with normal noise."""
    parts = [coo.withColumn("dataset", F.lit("noisy_dataset_1"))]
    for k, level in enumerate(levels):
        parts.append(coo.withColumn(value, F.col(value) + F.lit(float(level)) * F.randn(seed + k)).withColumn("dataset", F.lit(f"noisy_dataset_{k + 2}")))
    return reduce(lambda a, b: a.unionByName(b), parts)


def measured(coo: DataFrame, sensors: DataFrame, keys: list[str], dense: bool = False) -> DataFrame:
    """Values at the sensors; dense: all cells, 0 elsewhere. Sensors may be per subject."""
    keys = [k for k in keys if k in sensors.columns]
    if not dense:
        return coo.join(sensors.select(*keys), keys, "left_semi")
    flagged = coo.join(sensors.select(*keys).distinct().withColumn("_p", F.lit(1.0)), keys, "left")
    return flagged.withColumn("v", F.col("v") * F.coalesce("_p", F.lit(0.0))).drop("_p")


def available(cells: DataFrame, rejected: DataFrame, keys: list[str]) -> DataFrame:
    return cells.join(rejected, keys, "left_anti")


def same_keys(a: DataFrame, b: DataFrame, key: str = "subject") -> bool:
    """Whether both tables hold the same subjects."""
    x, y = a.select(key).distinct(), b.select(key).distinct()
    return not x.exceptAll(y).unionByName(y.exceptAll(x)).limit(1).count()


def unfold(coo: DataFrame, mode: str, axes: dict[str, int]) -> DataFrame:
    """row, col, v of the unfolding along an axis; the other axes run row-major."""
    rest = {a: n for a, n in axes.items() if a != mode}
    return coo.select(F.col(mode).cast("long").alias("row"), S.row_major(list(rest), list(rest.values())).alias("col"), "v")


def gram(coo: DataFrame, mode: str, axes: dict[str, int]) -> DataFrame:
    """a, b, g of the Gram matrix of an unfolding. The fibres along the axis meet by the other indices, so
    a fibre's pairs are at most the axis' size squared; sums are partial before they are shuffled."""
    rest = [a for a in axes if a != mode]
    fibres = coo.groupBy(*rest).agg(F.collect_list(F.struct(F.col(mode).alias("i"), "v")).alias("f"))
    left = fibres.select("f", F.explode("f").alias("x")).select(F.explode("f").alias("y"), "x")
    return left.groupBy(F.col("x.i").alias("a"), F.col("y.i").alias("b")).agg(F.sum(F.col("x.v") * F.col("y.v")).alias("g"))


def mode_product(coo: DataFrame, factor: DataFrame, mode: str, transpose: bool = False) -> DataFrame:
    """X times U along an axis: factor has (row, rank, u); with ``transpose`` the axis' rows become ranks.
    A factor has rows x ranks entries, far fewer than the tensor, and Spark broadcasts it by its size."""
    keep = [c for c in coo.columns if c not in (mode, "v")]
    old, new = ("row", "rank") if transpose else ("rank", "row")
    u = factor.select(F.col(old).alias(mode), F.col(new).alias("_n"), "u")
    return coo.join(u, mode).groupBy(*keep, F.col("_n").alias(mode)).agg(F.sum(F.col("v") * F.col("u")).alias("v"))


def multiply(coo: DataFrame, factors: dict[str, DataFrame], transpose: bool) -> DataFrame:
    """Mode products along several axes, one after another."""
    for mode, factor in factors.items():
        coo = mode_product(coo, factor, mode, transpose)
    return coo


def norm2(coo: DataFrame) -> Column:
    return F.sum(F.col("v") * F.col("v"))


def resize(coo: DataFrame, frame: list[str], size: tuple[int, int], to: tuple[int, int]) -> DataFrame:
    """Each frame (frame..., i0, i1, v) of ``size``, missing cells 0, as one of ``to``: smoothed where it shrinks, then bilinear. A frame is a group."""
    kinds = {f.name: f.dataType.simpleString() for f in coo.schema}

    def run(t: pd.DataFrame) -> pd.DataFrame:
        x = np.zeros(size)
        x[t["i0"].to_numpy(), t["i1"].to_numpy()] = t["v"].to_numpy(float)
        y = K.resize(x, to)
        i, j = np.indices(y.shape)
        return pd.DataFrame({**{c: t[c].iloc[0] for c in frame}, "i0": i.ravel(), "i1": j.ravel(), "v": y.ravel()})

    schema = ", ".join([*[f"{c} {kinds[c]}" for c in frame], "i0 int, i1 int, v double"])
    return coo.groupBy(*frame).applyInPandas(run, schema)


def mode_of(axes: dict[str, int], length: int) -> str:
    """The first axis of a length."""
    for name, size in axes.items():
        if size == length:
            return name
    raise ValueError(f"no axis of {axes} has {length} entries")


def wells_matrix(points: DataFrame, height: int, width: int) -> DataFrame:
    """row, col, v of a whole grid: 1 at the wells inside it, else 0."""
    return zero_fill(points.filter(F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1)).select("row", "col").distinct().withColumn("v", F.lit(1.0)), {"row": height, "col": width})


def rgb_to_gray(coo: DataFrame, keys: list[str]) -> DataFrame:
    weights = F.element_at(F.array(F.lit(0.2125), F.lit(0.7154), F.lit(0.0721)), F.col("channel") + 1)
    return coo.groupBy(*keys).agg(F.sum(F.col("v") * weights).alias("v"))


def gray_to_rgb(coo: DataFrame) -> DataFrame:
    return coo.withColumn("channel", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))


def mosaic(coo: DataFrame, rows: int, cols: int, height: int, width: int) -> DataFrame:
    """Frames side by side: frame t stands at row t / cols, column t mod cols."""
    at = coo.filter(F.col("t") < rows * cols)
    return at.select((F.col("i0") + F.floor(F.col("t") / cols) * height).cast("int").alias("row"), (F.col("i1") + F.col("t") % cols * width).cast("int").alias("col"), "v")
