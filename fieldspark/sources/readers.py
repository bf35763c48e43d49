"""Sources: arrays, tables, images and wells as coordinate tables."""

from __future__ import annotations

import io
import json
import posixpath
import sys

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldspark.functions import scalars as S
from fieldspark.sources import arrays, sheets

SUFFIXES = {".npy": "numpy", ".npz": "numpy", ".csv": "table", ".xls": "excel", ".xlsx": "excel", ".parquet": "parquet", ".h5": "hdf5", ".hdf5": "hdf5", ".pt": "torch", ".pth": "torch"}


def kind_of(path: str) -> str:
    kind = SUFFIXES.get(posixpath.splitext(path.rstrip("/"))[1].lower())
    if kind is None:
        raise ValueError(f"unknown format: {path}")
    return kind


def load_tensor(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    """subject, i0.., v of an array file, by its suffix. A torch file is one file; filters on its axes reach it where the session has
    ``spark.sql.python.filterPushdown.enabled``."""
    kind = kind_of(path)
    if kind == "numpy":
        return read_numpy(spark, path, key)
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind == "hdf5":
        return read_hdf5(spark, path, key)
    if kind == "torch":
        found = arrays.read(spark, path, key=key)
        return found.select(F.lit(posixpath.splitext(posixpath.basename(path))[0]).alias("subject"), *found.columns)
    raise ValueError(f"no reader for {kind} files here; convert {path} to .npy or .parquet")


def _coo(subject: str, x: np.ndarray, names: list[str]) -> pd.DataFrame:
    index = np.indices(x.shape).reshape(x.ndim, -1)
    return pd.DataFrame({"subject": subject, **{n: i.astype(np.int32) for n, i in zip(names, index)}, "v": x.ravel().astype(float)})


def read_numpy(spark: SparkSession, path: str, key: str | None = None, ndim: int | None = None) -> DataFrame:
    """Arrays of .npy and .npz files; of an archive the given key or the first. Axes are i0.. and, last, t."""
    files = spark.read.format("binaryFile").load(path)
    if ndim is None:
        first = files.select("path", "content").limit(1).collect()
        if not first:
            raise FileNotFoundError(path)
        ndim = _array(first[0]["content"], key).ndim
    names = [*[f"i{k}" for k in range(ndim - 1)], "t"]

    def run(batches):
        for t in batches:
            for p, content in zip(t["path"], t["content"]):
                yield _coo(posixpath.splitext(posixpath.basename(p))[0], _array(content, key), names)

    return files.select("path", "content").mapInPandas(run, f"subject string, {', '.join(f'{n} int' for n in names)}, v double")


def _array(content: bytes, key: str | None) -> np.ndarray:
    x = np.load(io.BytesIO(content), allow_pickle=False)
    if isinstance(x, np.ndarray):
        return x
    names = list(x.keys())
    if key is not None and key not in names:
        raise KeyError(key)
    return x[key if key is not None else names[0]]


def read_hdf5(spark: SparkSession, path: str, key: str | None = None, ndim: int = 4) -> DataFrame:
    """Datasets of HDF5 files, where h5py is installed."""
    try:
        import h5py  # noqa: F401
    except ImportError as e:
        raise RuntimeError("h5py is needed for HDF5 files") from e
    names = [*[f"i{k}" for k in range(ndim - 1)], "t"]

    def run(batches):
        import h5py

        for t in batches:
            for p, content in zip(t["path"], t["content"]):
                with h5py.File(io.BytesIO(content)) as f:
                    yield _coo(posixpath.basename(p), f[key or next(iter(f))][()], names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, f"subject string, {', '.join(f'{n} int' for n in names)}, v double")


def load_slice(coo: DataFrame, **ranges: tuple[int, int]) -> DataFrame:
    """Half-open index ranges, as predicates that reach the scan."""
    for name, (lo, hi) in ranges.items():
        coo = coo.filter((F.col(name) >= lo) & (F.col(name) < hi))
    return coo


def load_multiple(coo: DataFrame, keys: list[str]) -> DataFrame:
    """Subjects by key; keys that aren't there are left out."""
    return coo.filter(F.col("subject").isin(keys))


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """path, format, size_mb, keys, shape, dtype of array files, of archives those of the first array. Only headers are read."""
    kind = kind_of(path)
    if kind not in ("numpy", "torch"):
        raise ValueError(f"no headers are read of {kind} files")

    def run(batches):
        for t in batches:
            rows = [(p, kind, n / 2**20, *arrays.describe(p)) for p, n in zip(t["path"], t["length"])]
            yield pd.DataFrame(rows, columns=["path", "format", "size_mb", "keys", "shape", "dtype"])

    files = spark.read.format("binaryFile").load(path).select("path", "length")  # the scan leaves contents alone
    return files.mapInPandas(run, "path string, format string, size_mb double, keys array<string>, shape array<int>, dtype string")


META_COLUMNS = 4


def _payloads(name: str, content: bytes):
    """(number of its first row, numbers) of runs of rows of a CSV file or a workbook's first sheet."""
    if posixpath.splitext(name)[1].lower() == ".xlsx":
        yield from sheets.payloads(content, META_COLUMNS)
    else:
        yield 0, pd.read_csv(io.BytesIO(content), float_precision="round_trip").iloc[:, META_COLUMNS:].fillna(0).to_numpy(float)


def bad_files(spark: SparkSession, path: str) -> DataFrame:
    """path, reason of the CSV files and workbooks that can't be parsed. Spark itself passes over empty files."""

    def run(batches):
        for t in batches:
            for p, content in zip(t["path"], t["content"]):
                try:
                    for _ in _payloads(p, content):
                        pass
                except (ValueError, KeyError) as e:  # pandas' parser errors are ValueErrors
                    yield pd.DataFrame({"path": [p], "reason": [str(e)]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, reason string")


def read_static(spark: SparkSession, path: str, skip_bad: bool = True) -> DataFrame:
    """subject, step, row, col, v of CSV files and workbooks (.xlsx, their first sheet): four metadata columns, then the payload; missing
    values are 0. Rows keep their order in the file, so one file is read by one task. A file that can't be parsed is skipped, with a
    message in its task's log, unless ``skip_bad`` is off; ``bad_files`` lists those."""
    files = spark.read.format("binaryFile").load(path)

    def run(batches):
        for t in batches:
            for p, content in zip(t["path"], t["content"]):
                name = posixpath.basename(p)
                if posixpath.splitext(name)[1].lower() not in (".csv", ".xlsx"):
                    raise ValueError(f"unknown format: {p}")
                try:
                    found = list(_payloads(name, content))  # whole, so that of a file that goes bad later nothing is kept
                except (ValueError, KeyError) as e:
                    if not skip_bad:
                        raise
                    print(f"skipped {p}: {e}", file=sys.stderr)
                    continue
                for first, x in found:
                    i, j = np.indices(x.shape)
                    yield pd.DataFrame({"subject": posixpath.splitext(name)[0], "step": S.step_of(name), "row": first + i.ravel(), "col": j.ravel(), "v": x.ravel()})

    return files.select("path", "content").mapInPandas(run, "subject string, step int, row int, col int, v double")


def reshaped(table: DataFrame, axes: dict[str, int], columns: int) -> DataFrame:
    """Payload cells (row, col) in reading order as the cells of another shape."""
    flat = F.col("row").cast("long") * columns + F.col("col")
    return table.select("subject", *[c.alias(n) for n, c in zip(axes, S.unravel(flat, list(axes.values())))], "v")


def read_dynamic(spark: SparkSession, path: str, axes: dict[str, int], columns: int) -> DataFrame:
    """As ``read_static``, reshaped; four axes are split along the third into subjects of their own."""
    out = reshaped(read_static(spark, path), axes, columns)
    if len(axes) == 4:
        third = list(axes)[2]
        out = out.withColumn("subject", F.concat_ws("_slice_", "subject", third)).drop(third)
    return out


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """subject, step, i0, i1, channel, v of PNG files below one folder a subject: RGB in [0, 1]."""
    images = spark.read.format("image").option("dropInvalid", True).load(path)
    if not images.limit(1).count():
        raise ValueError(f"no images in {path}")

    def run(batches):
        for t in batches:
            for o, h, w, c, data in zip(t["origin"], t["height"], t["width"], t["nChannels"], t["data"]):
                x = np.frombuffer(data, np.uint8).reshape(h, w, c)
                x = np.repeat(x, 3, axis=2) if c == 1 else x[:, :, 2::-1]  # stored as BGR(A)
                i, j, k = np.indices(x.shape)
                yield pd.DataFrame({"subject": posixpath.basename(posixpath.dirname(o)), "step": S.step_of(posixpath.basename(o)), "i0": i.ravel(), "i1": j.ravel(), "channel": k.ravel(), "v": x.ravel() / 255.0})

    return images.select("image.origin", "image.height", "image.width", "image.nChannels", "image.data").mapInPandas(run, "subject string, step int, i0 int, i1 int, channel int, v double")


def read_wells(spark: SparkSession, path: str) -> DataFrame:
    """subject, well_idx, row, col of a JSON file {case: [[i, j], ...]} or {case: [{"x": i, "y": j}, ...]}; entries of
    another form are left out."""
    text = spark.read.text(path, wholetext=True)
    cases = text.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("subject", "wells"))
    each = cases.select("subject", F.posexplode("wells").alias("well_idx", "w"))
    pair = F.from_json("w", "array<int>")
    row, col = (F.coalesce(F.try_element_at(pair, F.lit(k + 1)), F.get_json_object("w", f"$.{n}").cast("int")) for k, n in enumerate("xy"))
    return each.select("subject", F.col("well_idx").cast("long"), row.alias("row"), col.alias("col")).filter("row is not null and col is not null")


def parse_wells(text: str) -> dict[str, list[list[int]]]:
    pairs = lambda v: [[int(p["x"]), int(p["y"])] if isinstance(p, dict) else list(map(int, p[:2])) for p in v if (isinstance(p, dict) and {"x", "y"} <= set(p)) or (isinstance(p, list) and len(p) >= 2)]
    return {k: pairs(v) for k, v in json.loads(text).items()}


def list_keys(coo: DataFrame) -> DataFrame:
    """The subjects of a table, in order."""
    return coo.select("subject").distinct().orderBy("subject")


def load_fields(spark: SparkSession, pressure: str, soil: str) -> DataFrame:
    """Both fields as channels 0 and 1."""
    return spark.read.parquet(pressure).withColumn("channel", F.lit(0)).unionByName(spark.read.parquet(soil).withColumn("channel", F.lit(1)))


def load(spark: SparkSession, path: str, kind: str, axes: dict[str, int] | None = None, columns: int = 1) -> DataFrame:
    if kind == "static":
        return read_static(spark, path)
    if kind == "dynamic":
        return read_dynamic(spark, path, axes or {}, columns)
    if kind == "images":
        return read_images(spark, path)
    raise ValueError(f"unknown kind: {kind}")
