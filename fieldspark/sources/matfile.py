"""MATLAB files (level 5) as a Spark data sink.

    matfile.save(coo, "/shared/fields", {"i0": 64, "i1": 64, "t": 20})

Rows are (file, name, shape, data): a variable of a file, its numbers in row-major order. Each task writes its files below a
hidden folder of the run; the commit moves them to their place at once, and an abort removes them, so a task that
is tried again, or a job that fails, leaves no half file. Paths are those that pyarrow opens, on every executor.
"""

from __future__ import annotations

import posixpath
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import datasource as D
from pyspark.sql import functions as F

COLUMNS = "file string, name string, shape array<int>, data array<double>"
#: Fixed values of the format: types of elements, and the class of an array of doubles.
INT8, INT32, UINT32, DOUBLE, MATRIX, DOUBLES = 1, 5, 6, 9, 14, 6


def _element(kind: int, data: bytes) -> bytes:
    return kind.to_bytes(4, "little") + len(data).to_bytes(4, "little") + data + b"\0" * (-len(data) % 8)


def variable(name: str, x: np.ndarray) -> bytes:
    """An array of doubles as the format has it: at least two axes, column by column."""
    if not (name.isidentifier() and name.isascii() and len(name) < 64):
        raise ValueError(f"{name!r} can't name a variable")
    x = np.asarray(x, "<f8")
    x = x.reshape(-1, 1) if x.ndim < 2 else x
    if x.nbytes >= 1 << 31:
        raise ValueError(f"{name} takes {x.nbytes} bytes; the format ends at 2 GB a variable")
    parts = _element(UINT32, np.array([DOUBLES, 0], "<u4").tobytes()) + _element(INT32, np.array(x.shape, "<i4").tobytes()) + _element(INT8, name.encode())
    return _element(MATRIX, parts + _element(DOUBLE, x.tobytes(order="F")))


def heading() -> bytes:
    return b"MATLAB 5.0 MAT-file".ljust(116) + b"\0" * 8 + (0x0100).to_bytes(2, "little") + b"IM"


def _system(path: str):
    return pa.fs.FileSystem.from_uri(path) if "://" in path else (pa.fs.LocalFileSystem(), path.removeprefix("file:"))


@dataclass
class Written(D.WriterCommitMessage):
    folder: str
    files: list[str]


class MatWriter(D.DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.run = path.rstrip("/"), overwrite, f"_temporary-{uuid.uuid4().hex}"

    def write(self, rows):
        fs, root = _system(self.path)
        folder = f"{self.run}/{uuid.uuid4().hex}"  # of this try of the task
        done, now, names, out = [], None, set(), None
        for r in rows:
            if r["file"] != now:
                if out is not None:
                    out.close()
                now, names = r["file"], set()
                if not now or now in done or now != posixpath.basename(now) or now.startswith((".", "_")):
                    raise ValueError(f"{now!r} can't name a file here, or its rows are apart")
                done.append(now)
                fs.create_dir(f"{root}/{folder}")
                out = fs.open_output_stream(f"{root}/{folder}/{now}.mat")
                out.write(heading())
            if r["name"] in names:
                raise ValueError(f"{now} has {r['name']} twice")
            names.add(r["name"])
            out.write(variable(r["name"], np.array(r["data"], float).reshape(r["shape"])))
        if out is not None:
            out.close()
        return Written(folder, done)

    def commit(self, messages):
        fs, root = _system(self.path)
        every = [(m.folder, f) for m in messages if m is not None for f in m.files]
        names = [f for _, f in every]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("rows of one file came from several tasks")
        fs.create_dir(root)
        old = [i.path for i in fs.get_file_info(pa.fs.FileSelector(root)) if i.path.endswith(".mat")]
        if old and not self.overwrite:
            clash = {posixpath.basename(p).removesuffix(".mat") for p in old} & set(names)
            if clash:
                self.abort(messages)
                raise ValueError(f"{sorted(clash)[0]}.mat is there already")
        for p in old if self.overwrite else ():
            fs.delete_file(p)
        for folder, f in every:
            fs.move(f"{root}/{folder}/{f}.mat", f"{root}/{f}.mat")
        self.abort(messages)

    def abort(self, messages):
        fs, root = _system(self.path)
        if fs.get_file_info(f"{root}/{self.run}").type != pa.fs.FileType.NotFound:
            fs.delete_dir(f"{root}/{self.run}")


class MatSink(D.DataSource):
    @classmethod
    def name(cls):
        return "mat"

    def schema(self):
        return COLUMNS

    def writer(self, schema, overwrite):
        return MatWriter(self.options["path"], overwrite)


def write(variables: DataFrame, path: str, mode: str = "append") -> None:
    """A file for each ``file`` of (file, name, shape, data). The variables of a file are written by one task."""
    variables.sparkSession.dataSource.register(MatSink)
    rows = variables.select("file", "name", "shape", "data").repartition("file").sortWithinPartitions("file", "name")
    rows.write.format("mat").mode(mode).save(path)


def dense(coo: DataFrame, axes: dict[str, int], by: list[str], name: str, file) -> DataFrame:
    """(file, name, shape, data) of each group's cells of a coordinate table; cells that aren't there are 0. A group is one variable, which
    the format bounds at 2 GB and a task holds."""
    sizes = list(axes.values())
    if 8 * int(np.prod(sizes, dtype=np.int64)) >= 1 << 31:
        raise ValueError("a variable ends at 2 GB")
    flat = F.lit(0).cast("long")
    for a, n in axes.items():
        flat = flat * n + F.col(a)
    cells = coo.select(file.alias("file"), *by, flat.alias("_at"), F.col("v").cast("double").alias("v"))

    def run(key, rows):
        x = np.zeros(sizes).ravel()
        x[rows.column("_at").to_numpy()] = rows.column("v").to_numpy()
        return pa.table({"file": [key[0].as_py()], "name": [name], "shape": pa.array([sizes], pa.list_(pa.int32())), "data": pa.array([x], pa.list_(pa.float64()))})

    return cells.groupBy("file", *by).applyInArrow(run, COLUMNS)


def save(coo: DataFrame, path: str, axes: dict[str, int], mode: str = "append") -> None:
    """A file a subject of (subject, axes.., t, v): ``a`` its first frame, ``u`` all frames with t as the last axis, ``t`` the frames' numbers."""
    subject = F.col("subject").cast("string")
    space = {a: n for a, n in axes.items() if a != "t"}
    steps = coo.select(subject.alias("file")).distinct().select("file", F.lit("t").alias("name"), F.array(F.lit(axes["t"])).alias("shape"), F.expr(f"transform(sequence(0, {axes['t'] - 1}), x -> double(x))").alias("data"))
    first = dense(coo.filter("t = 0"), space, [], "a", subject)
    every = dense(coo, {**space, "t": axes["t"]}, [], "u", subject)
    write(every.unionByName(first).unionByName(steps), path, mode)
