"""Array files (NumPy's, archives of them, torch's) as a Spark data source that reads only the bytes a slice needs.

    spark.dataSource.register(arrays.ArraySource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", True)
    spark.read.format("npy").load("/data/field.npy").filter("t between 10 and 19 and i0 = 3")

Rows are i0.., t and v of one array: of an .npy file, or of an uncompressed .npz or a .pt the one of the option ``key``, else the first.
Its header alone gives the schema and the shape; comparisons of an axis with a number become a
range of that axis, and a partition is a part of the outermost axis of at most ``chunk`` bytes (an option). Of a part, the runs
of bytes are read that the ranges leave, neighbouring ones at once. Paths are those that pyarrow opens, on every executor.
"""

from __future__ import annotations

import math
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import datasource as D

CHUNK, ROWS = 8 << 20, 1 << 16


def open_file(path: str):
    fs, name = pa.fs.FileSystem.from_uri(path) if "://" in path else (pa.fs.LocalFileSystem(), path.removeprefix("file:"))
    return fs.open_input_file(name)


@dataclass
class Header:
    shape: tuple[int, ...]
    dtype: np.dtype
    order: tuple[int, ...]  # the axes, the outermost in the file first
    start: int  # of the numbers
    brain: bool = False  # 16-bit floats with the exponent of 32-bit ones

    def names(self) -> list[str]:
        return [*[f"i{k}" for k in range(len(self.shape) - 1)], "t"]

    def numbers(self, raw: bytes) -> np.ndarray:
        x = np.frombuffer(raw, self.dtype)
        return ((x.astype(np.uint32) << np.uint32(16)).view(np.float32) if self.brain else x).astype(np.float64)


def _npy_header(f, path: str) -> Header:
    version = np.lib.format.read_magic(f)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, fortran, dtype = read(f)
    if dtype.kind not in "biuf" or not shape:
        raise ValueError(f"{path} holds {dtype} of shape {shape}, not an array of numbers")
    return Header(shape, dtype, tuple(range(len(shape)))[:: -1 if fortran else 1], f.tell())


def _archive(f) -> bool:
    begins = f.read(4)
    f.seek(0)
    return begins == b"PK\x03\x04"


def place(f, entry: zipfile.ZipInfo) -> int:
    """Where the bytes of an uncompressed member of an archive begin."""
    if entry.compress_type != zipfile.ZIP_STORED:
        raise ValueError(f"{entry.filename} is compressed: its slices have no place in the file")
    f.seek(entry.header_offset)
    own = f.read(30)  # its lengths may differ from those in the directory
    return entry.header_offset + 30 + int.from_bytes(own[26:28], "little") + int.from_bytes(own[28:30], "little")


def header(path: str, key: str | None = None) -> Header:
    """Shape and type of an array from the first bytes of its file, or from the directory of its archive."""
    from fieldspark.sources import torchfile

    with open_file(path) as f:
        if not _archive(f):
            return _npy_header(f, path)
        with zipfile.ZipFile(f) as z:
            if torchfile.index_of(z):
                return torchfile.header(f, z, path, key)
            names = [e.filename for e in z.infolist() if e.filename.endswith(".npy")]
            name = f"{key}.npy" if key is not None else names[0] if names else ""
            if name not in names:
                raise KeyError(key if key is not None else path)
            f.seek(place(f, z.getinfo(name)))
            return _npy_header(f, path)


def describe(path: str) -> tuple[list[str], list[int], str]:
    """The keys of a file's arrays (none of a file of one), and shape and type of the first; members of an archive may be compressed."""
    from fieldspark.sources import torchfile

    with open_file(path) as f:
        if _archive(f):
            with zipfile.ZipFile(f) as z:
                if not torchfile.index_of(z):
                    names = [e.filename for e in z.infolist() if e.filename.endswith(".npy")]
                    if not names:
                        raise ValueError(f"{path} holds no arrays")
                    with z.open(names[0]) as member:
                        h = _npy_header(member, path)
                    return [n.removesuffix(".npy") for n in names], list(h.shape), str(h.dtype)
                keys = [k for k in torchfile.tensors(z) if k]
        else:
            keys = []
    h = header(path)
    return keys, list(h.shape), "bfloat16" if h.brain else str(h.dtype)


def runs(shape: tuple[int, ...], ranges: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """(start, length) in numbers of the runs that ranges of a row-major array's axes leave, whole inner axes as one."""
    if any(s >= e for s, e in ranges):
        return
    k = len(shape)
    while k > 0 and ranges[k - 1] == (0, shape[k - 1]):
        k -= 1
    if k == 0:
        yield 0, math.prod(shape)
        return
    inner = math.prod(shape[k:])
    s, e = ranges[k - 1]
    for at in np.ndindex(*[b - a for a, b in ranges[: k - 1]]):
        place = 0
        for (a, _), i, n in zip(ranges, at, shape):
            place = place * n + a + i
        yield (place * shape[k - 1] + s) * inner, (e - s) * inner


@dataclass
class Part(D.InputPartition):
    first: int
    last: int

    def __post_init__(self):
        self.value = (self.first, self.last)


class WholeReader(D.DataSourceReader):
    def __init__(self, path: str, chunk: int, key: str | None = None):
        self.path, self.chunk, self.header = path, chunk, header(path, key)
        self.ranges = [(0, n) for n in self.header.shape]

    def partitions(self):
        outer = self.header.order[0]
        s, e = self.ranges[outer]
        others = math.prod(max(0, b - a) for k, (a, b) in enumerate(self.ranges) if k != outer)
        step = max(1, self.chunk // max(1, others * self.header.dtype.itemsize))
        return [Part(a, min(e, a + step)) for a in range(s, e, step)] if others else []

    def read(self, partition):
        if partition is None:  # Spark's only partition where there are none
            return
        h = self.header
        ranges = [self.ranges[a] for a in h.order]
        ranges[0] = (partition.first, partition.last)
        shape, names, size = tuple(h.shape[a] for a in h.order), [h.names()[a] for a in h.order], h.dtype.itemsize
        with open_file(self.path) as f:
            for start, length in _joined(runs(shape, ranges)):
                for at in range(start, start + length, ROWS):
                    n = min(ROWS, start + length - at)
                    f.seek(h.start + at * size)
                    v = h.numbers(f.read(n * size))
                    index = dict(zip(names, np.unravel_index(np.arange(at, at + n), shape)))
                    yield pa.RecordBatch.from_arrays([*[pa.array(index[c].astype(np.int32)) for c in h.names()], pa.array(v)], names=[*h.names(), "v"])


class ArrayReader(WholeReader):
    """The reader that filters reach. Spark refuses one where the session has that turned off."""

    def pushFilters(self, filters):
        """Comparisons of an axis with a whole number narrow its range; what else there is Spark does itself."""
        names = self.header.names()
        for f in filters:
            column = getattr(f, "attribute", None)
            value = getattr(f, "value", None)
            axis = names.index(column[0]) if column and len(column) == 1 and column[0] in names else None
            low, high = -math.inf, math.inf
            if isinstance(f, D.IsNotNull) and axis is not None:
                continue
            if axis is None or not (isinstance(f, D.In) or isinstance(value, (int, float)) and not isinstance(value, bool)):
                yield f
                continue
            if isinstance(f, (D.EqualTo, D.EqualNullSafe)):
                low = high = value
            elif isinstance(f, D.GreaterThan):
                low = math.floor(value) + 1
            elif isinstance(f, D.GreaterThanOrEqual):
                low = math.ceil(value)
            elif isinstance(f, D.LessThan):
                high = math.ceil(value) - 1
            elif isinstance(f, D.LessThanOrEqual):
                high = math.floor(value)
            elif isinstance(f, D.In) and f.value and all(isinstance(x, int) for x in f.value):
                low, high = min(f.value), max(f.value)
                yield f  # the range is wider than the list
            else:
                yield f
                continue
            s, e = self.ranges[axis]
            self.ranges[axis] = (int(max(s, low)), int(min(e, high + 1))) if low <= high and low == low else (0, 0)


def _joined(pieces) -> Iterator[tuple[int, int]]:
    """Runs that follow one another without a gap as one."""
    now = None
    for start, length in pieces:
        if now and now[0] + now[1] == start:
            now = now[0], now[1] + length
            continue
        if now:
            yield now
        now = start, length
    if now:
        yield now


class ArraySource(D.DataSource):
    @classmethod
    def name(cls):
        return "npy"

    def schema(self):
        return ", ".join([*[f"{n} int" for n in header(self.options["path"], self.options.get("key")).names()], "v double"])

    def reader(self, schema):
        kind = WholeReader if self.options.get("pushdown") == "false" else ArrayReader
        return kind(self.options["path"], int(self.options.get("chunk", CHUNK)), self.options.get("key"))


def read(spark, path: str, chunk: int = CHUNK, key: str | None = None):
    """i0.., t, v of an array; filters on the axes reach the file where the session has, now and when it runs,
    ``spark.sql.python.filterPushdown.enabled``."""
    spark.dataSource.register(ArraySource)
    reader = spark.read.format("npy").option("chunk", chunk).option("pushdown", str(spark.conf.get("spark.sql.python.filterPushdown.enabled")).lower())
    return (reader if key is None else reader.option("key", key)).load(path)
