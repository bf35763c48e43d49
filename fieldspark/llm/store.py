"""Where intermediate tables go: the folder all executors and the driver share."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

_written: list = []
_held: list = []
_asked: list = []


def held(key, make):
    """What ``make`` gives for ``key``, kept in this process until another key is asked for, or a task of ``in_arrow`` ends that
    asked for none: a worker that serves one operator after another holds one model, and none that it has done with."""
    _asked[:] = [key]
    if not _held or _held[0] != key:
        _held.clear()
        _held[:] = key, make()
    return _held[1]


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary one only where none is set (tests)."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir")
    if path is None:
        known = sc._jsc.sc().getCheckpointDir()
        if known.isDefined():
            return known.get()
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="fieldspark-")
        sc.setCheckpointDir(path)
        return sc._jsc.sc().getCheckpointDir().get()
    return path


def table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there,
    and a lost executor costs nothing that was already written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/fieldspark-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def discard(keep: int = 0) -> None:
    """Remove the tables written so far, but for the first ``keep``."""
    while len(_written) > keep:
        spark, path = _written.pop()
        with contextlib.suppress(Exception):
            sc = spark.sparkContext
            where = sc._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


atexit.register(discard)


def slices(column, most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Bounds of runs of rows of about ``most`` bytes of text, of one row at least."""
    start, size = 0, 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(column), 0).to_pylist()):
        if size and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(column):
        yield start, len(column)


def remainder(column: str, modulus: int):
    """crc32 of a column as text modulo ``modulus``; a null counts as the empty text."""
    from pyspark.sql import functions as F

    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


#: Texts reach Python in batches of about so many bytes, where the session has Spark's own default.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20, 4 << 20


def in_arrow(df: DataFrame, run, ddl: str) -> DataFrame:
    """``df.mapInArrow`` with small batches, after which the worker, which Spark keeps for later tasks, gives free memory back."""
    name, usual, small = BATCH
    with contextlib.suppress(Exception):  # versions without the setting cut batches by rows alone
        if int(str(df.sparkSession.conf.get(name)).rstrip("b")) == usual:
            df.sparkSession.conf.set(name, small)

    def whole(batches):
        _asked.clear()
        yield from run(batches)
        if not _asked:
            _held.clear()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(Exception):  # not every system has it
            ctypes.CDLL(None).malloc_trim(0)

    return df.mapInArrow(whole, ddl)
