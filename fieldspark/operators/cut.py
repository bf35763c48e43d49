"""Lineage cut by tables in the folder all executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a temporary one only where a local session has none."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir")
    if path is None:
        known = sc._jsc.sc().getCheckpointDir()
        if known.isDefined():
            return known.get()
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="fieldspark-"))
        return sc._jsc.sc().getCheckpointDir().get()
    return path


def checkpointed(frame: DataFrame) -> DataFrame:
    """``frame`` written as Parquet to the shared folder and read from there: lost executors cost nothing before it. (Spark's own checkpoints
    keep the plan's size estimate, which joins multiply, so that those of a loop grow without bound.)"""
    spark = frame.sparkSession
    path = f"{shared_dir(spark)}/fieldspark-cut-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    _written[path] = spark
    found = spark.read.schema(frame.schema).parquet(path)
    found._cut = path
    return found


def release(frame: DataFrame | None) -> None:
    """Removes the table behind a checkpointed frame that nothing reads any more."""
    path = getattr(frame, "_cut", None)
    spark = _written.pop(path, None)
    if spark is not None:
        with contextlib.suppress(Exception):  # at the end of a session its JVM may be gone
            sc = spark.sparkContext
            where = sc._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _release_all() -> None:
    for path in list(_written):
        release(type("Gone", (), {"_cut": path})())
