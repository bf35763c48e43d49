"""Ranks over a whole table without a task that sees it all."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspark.operators.cut import checkpointed

#: ``monotonically_increasing_id`` holds the partition above so many bits, the place in it below.
PLACE_BITS = 33


def ranked(frame: DataFrame, order: list[Column | str], name: str = "rank", partitions: int | None = None) -> DataFrame:
    """``frame`` with a column of ranks from 1 in an order (which should leave no ties): range partitions, each sorted, and the counts
    of those before; one count a partition reaches the driver. The table is written once, so that places and counts are of one run."""
    spark = frame.sparkSession
    partitions = partitions or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = frame.repartitionByRange(partitions, *order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    placed = checkpointed(placed)
    part = F.shiftright("_place", PLACE_BITS)
    counts = sorted((r["part"], r["n"]) for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    before = dict(zip((p for p, _ in counts), accumulate((n for _, n in counts), initial=0)))
    offset = F.element_at(F.create_map(*[F.lit(x).cast("long") for p in before.items() for x in p]), part) if before else F.lit(0)
    place = F.col("_place").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    return placed.withColumn(name, (offset + place + 1).cast("int")).drop("_place")


def head(frame: DataFrame, order: list[Column | str], k: int, name: str = "rank") -> DataFrame:
    """The first k rows in an order, with their ranks: each task hands on k rows at most."""
    return frame.orderBy(*order).limit(k).coalesce(1).sortWithinPartitions(*order).withColumn(name, (F.monotonically_increasing_id() + 1).cast("int"))
