"""Positions in a global order without a single-partition window."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.storage import checkpointed


def with_index(df: DataFrame, order: Sequence[Column], name: str = "index", partitions: int | None = None) -> DataFrame:
    """df with each row's place, from 0, in the given order, which should be total.

    The rows are range-partitioned and sorted, then written once to the shared folder, so that the counts of the
    partitions and the places rest on the same sort; the counts, one for each partition, go to the driver.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = checkpointed(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__place", F.monotonically_increasing_id()))
    part = F.shiftright("__place", 33).cast("int")
    counts = placed.groupBy(part.alias("part")).count().orderBy("part").collect()
    offsets = itertools.accumulate((r["count"] for r in counts), initial=0)
    table = [(r["part"], o) for r, o in zip(counts, offsets, strict=False)]
    bounds = df.sparkSession.createDataFrame(table, "__part int, __offset long")
    index = F.col("__offset") + F.col("__place").bitwiseAND((1 << 33) - 1)
    return placed.join(F.broadcast(bounds), part == F.col("__part")).withColumn(name, index).drop("__place", "__part", "__offset")
