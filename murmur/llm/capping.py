"""Capping of records per dominant contributor.

One global range sort by contributor and descending score; prefix sums of the partitions' counts give every record its
exact position, the contributor's start offset is subtracted, and positions below the cap are kept. The sort key ends in
a unique tie-break, so that a contributor with a third of all records is spread over many partitions.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmur.storage import checkpointed, unused

#: Authors that stand for nobody in particular, besides null and blank.
NOBODY = ("anonymous",)


def contributor_key(author: Column) -> Column:
    """Letter case and leading, trailing and repeated spaces don't count; null for null, blank and default names."""
    key = F.lower(F.trim(F.regexp_replace(author, r"(?U)\s+", " ")))
    return F.when((key != "") & ~key.isin(*NOBODY), key)


def _mark_runs(ordinal: str, key: str, out: T.StructType):
    """Adds to each row of a sorted partition its index and the index at which the run of its key starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, start, last = 0, 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(key)
            changes = pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1)).to_numpy(zero_copy_only=False)
            begins = np.append(seen == 0 or keys[0].as_py() != last, changes).astype(bool)
            at = np.arange(seen, seen + len(keys))
            starts = np.maximum.accumulate(np.where(begins, at, start))
            seen, start, last = seen + len(keys), int(starts[-1]), keys[-1].as_py()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int64()), pa.array(starts, pa.int64())], names=out.names)

    return run


def cap_contributors(
    df: DataFrame,
    contributor: Column,
    score: Column,
    tie: Sequence[Column],
    within: Sequence[str] = (),
    max_count: int | None = 5,
    max_share: float | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """The rows of df with ``position``, 1 for the contributor's best, and ``kept``.

    Rows count per contributor and per value of the columns ``within``; a null there is a value of its own. Order is by
    ``score`` descending with null last, then by ``tie``, which should end in a unique column; rows equal in all of these
    are ordered arbitrarily, but each gets a position of its own. Rows whose contributor is null are kept, without
    position. The limit is ``max_count``, or the share ``max_share`` of all rows of df (rounded down, at least one), or
    the lower of both. An empty table gives an empty table; ``position`` and ``kept`` must not be columns of df.
    """
    if max_count is None and max_share is None:
        raise ValueError("give max_count or max_share")
    spark = df.sparkSession
    columns = df.columns
    key, ordinal, index, start = (unused(df, n) for n in ("__key", "__ordinal", "__index", "__start"))
    parts = [F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n")) for c in within]
    who = unused(df, "__who")
    named = df.withColumn(who, contributor)
    order = [score.desc_nulls_last(), *(t.asc_nulls_last() for t in tie)]
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranked = (
        named.where(F.col(who).isNotNull())
        .withColumn(key, F.to_json(F.array(*parts, F.col(who))))
        .drop(who)
        .repartitionByRange(n, F.col(key), *order)
        .sortWithinPartitions(F.col(key), *order)
        .withColumn(ordinal, F.monotonically_increasing_id())
    )
    schema = T.StructType([*ranked.schema.fields, T.StructField(index, T.LongType()), T.StructField(start, T.LongType())])
    marked = checkpointed(ranked.mapInArrow(_mark_runs(ordinal, key, schema), schema))
    part = F.shiftright(F.col(ordinal), 33).cast("int")
    # one row for each partition of the sort, however many records there are
    ends = (
        marked.groupBy(part.alias("part"))
        .agg(F.count("*").alias("n"), F.max(start).alias("last"), F.min(F.struct(index, key))[key].alias("first_key"), F.max(F.struct(index, key))[key].alias("last_key"))
        .orderBy("part")
        .collect()
    )
    offsets = [0, *itertools.accumulate(r["n"] for r in ends)]
    table, open_key, open_start = [], None, 0
    for r, offset in zip(ends, offsets, strict=False):
        begin = open_start if r["first_key"] == open_key else offset
        table.append((r["part"], offset, begin))
        open_start = begin if r["last"] == 0 else offset + r["last"]
        open_key = r["last_key"]
    bounds = spark.createDataFrame(table, "__part int, __offset long, __first long")
    placed = marked.join(F.broadcast(bounds), part == F.col("__part"))
    position = F.col("__offset") + F.col(index) - F.when(F.col(start) == 0, F.col("__first")).otherwise(F.col("__offset") + F.col(start)) + 1
    limit = F.lit(max_count).cast("long") if max_count is not None else None
    if max_share is not None:
        share = F.greatest(F.lit(1), F.floor(F.lit(float(max_share)) * df.agg(F.count("*")).scalar()))
        limit = share if limit is None else F.least(limit, share)
    capped = placed.select(*columns, position.alias("position")).withColumn("kept", F.col("position") <= limit)
    free = named.where(F.col(who).isNull()).select(*columns, F.lit(None).cast("long").alias("position"), F.lit(True).alias("kept"))
    return capped.unionByName(free)


def latest_state(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(comment_id, *columns): each comment once, from the row with the greatest version, then the greatest row_id.

    The version is the later of published_at and updated_at, ignoring nulls; a row with neither is older than any other.
    """
    version = F.greatest("published_at", "updated_at")
    state = F.max(F.struct(version.alias("version"), "row_id", *columns)).alias("state")
    return df.groupBy("comment_id").agg(state).select("comment_id", *(f"state.{c}" for c in columns))
