"""Comments as a stream: windowed phrase counts, and greedy grouping with state for each video."""

from __future__ import annotations

import json
import math
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from murmur.functions.text import ngrams
from murmur.lexicons import OPINION
from murmur.storage import fresh_path


def read_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """A Parquet file or the files of a folder as a stream, with the schema that they have now."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch)
    if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(place).isFile():
        return reader.option("pathGlobFilter", place.getName()).parquet(place.getParent().toString())
    return reader.parquet(path)


def windowed_phrases(stream: DataFrame, time_col: str, sentences: Column, n: int = 2, window: str = "1 day", late: str = "7 days") -> DataFrame:
    """(start, phrase, count): n-grams per tumbling window; rows later than ``late`` behind the newest are dropped from open state."""
    rows = stream.where(F.col(time_col).isNotNull()).withWatermark(time_col, late)
    grams = rows.select(time_col, F.explode(ngrams(sentences, n)).alias("phrase"))
    counts = grams.groupBy(F.window(time_col, window), "phrase").agg(F.count("*").alias("count"))
    return counts.select(F.col("window.start").alias("start"), "phrase", "count")


def drain(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Runs a streaming query over all that is available now and reads its result. ``complete`` keeps the last state of
    aggregates, ``append`` all rows emitted. Progress and results lie in the shared folder, so a restart continues."""
    spark = stream.sparkSession
    out, progress = fresh_path(spark, "stream"), fresh_path(spark, "progress")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", progress).trigger(availableNow=True)
    if mode == "complete":
        query = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out)).start()
    else:
        query = writer.format("parquet").option("path", out).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def grouped(stream: DataFrame, features: Column, by: str, id_col: str, threshold: float = 0.30, idle_ms: int | None = None) -> DataFrame:
    """(by, id_col, group): each row's greedy group within its value of ``by``, as rows arrive.

    A stream knows no document frequencies, so vectors are 1 + ln(tf), normalised. The state of a value is the running sum
    of each of its groups; a row meets only groups that share a subject with it. Rows of one batch are taken by id. Rows of
    opinion words only form a group for each order of these words. With ``idle_ms``, the groups of a value that got no row
    for so long are forgotten, and later rows of it begin anew; otherwise state is kept for good.
    """
    schema = f"{by} {stream.schema[by].dataType.simpleString()}, {id_col} {stream.schema[id_col].dataType.simpleString()}, group long"

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        groups = json.loads(state.get[0]) if state.exists else []
        squares = [sum(x * x for x in total.values()) for total in groups]
        holding: dict[str, set[int]] = {}
        for g, total in enumerate(groups):
            for t in total:
                holding.setdefault(t, set()).add(g)
        opinions = {tuple(total): g for g, total in reversed(list(enumerate(groups)))}
        rows = pd.concat(list(frames)).sort_values(id_col)
        ids, chosen = [], []
        for row_id, words in zip(rows[id_col], rows["features"], strict=True):
            v = {t: 1 + math.log(c) for t, c in Counter(words).items()}
            norm = math.sqrt(sum(x * x for x in v.values()))
            if not v:
                continue
            subjects = [t for t in v if t not in OPINION]
            best, score = -1, threshold
            if not subjects:
                # as groups of equal label are one in the end, rows of the same opinions share one
                best = opinions.get(tuple(v), -1)
            for g in sorted({g for t in subjects for g in holding.get(t, ())}):
                total = groups[g]
                s = sum(x / norm * total.get(t, 0.0) for t, x in v.items()) / math.sqrt(squares[g])
                if s > score or (best < 0 and s >= threshold):
                    best, score = g, s
            if best < 0:
                groups.append({})
                squares.append(0.0)
                best = len(groups) - 1
                opinions.setdefault(tuple(v), best)
            for t, x in v.items():
                old, more = groups[best].get(t, 0.0), x / norm
                groups[best][t] = old + more
                squares[best] += more * (2 * old + more)
                holding.setdefault(t, set()).add(best)
            ids.append(row_id)
            chosen.append(best)
        state.update((json.dumps(groups),))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({by: [key[0]] * len(ids), id_col: ids, "group": chosen})

    rows = stream.select(by, id_col, features.alias("features"))
    return rows.groupBy(by).applyInPandasWithState(run, schema, "groups string", "append", GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout)
