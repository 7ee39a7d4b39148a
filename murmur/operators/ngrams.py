"""N-gram tables, time buckets and phrase trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from murmur.functions.text import ngrams, term_counts
from murmur.lexicons import frame
from murmur.operators.ordering import with_index


def gram_counts(df: DataFrame, sentences: Column, n: int) -> DataFrame:
    """(phrase, count, documents) of every n-gram inside a sentence; n-grams of one repeated word are left out."""
    grams = df.select(F.inline(term_counts(ngrams(sentences, n)))).withColumnRenamed("term", "phrase")
    if n > 1:
        grams = grams.where(F.size(F.array_distinct(F.split("phrase", " "))) > 1)
    return grams.groupBy("phrase").agg(F.sum("tf").alias("count"), F.count("*").alias("documents"))


def top_ngrams(df: DataFrame, sentences: Column, n: int, k: int = 6, min_count: int = 2) -> DataFrame:
    """(phrase, count, documents, share): the k most frequent n-grams, by count, documents, then words.

    Those below ``min_count`` are left out unless no n-gram reaches it. ``share`` is in percent of the greatest count.
    The windows run over these k rows only.
    """
    top = gram_counts(df, sentences, n).orderBy(F.desc("count"), F.desc("documents"), "phrase").limit(k)
    peak = F.max("count").over(W.partitionBy())
    kept = top.withColumn("peak", peak).where((F.col("count") >= min_count) | (F.col("peak") < min_count))
    return kept.select("phrase", "count", "documents", F.bround(F.col("count") * 100 / F.col("peak")).cast("long").alias("share"))


def ngram_summary(df: DataFrame, sentences: Column) -> DataFrame:
    """One row: rows with tokens, tokens with one marker between sentences each, and n-grams of 1 to 3 words."""
    sizes = df.select(F.transform(sentences, F.size).alias("s")).where(F.size("s") > 0)
    total = lambda f: F.coalesce(F.sum(F.aggregate(F.transform("s", f), F.lit(0), lambda a, x: a + x)), F.lit(0)).cast("long")
    markers = F.coalesce(F.sum(F.size("s") - 1), F.lit(0))
    grams = total(lambda x: x) + total(lambda x: F.greatest(x - 1, F.lit(0))) + total(lambda x: F.greatest(x - 2, F.lit(0)))
    return sizes.agg(F.count("*").alias("documents"), (total(lambda x: x) + markers).cast("long").alias("total_tokens"), grams.cast("long").alias("total_grams"))


def phrase_coverage(df: DataFrame, sentences: Column, k: int = 6) -> DataFrame:
    """One row: percent of the rows with tokens that hold one of the top bigrams."""
    top = top_ngrams(df, sentences, 2, k).agg(F.collect_list("phrase")).scalar()
    rows = df.select(ngrams(sentences, 2).alias("grams"), F.size(sentences).alias("n"), top.alias("top")).where("n > 0")
    return rows.agg(F.coalesce(F.round(F.try_divide(F.count_if(F.arrays_overlap("grams", "top")) * 100, F.count("*")), 1), F.lit(0.0)).alias("coverage"))


def time_buckets(df: DataFrame, time_col: str, buckets: int = 8) -> DataFrame:
    """df with ``bucket``: equal widths between the least and the greatest time; rows without time are left out."""
    known = df.where(F.col(time_col).isNotNull())
    micros = F.unix_micros(time_col)
    ends = known.agg(F.struct(F.min(micros).alias("low"), F.max(micros).alias("high"))).scalar()
    low, high = ends["low"], ends["high"]
    span = F.when(high > low, high - low).otherwise(1)
    return known.withColumn("bucket", F.least(F.lit(buckets - 1), F.floor((micros - low) / span * buckets)).cast("long"))


def sequential_buckets(df: DataFrame, order_col: str, buckets: int = 8) -> DataFrame:
    """df with ``bucket`` by position in the given order: blocks of n // buckets rows, the rest in the last."""
    n = df.agg(F.count("*")).scalar()
    indexed = with_index(df, [F.col(order_col).asc()], "__index")
    size = F.greatest(F.lit(1), F.floor(n / buckets))
    return indexed.withColumn("bucket", F.least(F.lit(buckets - 1), F.floor(F.col("__index") / size)).cast("long")).drop("__index")


def corpus_buckets(df: DataFrame, time_col: str, order_col: str, buckets: int = 8) -> DataFrame:
    """``time_buckets`` if every row has a time, else ``sequential_buckets``."""
    complete = not df.where(F.col(time_col).isNull()).limit(1).count()
    return time_buckets(df, time_col, buckets) if complete else sequential_buckets(df, order_col, buckets)


def phrase_trends(bucketed: DataFrame, sentences: Column, label: Column, k: int = 4, buckets: int = 8) -> DataFrame:
    """(rank, phrase, count, documents, series, momentum, direction, stance) of the top bigrams.

    ``series`` counts the rows of each bucket that hold the phrase. Momentum compares the last buckets // 3 with the first
    as many; above 0.2 rising, below -0.2 cooling. Stance is positive or negative where one label is at least twice the
    other, neutral where neither occurs, else mixed. ``bucketed`` has a column ``bucket``.
    """
    spark = bucketed.sparkSession
    leaders = top_ngrams(bucketed, sentences, 2, k).select("phrase", F.row_number().over(W.orderBy(F.desc("count"), F.desc("documents"), "phrase")).alias("rank"))
    found = bucketed.select("bucket", label.alias("label"), F.explode(F.array_distinct(ngrams(sentences, 2))).alias("phrase"))
    cells = found.join(F.broadcast(leaders), "phrase").groupBy("rank", "phrase", "bucket").agg(
        F.count("*").alias("n"), F.count_if(F.col("label") == "positive").alias("pos"), F.count_if(F.col("label") == "negative").alias("neg")
    )
    grid = leaders.select("phrase", "rank", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(buckets - 1).cast("long"))).alias("bucket"))
    dense = grid.join(cells.select("phrase", "bucket", "n", "pos", "neg"), ["phrase", "bucket"], "left").fillna(0, ["n", "pos", "neg"])
    rows = dense.groupBy("rank", "phrase").agg(
        F.sum("n").alias("documents"), F.transform(F.array_sort(F.collect_list(F.struct("bucket", "n"))), lambda b: b["n"]).alias("series"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg")
    )
    head = max(1, buckets // 3)
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)
    early, late = total(F.slice("series", 1, head)), total(F.slice("series", buckets - head + 1, head))
    momentum = (late - early) / F.greatest(early, F.lit(1))
    stance = F.when((F.col("pos") == 0) & (F.col("neg") == 0), "neutral").when(F.col("pos") >= 2 * F.col("neg"), "positive").when(F.col("neg") >= 2 * F.col("pos"), "negative").otherwise("mixed")
    return rows.select(
        F.col("rank").cast("long").alias("rank"), "phrase", F.col("documents").alias("count"), "documents", "series", F.round(momentum, 2).alias("momentum"), F.when(momentum > 0.2, "rising").when(momentum < -0.2, "cooling").otherwise("steady").alias("direction"), stance.alias("stance")
    )


# Labels of the chart's points and the offsets it shows where there is no trend.
CHART_HOURS = tuple(f"{h:02d}:00" for h in range(8, 24, 2))
CHART_OFFSETS = (-5, -2, -4, 1, 0, 3, 2, 5)


def trend_chart(trends: DataFrame, positive: Column) -> DataFrame:
    """(time, value): eight points; point i has the i-th trend's i-th bucket scaled around the positive percentage."""
    lead = trends.orderBy(F.desc("documents"), F.desc("count"), "rank").select("series", (F.row_number().over(W.orderBy(F.desc("documents"), F.desc("count"), "rank")) - 1).alias("i"))
    points = lead.select(F.col("i").cast("long").alias("i"), F.element_at("series", F.col("i") + 1).alias("v"))
    slots = frame(trends.sparkSession, list(zip(range(len(CHART_HOURS)), CHART_HOURS, CHART_OFFSETS, strict=True)), "i long, time string, offset long")
    joined = slots.join(F.broadcast(points), "i", "left").withColumn("v", F.coalesce("v", F.lit(0)))
    peak = F.max("v").over(W.partitionBy())
    value = F.when(peak > 0, F.bround(positive * (0.72 + 0.45 * F.col("v") / peak))).otherwise(positive + F.col("offset"))
    return joined.select("time", value.cast("long").alias("value"))


def trend_lift(trends: DataFrame) -> DataFrame:
    """(rank, phrase, lift): by how many percent the last bucket differs from the first, to one digit; null where that is 0."""
    first, last = F.element_at("series", 1), F.element_at("series", -1)
    return trends.select("rank", "phrase", F.round(F.try_divide((last - first) * 100, first), 1).alias("lift"))
