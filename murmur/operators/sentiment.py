"""Lexicon sentiment, its mix, and an extractive summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.functions.text import SENTENCE_END, let
from murmur.lexicons import frame

LABELS = ("positive", "neutral", "negative")


def polarity(tokens: Column, lexicon: dict[str, float]) -> Column:
    """Mean polarity of the tokens that are in the lexicon, each occurrence counted; 0 without any."""
    if not lexicon:
        return F.lit(0.0)
    table = F.create_map(*(F.lit(x) for pair in lexicon.items() for x in pair))
    known = F.filter(tokens, lambda t: t.isin(list(lexicon)))
    total = lambda k: F.aggregate(k, F.lit(0.0), lambda a, t: a + table[t])
    return let(known, lambda k: F.when(F.size(k) > 0, total(k) / F.size(k)).otherwise(F.lit(0.0)))


def label(score: Column, bound: float = 0.1) -> Column:
    """positive above the bound, negative below its opposite, else neutral; both strictly."""
    return F.when(score > bound, "positive").when(score < -bound, "negative").otherwise("neutral")


def percent(part: Column, whole: Column) -> Column:
    """Whole percent, rounded half to even; 0 of nothing is 0."""
    return F.coalesce(F.bround(part * 100 / F.when(whole > 0, whole)), F.lit(0)).cast("long")


def sentiment_mix(labelled: DataFrame, label_col: str = "label") -> DataFrame:
    """(label, comments, percent) for each of the three labels, also those that don't occur."""
    counts = labelled.groupBy(label_col).agg(F.count("*").alias("comments"))
    shown = frame(labelled.sparkSession, [(x,) for x in LABELS], "label string").join(F.broadcast(counts), F.col("label") == F.col(label_col) if label_col != "label" else "label", "left")
    total = labelled.agg(F.count("*")).scalar()
    return shown.select("label", F.coalesce("comments", F.lit(0)).cast("long").alias("comments"), percent(F.coalesce("comments", F.lit(0)), total).alias("percent"))


def headline_metrics(labelled: DataFrame, label_col: str = "label") -> DataFrame:
    """One row: comments, positive and negative percent, neutral as the rest to 100, and engagement."""
    is_ = lambda x: F.count_if(F.col(label_col) == x)
    row = labelled.agg(F.count("*").alias("comments"), is_("positive").alias("p"), is_("negative").alias("n"))
    row = row.select("comments", percent(F.col("p"), F.col("comments")).alias("positive"), percent(F.col("n"), F.col("comments")).alias("negative"))
    return row.select("comments", "positive", "negative", (100 - F.col("positive") - F.col("negative")).alias("neutral"), F.round(F.col("comments") / 100, 1).alias("engagement"))


def sentences(text: Column) -> Column:
    """Trimmed, non-empty sentences of the raw text."""
    return F.filter(F.transform(F.split(text, SENTENCE_END), lambda s: F.trim(s)), lambda s: s != "")


def summary_candidates(df: DataFrame, score: Column, id_col: str = "row_id", text_col: str = "text", k: int = 9) -> DataFrame:
    """(id_col, score, sentences): the k texts of the greatest number of sentences plus polarity; the earlier id first on ties."""
    scored = df.select(id_col, F.round(F.size(sentences(F.col(text_col))) + score, 6).alias("score"), F.size(sentences(F.col(text_col))).cast("long").alias("sentences"), F.col(text_col).alias("text"))
    return scored.where("text is not null").orderBy(F.desc("score"), id_col).limit(k)


def summarize(df: DataFrame, score: Column, id_col: str = "row_id", text_col: str = "text", count: int = 3, nothing: str = "No comments to summarize.") -> DataFrame:
    """One row with ``summary``: the first sentences of the best texts, or their first 300 characters, or the fixed text for none."""
    best = summary_candidates(df, score, id_col, text_col).agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), id_col, "text"))).alias("best"))
    joined = best.select(F.array_join(F.transform("best", lambda b: b["text"]), " ").alias("all"))
    chosen = F.array_join(F.slice(sentences(F.col("all")), 1, count), ". ")
    return joined.select(F.when(F.trim("all") == "", nothing).when(chosen == "", F.substring("all", 1, 300)).otherwise(chosen).alias("summary"))
