"""Word senses from a small inventory: targets, contexts, gloss overlap and scores.

``senses`` has a row for each (word, rank, sense, gloss, cues); it is small and broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from murmur.functions.text import let
from murmur.operators.chunking import singular

REACH = 6


def target_word(word: Column, targets: Sequence[str]) -> Column:
    """The target that a word stands for: itself, its singular, itself without ``es``, or without its last letter."""
    options = [word, singular(word), F.when(word.endswith("es"), F.left(word, F.length(word) - 2)), F.left(word, F.length(word) - 1)]
    out = None
    for o in options:
        out = F.when(o.isin(list(targets)), o) if out is None else out.when(o.isin(list(targets)), o)
    return out


def contexts(df: DataFrame, tokens: Column, targets: Sequence[str], id_col: str = "row_id") -> DataFrame:
    """(id_col, at, word, target, context): the first hit of each target in a row, with the six words on either side."""

    def of(ts: Column) -> Column:
        return let(F.filter(F.transform(ts, lambda t, i: F.struct(i.alias("at"), t.alias("word"), target_word(t, targets).alias("target"))), lambda h: h["target"].isNotNull()), lambda hits: chosen(ts, hits))

    def chosen(ts: Column, hits: Column) -> Column:
        kinds = F.array_distinct(F.transform(hits, lambda h: h["target"]))
        first = F.transform(kinds, lambda t: F.get(F.filter(hits, lambda h: h["target"] == t), F.lit(0)))
        around = lambda h: F.concat(F.slice(ts, F.greatest(h["at"] - (REACH - 1), F.lit(1)), F.least(h["at"], F.lit(REACH))), F.slice(ts, h["at"] + 2, REACH))
        return F.transform(first, lambda h: F.struct(h["at"].cast("long").alias("at"), h["word"].alias("word"), h["target"].alias("target"), around(h).alias("context")))

    return df.select(id_col, F.inline(let(tokens, of)))


def gloss_words(gloss: Column) -> Column:
    return F.array_distinct(F.slice(F.regexp_extract_all(F.lower(gloss), F.lit("([a-z]+)"), F.lit(1)), 1, 24))


def gloss_overlap(found: DataFrame, senses: DataFrame, id_col: str = "row_id") -> DataFrame:
    """(id_col, target, sense, confidence): the sense whose gloss shares most of its words with the context, the lower rank
    on ties; contexts that share none are left out. Confidence is the share, at most a half."""
    glossed = senses.select("word", "rank", "sense", gloss_words(F.col("gloss")).alias("gloss")).withColumnRenamed("word", "target")
    scored = found.join(F.broadcast(glossed), "target").withColumn("score", F.size(F.array_intersect("gloss", "context")) / F.size("gloss")).where("score > 0")
    best = scored.groupBy(id_col, "target").agg(F.max(F.struct("score", (-F.col("rank")).alias("r"), "sense")).alias("b"))
    return best.select(id_col, "target", F.col("b.sense").alias("sense"), F.round(F.least(F.lit(0.5), F.col("b.score")), 3).alias("confidence"))


def sense_scores(found: DataFrame, senses: DataFrame, id_col: str = "row_id") -> DataFrame:
    """(id_col, at, word, target, sense, rank, probability, place): every sense of a hit, by softmax over the word's senses of
    2 |context ∩ vocabulary| / |context| + 2.5 min(cue hits, 3) under a uniform prior; place 1 is the likeliest."""
    cues = F.split("cues", " ")
    table = senses.select("word", "rank", "sense", F.array_union(gloss_words(F.col("gloss")), cues).alias("vocabulary"), cues.alias("cue")).groupBy(F.col("word").alias("target")).agg(F.array_sort(F.collect_list(F.struct("rank", "sense", "vocabulary", "cue"))).alias("senses"))
    rows = found.join(F.broadcast(table), "target").withColumn("ctx", F.array_distinct("context"))
    score = lambda s: F.lit(2.0) * F.when(F.size("ctx") > 0, F.size(F.array_intersect("ctx", s["vocabulary"])) / F.size("ctx")).otherwise(0.0) + 2.5 * F.least(F.size(F.array_intersect("ctx", s["cue"])), F.lit(3))
    rows = rows.withColumn("scores", F.transform("senses", score)).withColumn("total", F.aggregate("scores", F.lit(0.0), lambda a, x: a + F.exp(x)))
    ranked = F.array_sort(F.zip_with("senses", "scores", lambda s, x: F.struct((-x).alias("minus"), s["rank"].alias("rank"), s["sense"].alias("sense"))))
    return rows.select(id_col, "at", "word", "target", "total", F.posexplode(ranked).alias("place", "s")).select(id_col, "at", "word", "target", F.col("s.sense").alias("sense"), F.col("s.rank").cast("long").alias("rank"), F.round(F.exp(-F.col("s.minus")) / F.col("total"), 6).alias("probability"), (F.col("place") + 1).cast("long").alias("place"))


def disambiguate(scored: DataFrame, senses: DataFrame, id_col: str = "row_id", others: int = 3) -> DataFrame:
    """(id_col, at, word, sense, gloss, confidence, margin, alternatives): the likeliest sense of each hit, the first part of
    its gloss, how far it leads the second, and the next senses with their probabilities."""
    order = F.array_sort(F.collect_list(F.struct("place", "sense", "probability")))
    hits = scored.groupBy(id_col, "at", "word", "target").agg(order.alias("s"))
    shown = F.array_join(F.transform(F.slice("s", 2, others), lambda x: F.concat(x["sense"], F.lit(" "), F.format_number(x["probability"], 3))), ", ")
    best = hits.select(id_col, "at", "word", F.col("s")[0]["sense"].alias("sense"), F.round(F.col("s")[0]["probability"], 3).alias("confidence"), F.round(F.col("s")[0]["probability"] - F.coalesce(F.get("s", F.lit(1))["probability"], F.lit(0.0)), 3).alias("margin"), shown.alias("alternatives"))
    return best.join(F.broadcast(senses.select("sense", F.substring_index("gloss", ";", 1).alias("gloss"))), "sense")


def breakdown(scored: DataFrame, k: int = 4) -> DataFrame:
    """(word, place, sense, count, confidence): the k most frequent senses of each surface word, the first by name on ties."""
    per = scored.where("place = 1").groupBy("word", "sense").agg(F.count("*").alias("count"), F.round(F.avg("probability"), 3).alias("confidence"))
    place = F.row_number().over(W.partitionBy("word").orderBy(F.desc("count"), "sense"))
    return per.withColumn("place", place).where(F.col("place") <= k).select("word", F.col("place").cast("long").alias("place"), "sense", "count", "confidence")


def report(scored: DataFrame, k: int = 8) -> DataFrame:
    """(word, occurrences, senses, top_sense, confidence): the k surface words with most occurrences, alphabetically on ties."""
    best = scored.where("place = 1")
    per = best.groupBy("word", "sense").agg(F.count("*").alias("n"), F.sum("probability").alias("p"))
    words = per.groupBy("word").agg(F.sum("n").alias("occurrences"), F.count("*").alias("senses"), F.min(F.struct((-F.col("n")).alias("m"), "sense"))["sense"].alias("top_sense"), (F.sum("p") / F.sum("n")).alias("confidence"))
    return words.orderBy(F.desc("occurrences"), "word").limit(k).withColumn("confidence", F.round("confidence", 3))
