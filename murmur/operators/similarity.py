"""Similarity of short texts: folded features, an exact cosine join, greedy discussion groups and redundancy."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmur.functions.text import term_counts
from murmur.lexicons import OPINION, SYNONYMS
from murmur.operators import pairing
from murmur.operators.chunking import singular
from murmur.operators.ordering import with_index
from murmur.storage import checkpointed

#: Rows that one greedy pass sees, which bounds a task; values with fewer rows are grouped by one exact pass.
BLOCK = 20_000


def folded_features(tokens: Column, stop: Sequence[str]) -> Column:
    """Tokens without stop words, in the singular, synonyms folded into one word."""
    table = F.create_map(*(F.lit(x) for pair in SYNONYMS.items() for x in pair))
    kept = F.filter(tokens, lambda t: ~t.isin(list(stop)) & ~singular(t).isin(list(stop)))
    fold = lambda t: F.when(singular(t).isin(list(SYNONYMS)), table[singular(t)]).when(t.isin(list(SYNONYMS)), table[t]).otherwise(singular(t))
    return F.transform(kept, fold)


def classes(df: DataFrame, features: Column, id_col: str = "row_id") -> DataFrame:
    """(id_col, class_id): rows with the same features as a bag share the least id among them; rows without features have none."""
    keyed = df.select(id_col, F.array_join(F.array_sort(features), " ").alias("bag")).where("bag <> ''")
    first = keyed.groupBy("bag").agg(F.min(id_col).alias("class_id"))
    return keyed.join(first, "bag").select(id_col, "class_id")


def similar_pairs(df: DataFrame, features: Column, id_col: str = "row_id", threshold: float = 0.8) -> DataFrame:
    """(a, b, cosine), a < b: pairs of class representatives whose TF-IDF cosine reaches the threshold; exact.

    Rows of equal features are one class first. Terms are ordered from rare to frequent; a pair can only reach the
    threshold if it shares a term among those of each text that come before the rest's norm falls below it, so texts meet
    by these prefixes only. Each text goes with all its terms to the keys of its prefix, and the texts of a key are
    compared there in memory (``pairing.pairs``): no candidates are written, only pairs that reach the threshold.
    """
    bags = df.select(F.col(id_col).alias("id"), F.array_sort(features).alias("f")).where(F.size("f") > 0)
    reps = checkpointed(bags.groupBy("f").agg(F.min("id").alias("id")))
    terms = reps.select("id", F.inline(term_counts(F.col("f"))))
    n = reps.count()
    df_of = with_index(terms.groupBy("term").agg(F.count("*").alias("df")), [F.col("df"), F.col("term")], "place")
    steps = df_of.groupBy("df").agg(F.min("place").alias("first")).orderBy("first").collect()
    weigh = pairing.tfidf(np.array([r["first"] for r in steps], np.int64), np.array([r["df"] for r in steps], np.int64), n)
    # a term as its place and a count, without its weight, which follows from them
    placed = terms.join(df_of, "term").where("id is not null").select("id", F.struct(F.col("place").cast("int").alias("term"), F.col("tf").cast("int").alias("count")).alias("v"))
    vectors = placed.groupBy("id").agg(F.array_sort(F.collect_list("v")).alias("v")).select("id", F.col("v.term").alias("terms"), F.col("v.count").alias("counts"))
    # less the half of the last digit that the result is rounded to
    least = threshold - 1e-6
    kind = vectors.schema["id"].dataType
    keyed = vectors.mapInArrow(pairing.prefixes(least, weigh), T.StructType([T.StructField("key", T.IntegerType()), *vectors.schema.fields]))
    # a number of its own: by size these few bytes would come together in fewer tasks than there are cores
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 3 * df.sparkSession.sparkContext.defaultParallelism)
    groups = keyed.repartition(parts, "key").sortWithinPartitions("key")
    pairs = groups.mapInArrow(pairing.met(least, weigh), T.StructType([T.StructField("x", kind), T.StructField("y", kind), T.StructField("dot", T.DoubleType())]))
    return pairs.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.round("dot", 6).alias("cosine")).where(F.col("cosine") >= threshold)


def group_labels(members: DataFrame, group: str, features_col: str, order_col: str, terms: int = 2) -> DataFrame:
    """(group, label): the two words in most members, first seen first on ties; opinions fill up; ``General`` if there are none."""
    rows = members.select(group, order_col, F.posexplode(features_col).alias("at", "word"))
    per = rows.groupBy(group, "word").agg(F.count_distinct(order_col).alias("df"), F.min(F.struct(order_col, "at")).alias("first"))
    per = per.withColumn("opinion", F.col("word").isin(*OPINION).cast("int"))
    top = per.withColumn("rank", F.row_number().over(W.partitionBy(group).orderBy("opinion", F.desc("df"), "first", "word"))).where(F.col("rank") <= terms)
    labels = top.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda x: F.initcap(x["word"])), " ").alias("label"))
    return members.select(group).distinct().join(labels, group, "left").select(group, F.coalesce("label", F.lit("General")).alias("label"))


def group_sentiment(members: DataFrame, group: str, label_col: str = "label") -> DataFrame:
    """(group, size, sentiment): the most frequent label if it has two members and half of the group, else ``mixed``."""
    counts = members.groupBy(group, label_col).agg(F.count("*").alias("n"))
    best = counts.groupBy(group).agg(F.sum("n").alias("size"), F.max(F.struct("n", label_col)).alias("m"))
    return best.select(group, "size", F.when(F.col("m.n") >= F.greatest(F.lit(2), F.col("size") / 2), F.col(f"m.{label_col}")).otherwise("mixed").alias("sentiment"))


def redundancy(sizes: DataFrame, total: Column, k: int = 6) -> DataFrame:
    """One row over the k largest groups of two or more: grouped rows, groups, redundant rows, their percent, and pairs."""
    top = sizes.where("size >= 2").orderBy(F.desc("size"), *[c for c in sizes.columns if c != "size"]).limit(k)
    row = top.agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("grouped"), F.count("*").alias("groups"), F.coalesce(F.sum(F.col("size") * (F.col("size") - 1) / 2), F.lit(0)).cast("long").alias("redundant_pairs"))
    return row.select("grouped", "groups", (F.col("grouped") - F.col("groups")).alias("redundant"), F.coalesce(F.round((F.col("grouped") - F.col("groups")) * 100 / F.nullif(total, F.lit(0)), 1), F.lit(0.0)).alias("compression"), "redundant_pairs")


def _greedy(frame: pd.DataFrame, threshold: float, df: dict[str, int], n: int) -> list[tuple[list[int], dict[str, float]]]:
    """Groups of one block in input order: (members, sum of their vectors). A member joins the group of best cosine with its
    running sum, among groups that share a subject with it; the first member counts twice in the sum. A row without
    subjects shares none and opens a group."""
    bags = [Counter(f) for f in frame["features"]]
    vectors = []
    for b in bags:
        v = {t: (1 + math.log(c)) * (math.log((1 + n) / (1 + df[t])) + 1) for t, c in b.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        vectors.append({t: x / norm for t, x in v.items()} if norm else {})
    groups: list[dict] = []
    by_subject: dict[str, list[int]] = {}
    for i, v in enumerate(vectors):
        subjects = [t for t in v if t not in OPINION]
        seen = sorted({g for t in subjects for g in by_subject.get(t, ())})
        best, score = -1, threshold
        for g in seen:
            total = groups[g]["sum"]
            s = sum(x * total.get(t, 0.0) for t, x in v.items()) / math.sqrt(groups[g]["square"])
            if s > score or (best < 0 and s >= threshold):
                best, score = g, s
        if best < 0:
            groups.append({"sum": {t: 2 * x for t, x in v.items()}, "square": 4.0, "members": [i]})
            best = len(groups) - 1
        else:
            group = groups[best]
            for t, x in v.items():
                old = group["sum"].get(t, 0.0)
                group["sum"][t] = old + x
                group["square"] += x * (2 * old + x)
            group["members"].append(i)
        for t in subjects:
            held = by_subject.setdefault(t, [])
            if best not in held:
                held.append(best)
    out = []
    for group in groups:
        total: dict[str, float] = {}
        for i in group["members"]:
            for t, x in vectors[i].items():
                total[t] = total.get(t, 0.0) + x
        out.append((group["members"], total))
    return out


def _joined(frame: pd.DataFrame, threshold: float) -> tuple[list[int], list[float]]:
    """For the groups of all blocks of one value, in order: the group of the whole that each belongs to, and its cohesion.

    A block's group joins the group of best cosine of their sums, among those of earlier blocks that share a subject with it.
    """
    whole: list[dict] = []
    by_subject: dict[str, list[int]] = {}
    chosen: list[int] = []
    waiting: list[tuple[int, dict[str, float]]] = []

    def settle() -> None:
        for g, v in waiting:
            total = whole[g]["sum"]
            for t, x in v.items():
                if t not in OPINION and t not in whole[g]["subjects"]:
                    whole[g]["subjects"].add(t)
                    by_subject.setdefault(t, []).append(g)
                total[t] = total.get(t, 0.0) + x
            whole[g]["square"] = sum(x * x for x in total.values())
        waiting.clear()

    block = None
    for at, terms, weights, size in zip(frame["block"], frame["terms"], frame["weights"], frame["size"], strict=True):
        if at != block:
            settle()
            block = at
        v = dict(zip(terms, weights, strict=True))
        length = math.sqrt(sum(x * x for x in v.values()))
        best, score = -1, threshold
        for g in sorted({g for t in v if t not in OPINION for g in by_subject.get(t, ())}):
            total = whole[g]["sum"]
            cosine = sum(x * total.get(t, 0.0) for t, x in v.items()) / math.sqrt(whole[g]["square"]) / length
            if cosine > score or (best < 0 and cosine >= threshold):
                best, score = g, cosine
        if best < 0:
            whole.append({"sum": {}, "square": 0.0, "subjects": set(), "size": 0})
            best = len(whole) - 1
        whole[best]["size"] += size
        waiting.append((best, v))
        chosen.append(best)
    settle()
    cohesion = [min(1.0, (g["square"] - g["size"]) / (g["size"] * (g["size"] - 1))) if g["size"] > 1 else 1.0 for g in whole]
    return chosen, [cohesion[g] for g in chosen]


def group_similar(df: DataFrame, features: Column, by: str, order_col: str, threshold: float = 0.30, block: int = BLOCK) -> DataFrame:
    """(by, order_col, features, block, grp, cohesion): greedy groups of similar rows in input order, within each value of ``by``.

    A value's rows are taken in blocks of at most ``block`` consecutive rows, each a task of bounded size however many
    rows the value has, weighed by the document frequencies of the whole value. Groups of different blocks then join by the
    cosine of their sums, in one task for each value. Rows without features are left out; rows without a group's company
    form groups of one. A value of one block gives the plain greedy result.
    """
    # places per value of ``by`` come from one global sort, less the value's first place, which also stands for the value
    kept = df.select(by, order_col, features.alias("features")).where(F.size("features") > 0)
    rows = with_index(kept, [F.col(by).asc(), F.col(order_col).asc()], "__index")
    firsts = rows.groupBy(F.col(by).alias("__by")).agg(F.min("__index").alias("__first"), F.count("*").alias("__n"))
    rows = rows.join(firsts, F.col(by).eqNullSafe(F.col("__by"))).withColumn("block", F.floor((F.col("__index") - F.col("__first")) / block))
    held = rows.select("__first", "block", F.explode(F.array_distinct("features")).alias("term")).groupBy("__first", "block", "term").agg(F.count("*").alias("n"))
    known = held.join(held.groupBy("__first", "term").agg(F.sum("n").alias("df")), ["__first", "term"]).select(F.col("__first").alias("__of"), F.col("block").alias("__block"), "term", "df")
    kinds = {c: df.schema[c].dataType.simpleString() for c in (by, order_col)}
    schema = f"__first long, {by} {kinds[by]}, block long, part long, members array<{kinds[order_col]}>, bags array<array<string>>, terms array<string>, weights array<double>, size long"

    def run(frame: pd.DataFrame, frequencies: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("__index").reset_index(drop=True)
        out = []
        if len(frame):
            groups = _greedy(frame, threshold, dict(zip(frequencies["term"], frequencies["df"], strict=True)), int(frame["__n"][0]))
            for g, (members, total) in enumerate(groups):
                out.append((frame["__first"][0], frame[by][0], frame["block"][0], g, [frame[order_col][i] for i in members], [list(frame["features"][i]) for i in members], list(total), list(total.values()), len(members)))
        return pd.DataFrame(out, columns=["__first", by, "block", "part", "members", "bags", "terms", "weights", "size"])

    def join(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["block", "part"]).reset_index(drop=True)
        frame["grp"], frame["cohesion"] = _joined(frame, threshold)
        return frame[["__first", "block", "part", "grp", "cohesion"]].set_axis(["__of", "__block", "__part", "grp", "cohesion"], axis=1)

    parts = checkpointed(rows.select("__first", "__n", "__index", by, order_col, "features", "block").groupBy("__first", "block").cogroup(known.groupBy("__of", "__block")).applyInPandas(run, schema))
    joined = parts.select("__first", "block", "part", "terms", "weights", "size").groupBy("__first").applyInPandas(join, "__of long, __block long, __part long, grp long, cohesion double")
    each = parts.join(joined, (F.col("__first") == F.col("__of")) & (F.col("block") == F.col("__block")) & (F.col("part") == F.col("__part"))).select(by, "block", "grp", "cohesion", F.inline(F.arrays_zip(F.col("members").alias("member"), F.col("bags").alias("bag"))))
    return each.select(by, F.col("member").alias(order_col), F.col("bag").alias("features"), "block", "grp", "cohesion")


def named_members(members: DataFrame, by: str, order_col: str, terms: int = 2) -> DataFrame:
    """The members as from ``group_similar``, each with its group's ``label``."""
    keyed = members.withColumn("key", F.struct(by, "grp"))
    return keyed.join(group_labels(keyed, "key", "features", order_col, terms), "key")


def discussion_sentiment(named: DataFrame, by: str, sentiment_col: str) -> DataFrame:
    """(by, label, size, sentiment, positive, neutral, negative): of members with label and sentiment, groups of two or more."""
    keyed = named.withColumn("key", F.struct(by, "label"))
    mix = keyed.groupBy("key").agg(*(F.count_if(F.col(sentiment_col) == s).alias(s) for s in ("positive", "neutral", "negative")))
    # fields of the key that are null join like others
    pairs = group_sentiment(keyed, "key", sentiment_col).where("size >= 2").join(mix, "key")
    return pairs.select(F.col(f"key.{by}").alias(by), F.col("key.label").alias("label"), "size", "sentiment", "positive", "neutral", "negative")


def merge_groups(members: DataFrame, by: str, order_col: str, terms: int = 2) -> DataFrame:
    """(by, label, size, cohesion, first): groups of two or more members, those of equal label merged."""
    keyed = members.withColumn("key", F.struct(by, "grp"))
    labels = group_labels(keyed, "key", "features", order_col, terms)
    sizes = keyed.groupBy("key").agg(F.count("*").alias("size"), F.first("cohesion").alias("cohesion"), F.min(order_col).alias("first"))
    named = sizes.join(labels, "key").select(F.col(f"key.{by}").alias(by), "label", "size", "cohesion", "first")
    merged = named.groupBy(by, "label").agg(F.sum("size").alias("size"), F.round(F.sum(F.col("cohesion") * F.col("size")) / F.sum("size"), 3).alias("cohesion"), F.min("first").alias("first"))
    return merged.where("size >= 2")
