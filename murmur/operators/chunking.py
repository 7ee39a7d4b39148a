"""Phrase chunking by a cascade of patterns over tags, key phrases, and a study of feature representations.

The tags of a row become a string with one letter each. Noun phrases are bracketed first; one pass then reads brackets
whole and finds adjective and verb phrases in what is left, so a later stage sees unchunked tags only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from murmur.functions.text import let, term_counts
from murmur.operators.pos import LETTER, TAGS, coarse, tag_letters, tag_of, tag_rules
from murmur.storage import checkpointed

#: Letters: D determiner, J adjective, R comparative, S superlative, N noun, A adverb, M modal, V verb, O any other.
NOUN_PHRASE = "(D?[JRS]*N+)"
PIECES = r"(\[[A-Z]*\]|DA+[JRS]|A+[JRS]|[RS]|M?V|.)"
NAMES = {"NP": "Noun Phrase", "ADJP": "Adjective Phrase", "VP": "Verb Phrase"}
# Tags that key phrases leave out.
DROPPED = ("DT", "CC", "PRP$", "CD")


def symbol(tag: str) -> str:
    named = {"DT": "D", "JJ": "J", "JJR": "R", "JJS": "S", "RB": "A", "MD": "M"}
    return named.get(tag) or ("N" if tag.startswith("NN") else "V" if tag.startswith("VB") else "O")


_FROM = "".join(LETTER[t] for t in TAGS if t)
_TO = "".join(symbol(t) for t in TAGS if t)


def chunks(tokens: Column, letters: Column | None = None) -> Column:
    """array<struct<type, start, tokens, tags>>: the chunks in order. Null tokens give null. ``letters``: the row's tags as
    from ``tag_letters``, which it is by default."""
    empty = F.array().cast("array<struct<type:string,start:int,size:int>>")

    def located(pieces: Column) -> Column:
        kind = lambda p: F.when(p.startswith("["), "NP").when(p.rlike("[JRS]"), "ADJP").when(p.endswith("V"), "VP")
        size = lambda p: F.when(p.startswith("["), F.length(p) - 2).otherwise(F.length(p))
        start = F.struct(F.lit(0).alias("at"), empty.alias("found"))
        step = lambda a, p: F.struct((a["at"] + size(p)).alias("at"), F.when(kind(p).isNotNull(), F.array_append(a["found"], F.struct(kind(p).alias("type"), a["at"].alias("start"), size(p).alias("size")))).otherwise(a["found"]).alias("found"))
        return F.aggregate(pieces, start, step, lambda a: a["found"])

    def of(ls: Column) -> Column:
        bracketed = F.regexp_replace(F.translate(ls, _FROM, _TO), NOUN_PHRASE, "[$1]")
        places = located(F.regexp_extract_all(bracketed, F.lit(PIECES), F.lit(1)))
        tags = lambda c: F.transform(F.filter(F.split(F.substring(ls, c["start"] + 1, c["size"]), ""), lambda x: x != ""), tag_of)
        return F.transform(places, lambda c: F.struct(c["type"].alias("type"), c["start"].alias("start"), F.slice(tokens, c["start"] + 1, c["size"]).alias("tokens"), tags(c).alias("tags")))

    return let(tag_letters(tokens) if letters is None else letters, of)


def head(chunk: Column) -> Column:
    """The last noun of a chunk, else its last word."""
    nouns = F.filter(F.arrays_zip(chunk["tokens"].alias("w"), chunk["tags"].alias("t")), lambda x: x["t"].startswith("NN"))
    return F.coalesce(F.try_element_at(nouns, F.lit(-1))["w"], F.element_at(chunk["tokens"], -1))


def chunk_types(df: DataFrame, chunk_col: str = "chunks") -> DataFrame:
    """(type, count, share): chunks by type, share in percent of all."""
    kinds = df.select(F.inline(term_counts(F.transform(chunk_col, lambda c: c["type"])))).groupBy(F.col("term").alias("type")).agg(F.sum("tf").alias("count"))
    return kinds.withColumn("share", F.round(F.col("count") * 100 / F.sum("count").over(W.partitionBy()), 1))


def chunk_summary(df: DataFrame, chunk_col: str = "chunks") -> DataFrame:
    """One row: rows, chunks, and their mean a row."""
    return df.agg(F.count("*").alias("comments"), F.coalesce(F.sum(F.size(chunk_col)), F.lit(0)).cast("long").alias("chunks"), F.round(F.coalesce(F.avg(F.size(chunk_col)), F.lit(0.0)), 2).alias("mean_chunks"))


def chunk_example(df: DataFrame, chunk_col: str = "chunks", tokens_col: str = "tokens", id_col: str = "row_id", least: int = 4) -> DataFrame:
    """(id_col, sentence, chunks): the first row of more than ``least`` tokens, with its chunks in brackets; none for none."""
    shown = F.array_join(F.transform(chunk_col, lambda c: F.concat(F.lit("["), F.array_join(c["tokens"], " "), F.lit(" "), c["type"], F.lit("]"))), " ")
    return df.where(F.size(tokens_col) > least).select(id_col, F.array_join(tokens_col, " ").alias("sentence"), shown.alias("chunks")).orderBy(id_col).limit(1)


def singular(word: Column) -> Column:
    """The singular by rule: ies to y, es after a hissing sound, else s unless doubled."""
    long = F.length(word) > 3
    return (
        F.when(long & word.rlike("[^aeiou]ies$"), F.concat(F.left(word, F.length(word) - 3), F.lit("y"))).when(long & word.rlike("(ss|x|z|ch|sh)es$"), F.left(word, F.length(word) - 2)).when(long & word.rlike("[^su]s$"), F.left(word, F.length(word) - 1)).otherwise(word)
    )


def phrases(chunk_col: Column) -> Column:
    """array<string>: noun and adjective phrases without determiners, conjunctions, possessives and numbers, words in the singular; one to three words."""

    def words(c: Column) -> Column:
        kept = F.filter(F.arrays_zip(c["tokens"].alias("w"), c["tags"].alias("t")), lambda x: ~x["t"].isin(*DROPPED))
        return F.transform(kept, lambda x: singular(x["w"]))

    wanted = F.transform(F.filter(chunk_col, lambda c: c["type"].isin("NP", "ADJP")), words)
    fine = F.filter(wanted, lambda w: F.size(w).between(1, 3) & ((F.size(w) > 1) | (F.length(w[0]) >= 3)))
    return F.transform(fine, lambda w: F.array_join(w, " "))


def key_phrases(df: DataFrame, chunk_col: str = "chunks", k: int = 6) -> DataFrame:
    """(phrase, count, documents, share, comment_share): the k most frequent phrases, by count, documents, then text."""
    per_row = df.select(F.inline(term_counts(phrases(F.col(chunk_col))))).withColumnRenamed("term", "phrase")
    total = df.agg(F.count("*")).scalar()
    top = per_row.groupBy("phrase").agg(F.sum("tf").alias("count"), F.count("*").alias("documents")).orderBy(F.desc("count"), F.desc("documents"), "phrase").limit(k)
    return top.select("phrase", "count", "documents", F.bround(F.col("count") * 100 / F.max("count").over(W.partitionBy())).cast("long").alias("share"), F.round(F.col("documents") * 100 / total, 1).alias("comment_share"))


def feature_strings(tokens: Column, chunk_col: Column) -> dict[str, Column]:
    """The four representations of a row: words, words with their group, chunk texts (words if none), and all three."""
    words = F.array_join(tokens, " ")
    tagged = F.array_join(F.zip_with(tokens, tag_rules(tokens), lambda w, t: F.concat(w, F.lit("_"), coarse(t))), " ")
    joined = F.array_join(F.transform(chunk_col, lambda c: F.array_join(c["tokens"], "_")), " ")
    chunked = F.when(joined == "", words).otherwise(joined)
    return {"unigrams": words, "pos": tagged, "chunks": chunked, "combined": F.concat_ws(" || ", words, tagged, chunked)}


# The shares of the texts that the study trains on.
FRACTIONS = (0.25, 0.5, 0.75, 1.0)


def study_outcome(scores: DataFrame, sizes: DataFrame) -> DataFrame:
    """One row: the best feature set by f1, then accuracy, then the order of the study; or the reason that there is none."""
    place = F.array_position(F.array(*map(F.lit, ("unigrams", "pos", "chunks", "combined"))), F.col("feature_set"))
    best = scores.agg(F.max(F.struct("f1", "accuracy", (-F.col("fraction")).alias("early"), (-place).alias("place"), "feature_set", "fraction")).alias("b"), F.count("*").alias("n"))
    reason = F.when(F.col("n") > 0, F.lit(None)).when(F.col("sizes") == 0, "too few texts with a clear sentiment").otherwise("texts of one sentiment only").cast("string")
    return best.withColumn("sizes", sizes.agg(F.count("*")).scalar()).select(F.col("b.feature_set").alias("feature_set"), F.col("b.fraction").alias("fraction"), F.col("b.f1").alias("f1"), F.col("b.accuracy").alias("accuracy"), reason.alias("reason"))


def study_rows(df: DataFrame, tokens_col: str, label_col: str, id_col: str) -> DataFrame:
    """Positive and negative rows, of equal token lists the one with the least id."""
    rows = df.where(F.col(label_col).isin("positive", "negative"))
    return rows.groupBy(F.array_join(tokens_col, " ").alias("text")).agg(F.min(F.struct(id_col, label_col)).alias("m")).select("text", F.col(f"m.{id_col}").alias(id_col), F.col(f"m.{label_col}").alias(label_col))


def study_sizes(rows: DataFrame, least: int = 12) -> DataFrame:
    """(fraction, train_size): sizes of the study's subsets; no rows if there are fewer than ``least`` texts."""
    n = rows.agg(F.count("*").alias("n")).where(F.col("n") >= least)
    sized = F.transform(F.array(*map(F.lit, FRACTIONS)), lambda f: F.struct(f.alias("fraction"), F.least(F.col("n"), F.greatest(F.lit(6), F.bround(F.col("n") * f))).cast("long").alias("train_size")))
    return n.select(F.inline(sized))


def study_scores(df: DataFrame, tokens_col: str, label_col: str, id_col: str, fractions: tuple[float, ...] = FRACTIONS, iterations: int = 600, tolerance: float = 1e-3) -> DataFrame:
    """(feature_set, fraction, train_size, accuracy, f1, vocabulary): each representation at each size, by its single
    words and pairs of neighbours.

    70 % of a subset, by hash within the label, train a logistic regression on TF-IDF; the rest tests it. Fewer than 12
    texts or a single label give no rows.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, CountVectorizer, Normalizer

    spark = df.sparkSession
    rows = study_rows(df, tokens_col, label_col, id_col).withColumn("tokens", F.split("text", " "))
    rows = rows.withColumn("chunked", chunks(F.col("tokens")))
    grams = lambda ws: F.concat(ws, F.when(F.size(ws) > 1, F.zip_with(F.slice(ws, 1, F.size(ws) - 1), F.slice(ws, 2, F.size(ws)), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.slice(ws, 1, 0)))
    forms = {n: let(F.filter(F.split(c, r"\s+"), lambda w: w != ""), grams).alias(f"f_{n}") for n, c in feature_strings(F.col("tokens"), F.col("chunked")).items()}
    sides = {"y": (F.col(label_col) == "positive").cast("double"), "order": F.pmod(F.xxhash64(id_col), F.lit(1_000_000)) / 1e6, "side": F.pmod(F.xxhash64(F.lit("side"), id_col), F.lit(10))}
    rows = checkpointed(rows.select(*(c.alias(n) for n, c in sides.items()), *forms.values()))
    out = []
    counts = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    if sum(counts.values()) >= 12 and len(counts) == 2:
        for fraction in fractions:
            part = rows.where(F.col("order") < fraction) if fraction < 1 else rows
            train, test = part.where("side < 7"), part.where("side >= 7")
            sizes = {r["y"]: r["count"] for r in train.groupBy("y").count().collect()}
            if len(sizes) < 2:
                continue
            weight = F.when(F.col("y") == 1, sum(sizes.values()) / (2 * sizes[1.0])).otherwise(sum(sizes.values()) / (2 * sizes[0.0]))
            for name in ("unigrams", "pos", "chunks", "combined"):
                stages = [CountVectorizer(inputCol=f"f_{name}", outputCol="tf", vocabSize=4000), IDF(inputCol="tf", outputCol="idf"), Normalizer(inputCol="idf", outputCol="features"), LogisticRegression(labelCol="y", weightCol="weight", maxIter=iterations, tol=tolerance, regParam=1 / (4 * max(1, sum(sizes.values()))), standardization=False)]
                model = Pipeline(stages=stages).fit(train.withColumn("weight", weight))
                r = model.transform(test).agg(F.avg((F.col("prediction") == F.col("y")).cast("double")).alias("accuracy"), F.sum(F.col("prediction") * F.col("y")).alias("tp"), F.sum("prediction").alias("p"), F.sum("y").alias("t")).first()
                f1 = 2 * (r["tp"] or 0) / ((r["p"] or 0) + (r["t"] or 0)) if (r["p"] or 0) + (r["t"] or 0) else 0.0
                out.append((name, float(fraction), int(sum(sizes.values())), float(r["accuracy"] or 0), float(f1), len(model.stages[0].vocabulary)))
    return spark.createDataFrame(out, "feature_set string, fraction double, train_size long, accuracy double, f1 double, vocabulary long")
