"""TF-IDF keywords, plain keywords and topics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from murmur.functions.text import term_counts


def tfidf_keywords(df: DataFrame, tokens: Column, id_col: str = "row_id", top_n: int = 8, most_terms: int = 500) -> DataFrame:
    """(term, weight): terms by the sum of their L2-normalised TF-IDF over all rows, in percent of the greatest.

    idf = ln((1 + N) / (1 + df)) + 1 over rows that have tokens or not; the vocabulary is the ``most_terms`` terms of the
    greatest count, the alphabetically first on ties. It is small by definition and broadcast; only occurrences of its
    terms are shuffled, once by row for the norms, and partial sums once by term.
    """
    terms = df.select(id_col, F.inline(term_counts(tokens)))
    n = df.agg(F.count("*")).scalar()
    vocabulary = terms.groupBy("term").agg(F.sum("tf").alias("count"), F.count("*").alias("df")).orderBy(F.desc("count"), "term").limit(most_terms)
    weights = vocabulary.select("term", (F.log((1 + n) / (1 + F.col("df"))) + 1).alias("idf"))
    weighed = terms.join(F.broadcast(weights), "term").withColumn("w", F.col("tf") * F.col("idf"))
    rows = weighed.groupBy(id_col).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.collect_list(F.struct("term", "w")).alias("ws"))
    sums = rows.select("norm", F.inline("ws")).groupBy("term").agg(F.sum(F.col("w") / F.col("norm")).alias("total"))
    top = sums.orderBy(F.desc(F.round("total", 6)), "term").limit(top_n)
    return top.select("term", F.round(F.col("total") * 100 / F.max("total").over(W.partitionBy())).cast("long").alias("weight"))


def simple_keywords(df: DataFrame, clean: Column, top_n: int = 8) -> DataFrame:
    """(term, count): the most frequent words of more than two letters of clean text, the first alphabetically on ties."""
    words = df.select(F.explode(F.split(clean, " ")).alias("term")).where(F.length("term") > 2)
    return words.groupBy("term").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "term").limit(top_n)


def block_topics(df: DataFrame, tokens: Column, topics: int = 4, words: int = 5) -> DataFrame:
    """(topic, words): the most frequent words cut into blocks."""
    counts = df.select(F.explode(tokens).alias("term")).groupBy("term").agg(F.count("*").alias("count"))
    top = counts.orderBy(F.desc("count"), "term").limit(topics * words)
    ranked = top.withColumn("rank", F.row_number().over(W.orderBy(F.desc("count"), "term")))
    blocks = ranked.groupBy(F.floor((F.col("rank") - 1) / words).cast("long").alias("topic")).agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("ws"))
    return blocks.select("topic", F.array_join(F.transform("ws", lambda w: w["term"]), " ").alias("words"))


def lda_topics(df: DataFrame, tokens: Column, topics: int = 4, words: int = 5, iterations: int = 20, seed: int = 42, vocabulary: int = 1000) -> DataFrame:
    """(topic, name, words, share): topics by latent Dirichlet allocation; ``share`` is the topic's part of all rows' mixtures."""
    from pyspark.ml.clustering import LDA
    from pyspark.ml.feature import CountVectorizer
    from pyspark.ml.functions import vector_to_array

    rows = df.select(tokens.alias("tokens")).where(F.size("tokens") > 0)
    schema = "topic int, name string, words string, share double"
    if not rows.take(1):
        return df.sparkSession.createDataFrame([], schema)
    counted = CountVectorizer(inputCol="tokens", outputCol="features", minDF=2, maxDF=0.95, vocabSize=vocabulary).fit(rows)
    if not counted.vocabulary:
        return df.sparkSession.createDataFrame([], schema)
    features = counted.transform(rows).select("features")
    model = LDA(k=max(1, topics), maxIter=iterations, seed=seed, optimizer="online").fit(features)
    names = model.describeTopics(words).select("topic", F.transform("termIndices", lambda i: F.array(*map(F.lit, counted.vocabulary))[i]).alias("terms"))
    mixtures = model.transform(features).select(F.posexplode(vector_to_array("topicDistribution")).alias("topic", "part"))
    shares = mixtures.groupBy("topic").agg(F.avg("part").alias("share"))
    title = F.array_join(F.transform(F.slice("terms", 1, 3), F.initcap), " ")
    return names.join(F.broadcast(shares), "topic").select("topic", title.alias("name"), F.array_join("terms", " ").alias("words"), "share")

