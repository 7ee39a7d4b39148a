"""Frequency of every distinct term, and how distinctive a term is of a record.

Both begin with per-record term counts made inside the row, without a shuffle: the words are sorted and the lengths of
their runs taken. Aggregation then combines by hash on the map side before anything is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.functions.text import term_counts
from murmur.storage import unused


def words(text: Column) -> Column:
    """Longest runs of Unicode letters of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+)"), F.lit(1))


def term_frequencies(df: DataFrame, text_col: str = "text", rare_rows: int = 2, common_share: float = 0.1) -> DataFrame:
    """(term, occurrences, records, mark) for every distinct word of the column.

    ``mark`` is ``rare`` for words in at most ``rare_rows`` rows, ``common`` for words in at least ``common_share`` of all
    rows, those with null text included, else null; a word that is both is ``rare``. Null, empty and wordless texts count
    as rows but give no words; an empty table gives no rows.
    """
    counts = df.select(F.inline(term_counts(words(F.col(text_col)))))
    totals = counts.groupBy("term").agg(F.sum("tf").alias("occurrences"), F.count("*").alias("records"))
    n = df.agg(F.count("*")).scalar()
    mark = F.when(F.col("records") <= rare_rows, "rare").when(F.col("records") >= F.lit(float(common_share)) * n, "common")
    return totals.withColumn("mark", mark)


def term_relevance(df: DataFrame, id_col: str = "row_id", text_col: str = "text", k1: float = 1.2, b: float = 0.75, frequent: float = 0.001) -> DataFrame:
    """(id_col, term, tf, records, score): how distinctive each word is of each row.

    score = ln(1 + (N - n + 0.5) / (n + 0.5)) * tf (k1 + 1) / (tf + k1 (1 - b + b length / mean length)), with N all rows,
    n the rows that hold the word, and lengths in words over all rows. Rows without words give nothing; repeated rows
    count each by itself; null ids stay null.

    Words in more than the share ``frequent`` of the rows would be hot keys of the join. There are at most mean length /
    ``frequent`` of them, whatever the size of the collection, so they are broadcast; all others are joined by shuffle.
    """
    length = unused(df, "__length")
    held = df.select(F.col(id_col), words(F.col(text_col)).alias("__words"))
    terms = held.select(F.col(id_col), F.size("__words").alias(length), F.inline(term_counts(F.col("__words"))))
    records = terms.groupBy("term").agg(F.count("*").alias("records"))
    stats = df.select(F.coalesce(F.size(words(F.col(text_col))), F.lit(0)).alias("size"))
    # two queries, as the number of rows needs no words and the mean no more than where the score is asked for
    n, mean = df.agg(F.count("*")).scalar(), stats.agg(F.avg("size")).scalar()
    often = records.where(F.col("records") > F.lit(float(frequent)) * n)
    seldom = records.where(F.col("records") <= F.lit(float(frequent)) * n)
    idf = F.log(1 + (n - F.col("records") + 0.5) / (F.col("records") + 0.5))
    score = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col(length) / mean))
    columns = [F.col(id_col), "term", "tf", "records"]
    hot = terms.join(F.broadcast(often), "term").select(*columns, score.alias("score"))
    cold = terms.join(F.broadcast(often.select("term")), "term", "left_anti").join(seldom, "term").select(*columns, score.alias("score"))
    return hot.unionByName(cold)
