"""Streaming queries, run over what is available and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from murmur.functions import text as tx
from murmur.operators import similarity
from murmur.plans import sqltext as q
from murmur.plans.basics import stop_words
from murmur.streaming import comments as st


def stream_bigrams(spark, folder):
    """Counts of bigrams per day of publication."""
    stream = st.read_stream(spark, f"{folder}/comments.parquet")
    counts = st.windowed_phrases(stream, "published_at", tx.sentence_tokens(F.col("text"), stop_words(spark, folder)))
    return st.drain(counts).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "phrase", "count")


def stream_groups(spark, folder):
    stream = st.read_stream(spark, f"{folder}/comments.parquet").where("text is not null")
    features = similarity.folded_features(tx.tokenize_full(F.col("text")), stop_words(spark, folder))
    return st.drain(st.grouped(stream, features, "video_id", "row_id"), "append")


QUERIES = {"stream_bigrams": stream_bigrams, "stream_groups": stream_groups}
SQL = {
    "stream_bigrams": f"""with {q.SENT}, g as (select row_id, array_to_string(s[i:i + 1], ' ') as phrase from (select row_id, s, unnest(range(1, len(s))) as i from sent))
    select strftime(timezone('UTC', published_at), '%Y-%m-%d') as day, phrase, count(*) as count from g join comments using (row_id) where published_at is not null group by all""",
}
