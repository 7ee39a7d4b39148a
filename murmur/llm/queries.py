"""Registered queries of the subpackage; each takes the session and the folder of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.llm import abuse, capping, confusables, frequency, leakage, pii, splitting, tokens


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _capped(spark: SparkSession, folder: str) -> DataFrame:
    latest = capping.latest_state(_table(spark, folder, "comments"), ["video_id", "author", "likes"])
    return capping.cap_contributors(latest, capping.contributor_key(F.col("author")), F.coalesce("likes", F.lit(0)), [F.col("comment_id")], within=["video_id"])


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return _capped(spark, folder).where(~F.col("kept")).select("comment_id")


def p1_kept(spark: SparkSession, folder: str) -> DataFrame:
    return _capped(spark, folder).where("kept").select("comment_id", "video_id", "position")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return confusables.look_alike_pairs(_table(spark, folder, "comments"))


def p2_forms(spark: SparkSession, folder: str) -> DataFrame:
    return confusables.with_skeleton(_table(spark, folder, "comments").select("row_id", "text")).select("row_id", "skeleton")


def p2_classes(spark: SparkSession, folder: str) -> DataFrame:
    return confusables.look_alike_classes(_table(spark, folder, "comments"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return pii.personal_information(_table(spark, folder, "comments"), _table(spark, folder, "given_name"))


def p3_redacted(spark: SparkSession, folder: str) -> DataFrame:
    return pii.redact_columns(_table(spark, folder, "comments").select("row_id", "text", "author"), _table(spark, folder, "given_name")).select("row_id", "text", "author")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    scored = frequency.term_relevance(_table(spark, folder, "comments"))
    return scored.where(F.col("term").rlike("^[a-z]{6,}$") & (F.col("tf") >= 3) & F.col("records").between(2, 12)).select("row_id", "term")


def p4_scores(spark: SparkSession, folder: str) -> DataFrame:
    return frequency.term_relevance(_table(spark, folder, "comments")).select("row_id", "term", "tf", F.round("score", 6).alias("score"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return frequency.term_frequencies(_table(spark, folder, "comments")).where("mark is not null").select("term", "mark")


def p5_counts(spark: SparkSession, folder: str) -> DataFrame:
    return frequency.term_frequencies(_table(spark, folder, "comments"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return abuse.scored_rows(_table(spark, folder, "comments"), _table(spark, folder, "abuse_labels")).where("abusive").select("row_id")


def p6_rates(spark: SparkSession, folder: str) -> DataFrame:
    scored = abuse.scored_rows(_table(spark, folder, "comments"), _table(spark, folder, "abuse_labels"), keep=["video_id"])
    by_video = abuse.rates_by_source(scored, ["video_id"])
    named = by_video.join(_table(spark, folder, "videos").select("video_id", "channel"), "video_id", "left")
    rates = named.groupBy("channel").agg(F.sum("rows").alias("rows"), F.sum("abusive_rows").alias("abusive_rows"))
    return rates.withColumn("rate", F.col("abusive_rows") / F.col("rows"))


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.encode_corpus(_table(spark, folder, "documents"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.find_leaks(_table(spark, folder, "documents"), _table(spark, folder, "test_items"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    pieces = splitting.split_oversized(_table(spark, folder, "documents"), with_text=False)
    return pieces.where("piece = 1").select("doc_id")


def p10_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.split_oversized(_table(spark, folder, "documents")).select("doc_id", "piece", "n_pieces", "first_token", "end_token", "piece_text")


QUERIES = {f.__name__: f for f in (p1_found, p1_kept, p2_found, p2_forms, p2_classes, p3_found, p3_redacted, p4_found, p4_scores, p5_found, p5_counts, p6_found, p6_rates, p8_ids, p9_found, p10_found, p10_pieces)}
