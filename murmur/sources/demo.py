"""Headline metrics of the demonstration report, derived from the id alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def metrics(videos: DataFrame, id_col: str = "video_id") -> DataFrame:
    """(id_col, comments, positive, neutral, negative): fixed bases plus an offset, the first four hex digits of the id's SHA-256."""
    offset = F.conv(F.substring(F.sha2(F.col(id_col), 256), 1, 4), 16, 10).cast("long")
    rows = videos.select(id_col, (1248 + offset % 6100).alias("comments"), (52 + offset % 18).alias("positive"), (11 + offset % 10).alias("negative"))
    return rows.select(id_col, "comments", "positive", (100 - F.col("positive") - F.col("negative")).alias("neutral"), "negative")


SQL = """
select video_id, 1248 + o % 6100 as comments, 52 + o % 18 as positive, 100 - (52 + o % 18) - (11 + o % 10) as neutral, 11 + o % 10 as negative
from (select video_id, ('0x' || substring(sha256(video_id), 1, 4))::bigint as o from videos)"""
