"""A paginated comment API as a Spark data source: one partition for each video, pages read inside the executors.

The transport is a function named by option ``transport`` as ``module:function``. It gets the video id, the page size and
the page token and returns ``{"items": [...], "next": token or None}`` with items of author, text, likes, published_at and
updated_at, so that no client library or key is bound in here.
"""

from __future__ import annotations

import importlib
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "video_id string, position long, author string, text string, likes long, published_at timestamp, updated_at timestamp"
PAGE = 100


class VideoPartition(InputPartition):
    def __init__(self, video_id: str):
        super().__init__(video_id)
        self.video_id = video_id


def parse_time(value: str | None) -> datetime | None:
    """An ISO time, UTC where it names no zone; null for anything else."""
    try:
        found = datetime.fromisoformat(value.replace("Z", "+00:00")) if value else None
    except ValueError:
        return None
    return found if found is None or found.tzinfo else found.replace(tzinfo=timezone.utc)


class CommentReader(DataSourceReader):
    def __init__(self, options: dict):
        videos = options.get("video_ids") or ""
        self.videos = [v.strip() for v in videos.split(",") if v.strip()]
        self.most = int(options.get("max_results") or 500)
        self.transport = options.get("transport")
        if not self.transport:
            raise ValueError("option transport is needed, as module:function")

    def partitions(self) -> list[VideoPartition]:
        return [VideoPartition(v) for v in self.videos]

    def read(self, partition: VideoPartition) -> Iterator[tuple]:
        module, _, name = self.transport.partition(":")
        fetch = getattr(importlib.import_module(module), name)
        token, position = None, 0
        while position < self.most:
            page = fetch(partition.video_id, min(PAGE, self.most - position), token)
            for item in page.get("items", []):
                if position >= self.most:
                    return
                yield (partition.video_id, position, item.get("author") or "Anonymous", item.get("text") or "", int(item.get("likes") or 0), parse_time(item.get("published_at")), parse_time(item.get("updated_at")))
                position += 1
            token = page.get("next")
            if not token:
                return


class CommentSource(DataSource):
    """spark.read.format("video_comments").option("video_ids", "a,b").option("transport", "module:function").load()"""

    @classmethod
    def name(cls) -> str:
        return "video_comments"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> CommentReader:
        return CommentReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CommentSource)
