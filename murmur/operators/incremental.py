"""Processing of only new or changed records, through a ledger of work items.

The ledger is a log of numbered JSON files in a shared folder. An entry is written whole under a name of its own and then
takes the next number by a rename or link that fails if the number is taken, so exactly one writer gets it and no reader
ever sees half an entry. Items are pending, leased or done. A lease carries its log number as fencing token and a time of
expiry; an expired lease counts as pending. To finish an item a worker must still hold its newest token, so a stale
worker's commit is rejected. Results and states lie in a folder that the token names, and readers take only the folders
that entries of finished leases name, so whatever a stale worker writes, and whenever, is never read.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from murmur.storage import fresh_path

#: States of one level that are merged into one of the next level.
MERGED = 8
#: Runs in one lease, which bounds the table that finds a row's run.
MOST_RUNS = 10_000


class StaleLease(RuntimeError):
    """The items were leased again since, or are done."""


@dataclass(frozen=True)
class Lease:
    token: int
    items: tuple[int, ...]
    expires: float


class _LocalLog:
    """Numbered files of a local folder; a hard link takes a number, as it fails where the name exists."""

    def __init__(self, folder: str):
        self.folder = folder
        os.makedirs(folder, exist_ok=True)

    def read(self, name: str) -> str | None:
        try:
            with open(f"{self.folder}/{name}", encoding="utf-8") as file:
                return file.read()
        except FileNotFoundError:
            return None

    def put(self, name: str, text: str) -> bool:
        own = f"{self.folder}/.{uuid.uuid4().hex}"
        with open(own, "w", encoding="utf-8") as file:
            file.write(text)
            file.flush()
            os.fsync(file.fileno())
        try:
            os.link(own, f"{self.folder}/{name}")
        except FileExistsError:
            return False
        finally:
            os.remove(own)
        return True


class _HadoopLog:
    """Numbered files of a Hadoop file system whose rename is atomic and fails where the name exists, as HDFS's does."""

    def __init__(self, spark: SparkSession, folder: str):
        jvm = spark.sparkContext._jvm
        self._path = lambda name: jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        self._fs = self._path(".").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._to_string = jvm.org.apache.commons.io.IOUtils.toString
        self._fs.mkdirs(self._path("."))

    def read(self, name: str) -> str | None:
        if not self._fs.exists(path := self._path(name)):
            return None
        stream = self._fs.open(path)
        try:
            return self._to_string(stream, "UTF-8")
        finally:
            stream.close()

    def put(self, name: str, text: str) -> bool:
        own = self._path(f"_{uuid.uuid4().hex}")
        stream = self._fs.create(own, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        if self._fs.exists(self._path(name)) or not self._fs.rename(own, self._path(name)):
            self._fs.delete(own, False)
            return False
        return True


class Ledger:
    """Work items in ``root``, a local folder or one of a Hadoop file system. ``clock`` gives the time in seconds."""

    def __init__(self, spark: SparkSession, root: str, clock: Callable[[], float] = time.time):
        self.root, self.clock = root.rstrip("/"), clock
        place = urlparse(self.root)
        self._log = _LocalLog(f"{unquote(place.path)}/log") if place.scheme == "file" else _HadoopLog(spark, f"{self.root}/log")
        self._seen: list[dict] = []

    @staticmethod
    def _name(number: int) -> str:
        return f"{number:012d}.json"

    def _entries(self) -> list[dict]:
        """All entries of the log in order; those read before are remembered, as an entry never changes."""
        while (text := self._log.read(self._name(len(self._seen)))) is not None:
            self._seen.append(json.loads(text))
        return self._seen

    def _append(self, number: int, entry: dict) -> bool:
        """Whether the entry got the number."""
        return self._log.put(self._name(number), json.dumps(entry) + "\n")

    def _commit(self, build: Callable[[list[dict]], dict | None]) -> tuple[int, dict] | None:
        """Appends what ``build`` makes of the log as it is, again and again until it gets a number; None if it makes nothing."""
        while True:
            entries = self._entries()
            entry = build(entries)
            if entry is None:
                return None
            if self._append(len(entries), entry):
                return len(entries), entry

    @staticmethod
    def _replay(entries: list[dict]) -> dict[int, dict]:
        items: dict[int, dict] = {}
        for number, e in enumerate(entries):
            if e["kind"] == "add":
                for item in e["items"]:
                    items.setdefault(item, {"state": "pending", "token": -1})
            elif e["kind"] == "lease":
                for item in e["items"]:
                    items[item] = {"state": "leased", "token": number, "expires": e["expires"]}
            elif e["kind"] in ("done", "release"):
                for item in e["items"]:
                    items[item] = {"state": "done" if e["kind"] == "done" else "pending", "token": e["token"]}
        return items

    def states(self) -> dict[int, str]:
        """The state of every item, expired leases as pending."""
        now = self.clock()
        return {i: "pending" if s["state"] == "leased" and s["expires"] <= now else s["state"] for i, s in self._replay(self._entries()).items()}

    def add(self, items: list[int]) -> None:
        """Adds items that the ledger doesn't have yet as pending; known items stay as they are."""

        def build(entries: list[dict]) -> dict | None:
            known = self._replay(entries)
            fresh = sorted(set(items) - known.keys())
            return {"kind": "add", "items": fresh} if fresh else None

        self._commit(build)

    def lease(self, most: int | None = None, seconds: float = 3600.0) -> Lease | None:
        """The first pending items, in order; None if there are none, or if an earlier item is leased by another worker,
        for an item's result rests on the states of those before it."""

        def build(entries: list[dict]) -> dict | None:
            now, free = self.clock(), []
            for item, s in sorted(self._replay(entries).items()):
                if s["state"] == "done":
                    continue
                if s["state"] == "leased" and s["expires"] > now:
                    break
                free.append(item)
            free = free[:most]
            return {"kind": "lease", "items": free, "expires": now + seconds} if free else None

        made = self._commit(build)
        return Lease(made[0], tuple(made[1]["items"]), made[1]["expires"]) if made else None

    def _close(self, lease: Lease, kind: str, **more) -> None:
        def build(entries: list[dict]) -> dict:
            items = self._replay(entries)
            if any(items[i]["state"] != "leased" or items[i]["token"] != lease.token for i in lease.items):
                raise StaleLease(f"token {lease.token} no longer holds its items")
            return {"kind": kind, "items": list(lease.items), "token": lease.token, **more}

        self._commit(build)

    def done(self, lease: Lease, **more) -> None:
        """Marks the lease's items done, with what readers need to know, as the paths of the results; raises StaleLease if
        another lease took any of them since."""
        self._close(lease, "done", **more)

    def finished(self) -> list[dict]:
        """The entries of the leases that are done, in order."""
        return [e for e in self._entries() if e["kind"] == "done"]

    def release(self, lease: Lease) -> None:
        """Gives the lease's items back before it expires; raises StaleLease like ``done``."""
        self._close(lease, "release")


def version(published: str = "published_at", updated: str = "updated_at"):
    """The later of the two times, ignoring nulls."""
    return F.greatest(F.col(published), F.col(updated))


def delivered(comments: DataFrame, runs: list[int], done_upto: int | None, upto: int) -> DataFrame:
    """(comment_id, run_id, version): per comment and successful run, the greatest version of the rows that this run hands on.

    ``runs``: at most ``MOST_RUNS`` successful runs in order. A row belongs to the first of them that isn't before the row's
    own run; rows after ``upto`` and rows up to ``done_upto`` are left out. Rows without run or comment are left out.

    The run of each row is looked up in a table of the distinct runs, which is made by one sort of as many rows as there
    are runs, and not of comments.
    """
    spark = comments.sparkSession
    rows = comments.where((F.col("run_id") <= upto) & F.col("comment_id").isNotNull()).select("comment_id", F.col("run_id").cast("long").alias("__own"), version().alias("version"))
    if done_upto is not None:
        rows = rows.where(F.col("__own") > done_upto)
    held = rows.select("__own").distinct().withColumn("__good", F.lit(None).cast("long"))
    good = spark.createDataFrame([(r, r) for r in runs], "__own long, __good long")
    later = F.min("__good").over(W.orderBy(F.desc("__own")).rangeBetween(W.unboundedPreceding, W.currentRow))
    found = held.unionByName(good).select("__own", later.alias("run_id")).distinct()
    return rows.join(found, "__own").groupBy("comment_id", "run_id").agg(F.max("version").alias("version"))


def changes(batch: DataFrame, state: DataFrame | None) -> DataFrame:
    """(run_id, comment_id): comments of the batch that are new or whose version is greater than any seen before.

    ``batch`` as from ``delivered``; ``state`` (comment_id, version): the greatest versions of all rows before the batch.
    A null version is older than any other.
    """
    known = batch.select("comment_id", "run_id", "version", F.lit(False).alias("before"))
    if state is not None:
        earlier = state.join(batch.select("comment_id").distinct(), "comment_id", "left_semi")
        known = known.unionByName(earlier.select("comment_id", F.lit(None).cast("long").alias("run_id"), "version", F.lit(True).alias("before")))
    past = W.partitionBy("comment_id").orderBy(F.col("run_id").asc_nulls_first()).rowsBetween(W.unboundedPreceding, -1)
    seen = known.withColumns({"earlier": F.count(F.lit(1)).over(past), "greatest": F.max("version").over(past)})
    newer = F.col("version").isNotNull() & (F.col("greatest").isNull() | (F.col("version") > F.col("greatest")))
    return seen.where(~F.col("before") & ((F.col("earlier") == 0) | newer)).select("run_id", "comment_id")


def _merged(states: list[dict]) -> tuple[list[dict], list[dict]]:
    """The states that stay, and those that are to be merged now: ``MERGED`` of one level, from the lowest level on."""
    for level in sorted({s["level"] for s in states}):
        same = [s for s in states if s["level"] == level]
        if len(same) >= MERGED:
            return [s for s in states if s["level"] != level], same
    return states, []


def _greatest(spark: SparkSession, root: str, states: list[dict]) -> DataFrame:
    rows = spark.read.parquet(*(f"{root}/{s['path']}" for s in states))
    return rows.groupBy("comment_id").agg(F.max("version").alias("version"))


def hand_on(comments: DataFrame, fetch_runs: DataFrame, root: str | None = None, most: int = MOST_RUNS, seconds: float = 3600.0, clock: Callable[[], float] = time.time) -> DataFrame:
    """(run_id, comment_id): what each successful run hands on, from the results of all items that are done.

    Every successful run (``succeeded`` in any letter case) is a work item; runs that did not succeed are none, and their
    rows go with the next one that did. Pending items are leased up to ``most`` at a time, computed in one job each time
    and marked done, until none is left; items that are done are never computed again. Per lease the greatest versions
    are written beside the results; every ``MERGED`` such states of a level are merged into one of the next, so that a
    lease reads its own rows and a few states, each with one row for a comment, and not the whole history.

    A worker whose lease was taken over meanwhile drops its work and goes on with what is pending. Comments that come
    twice in a run count once; a table without rows or without successful run gives an empty table. ``root`` is where the
    ledger, results and states lie; by default a new folder in spark.checkpoint.dir.
    """
    spark = comments.sparkSession
    root = (root or fresh_path(spark, "hand-on")).rstrip("/")
    ledger = Ledger(spark, root, clock)
    rows = fetch_runs.where(F.lower(F.trim("status")) == "succeeded").select("run_id").distinct().orderBy("run_id").toLocalIterator()
    ledger.add([r[0] for r in rows])
    while lease := ledger.lease(min(most, MOST_RUNS), seconds):
        hand_on_lease(comments, ledger, lease)
    results = [f"{root}/{e['result']}" for e in ledger.finished()]
    if not results:
        return spark.createDataFrame([], "run_id long, comment_id long")
    return spark.read.parquet(*results).select("run_id", "comment_id")


def hand_on_lease(comments: DataFrame, ledger: Ledger, lease: Lease) -> bool:
    """Computes and commits one lease; False if another worker holds its items by now, in which case nothing counts."""
    spark, root = comments.sparkSession, ledger.root
    before = [e for e in ledger.finished() if e["items"][-1] < lease.items[0]]
    states = before[-1]["states"] if before else []
    # a folder of this try alone: a worker that comes back late can't touch what others read
    own = f"token={lease.token:012d}/{uuid.uuid4().hex}"
    batch = delivered(comments, list(lease.items), before[-1]["items"][-1] if before else None, lease.items[-1])
    batch.write.parquet(f"{root}/{own}/batch")
    batch = spark.read.parquet(f"{root}/{own}/batch")
    changes(batch, _greatest(spark, root, states) if states else None).write.parquet(f"{root}/{own}/result")
    states = [*states, {"path": f"{own}/batch", "level": 0}]
    kept, merged = _merged(states)
    if merged:
        _greatest(spark, root, merged).write.parquet(f"{root}/{own}/state")
        states = [{"path": f"{own}/state", "level": merged[0]["level"] + 1}, *kept]
    try:
        ledger.done(lease, result=f"{own}/result", states=states)
    except StaleLease:
        return False
    return True
