"""Evaluation texts that leaked into a corpus: multi-pattern search after Wu and Manber over words.

Every run of ten consecutive words of a test item is a pattern. A shift table over blocks of two words tells how far a
search may jump where no pattern can end; a block that ends patterns selects their bucket, and direct comparison
confirms each occurrence. The table is broadcast up to a checked size; beyond it, windows are joined by their hashes.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pyspark.sql.pandas.types import to_arrow_type

from murmur.llm.confusables import shown
from murmur.storage import checkpointed

#: Consecutive words that make a leak.
RUN = 10
#: Words of all items that one broadcast search table may hold; a word takes about 300 bytes in it.
MOST_WORDS = 1_000_000
_WORDS = re.compile(r"[^\W_]+").findall


def plain_words(text: str) -> list[str]:
    """Runs of letters or digits, without regard to letter case, spacing and look-alike characters."""
    return _WORDS(shown(text).lower())


class Search:
    """Shift and bucket tables of the patterns: all runs of ``run`` words of the items."""

    def __init__(self, items: list[tuple[int, list[str]]], run: int = RUN):
        self.run, self.shift, self.buckets = run, {}, {}
        for item, words in items:
            for at in range(len(words) - run + 1):
                pattern = tuple(words[at : at + run])
                for k in range(1, run):
                    block = pattern[k - 1 : k + 1]
                    self.shift[block] = min(self.shift.get(block, run), run - 1 - k)
                self.buckets.setdefault(pattern[-2:], {}).setdefault(pattern[:-2], set()).add(item)

    def find(self, words: list[str]) -> set[int]:
        """Items of which the words hold a pattern."""
        found: set[int] = set()
        run, shift, far, at, n = self.run, self.shift.get, self.run - 1, self.run - 1, len(words)
        while at < n:
            block = (words[at - 1], words[at])
            if jump := shift(block, far):
                at += jump
                continue
            if (items := self.buckets[block].get(tuple(words[at - run + 1 : at - 1]))) is not None:
                found |= items
            at += 1
        return found


def find_leaks(
    documents: DataFrame, items: DataFrame, doc_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", run: int = RUN, most_words: int = MOST_WORDS
) -> DataFrame:
    """(doc_col, item_col): documents that hold ``run`` or more consecutive words of an item, in order and without gaps.

    Letter case, punctuation, spacing and look-alike characters don't count. Each pair comes once per row of documents;
    null and empty texts and items of fewer words hold nothing; empty tables give no pairs; ids may be of any type.

    The corpus is read once. Items of ``most_words`` words together, or fewer, are one broadcast search table. More than
    that, and the ends of their patterns are what is shuffled: see ``_find_by_blocks``.
    """
    if run < 2:
        raise ValueError("a run has two words or more")
    spark = documents.sparkSession
    id_type = items.schema[item_col].dataType
    schema = T.StructType([T.StructField(doc_col, documents.schema[doc_col].dataType), T.StructField(item_col, id_type)])
    corpus = documents.select(F.col(doc_col), F.col(text_col).cast("string").alias("__text")).where(F.length("__text") >= 2 * run - 1)
    held = items.select(F.col(item_col), F.col(item_text_col).cast("string").alias("__text")).where("__text is not null")
    # a text of n characters has at most n / 2 + 1 words
    if (held.agg(F.sum(F.floor(F.length("__text") / 2) + 1)).first()[0] or 0) > most_words:
        return _find_by_blocks(corpus, held, schema, run)
    rows = held.collect()
    names = pa.array([r[0] for r in rows], to_arrow_type(id_type))
    table = spark.sparkContext.broadcast((Search([(k, plain_words(r[1])) for k, r in enumerate(rows)], run), names))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, ids = table.value
        for batch in batches:
            at, hits = [], []
            for k, text in enumerate(batch.column(1)):
                found = sorted(search.find(plain_words(text.as_py())))
                at += [k] * len(found)
                hits += found
            if at:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), ids.take(pa.array(hits, pa.int64()))], names=schema.names)

    return corpus.mapInArrow(scan, schema)


def _find_by_blocks(corpus: DataFrame, items: DataFrame, schema: T.StructType, run: int) -> DataFrame:
    """The pairs for any number of items: the windows of both sides meet by the hash of their words.

    A window of the corpus is shuffled only if a filter of fixed size over the items' end blocks lets its last two words
    pass, as the shift table would. Equal windows are compared by two independent hashes of 64 bits.
    """
    doc_col, item_col = schema.names
    bits = 1 << 24

    def windows(id_name: str, filtered):
        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            passes = filtered.value if filtered is not None else None
            for batch in batches:
                at, one, two, end = [], [], [], []
                for k, text in enumerate(batch.column(1)):
                    words = plain_words(text.as_py())
                    seen = set()
                    for e in range(run, len(words) + 1):
                        block = zlib.crc32(f"{words[e - 2]} {words[e - 1]}".encode()) & (bits - 1)
                        if passes is not None and not passes[block >> 3] >> (block & 7) & 1:
                            continue
                        digest = hashlib.blake2b(" ".join(words[e - run : e]).encode(), digest_size=16).digest()
                        if digest not in seen:
                            seen.add(digest)
                            at.append(k)
                            one.append(int.from_bytes(digest[:8], "big", signed=True))
                            two.append(int.from_bytes(digest[8:], "big", signed=True))
                            end.append(block)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(end, pa.int32())], names=[id_name, "one", "two", "block"])

        return of

    def table(df: DataFrame, name: str, kind: T.DataType, filtered=None) -> DataFrame:
        fields = [T.StructField(name, kind), T.StructField("one", T.LongType()), T.StructField("two", T.LongType()), T.StructField("block", T.IntegerType())]
        return df.mapInArrow(windows(name, filtered), T.StructType(fields))

    patterns = checkpointed(table(items, item_col, schema[item_col].dataType))
    # at most two million bytes, whatever the number of items
    held = bytearray(bits >> 3)
    for row in patterns.select(F.shiftright("block", 3).alias("byte"), F.expr("shiftleft(1, block & 7)").alias("bit")).groupBy("byte").agg(F.bit_or("bit").alias("bits")).toLocalIterator():
        held[row["byte"]] = row["bits"]
    texts = table(corpus, doc_col, schema[doc_col].dataType, corpus.sparkSession.sparkContext.broadcast(bytes(held)))
    # a window that many items or documents share is counted once for each pair
    return texts.drop("block").join(patterns.drop("block").distinct(), ["one", "two"]).select(doc_col, item_col).distinct()
