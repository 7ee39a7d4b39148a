"""Encoding of a whole corpus with a public byte-level BPE vocabulary.

Every partition keeps one DuckDB connection.  Words that the worker has not met yet become token-position rows; a
recursive query joins neighbouring positions to the merge table and contracts, in every word, the leftmost pair of
minimum rank until no pair is left; an ordered aggregation gives each word's ids.  Words that were met before come from
a bounded dictionary, so the recursion runs over distinct words only, while every document is encoded whole. Words of
more than 512 bytes are merged by a heap to the same result.
"""

from __future__ import annotations

import base64
import heapq
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where the vocabulary lies; every function takes another path.
VOCABULARY = os.environ.get("MURMUR_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Fixed value: the pattern that splits text into words before the merges, as published with the vocabulary.
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Spans that a worker remembers; beyond it the dictionary starts anew. It bounds memory and changes no result.
REMEMBERED = 300_000

#: A space beside another white space: such texts may not be cut at every space.
_UNEVEN = re.compile(r" \s|\s ")
_ODD_SPACE = re.compile(r"[\t\r\x0b\x0c\x1c-\x1f]")
_EVEN_SPACE = re.compile(r"(?<=\S) (?=\S)")

_CONTRACT = """
with recursive state(word, pos, token, pair, least) as (
    select word, pos, token, pair, min(pair) over (partition by word)
    from (select a.word, a.pos, a.token, m.token as pair
          from (select word, pos, token, lead(token) over (partition by word order by pos) as following from fresh) a
          left join merges m on m.first = a.token and m.second = a.following)
    union all
    select word, pos, token, pair, min(pair) over (partition by word)
    from (select a.word, a.pos, a.token, m.token as pair
          from (select word, pos, token, lead(token) over (partition by word order by pos) as following
                from (select word, pos, case when pos = chosen then pair else token end as token,
                             lag(pos) over (partition by word order by pos) is not distinct from chosen as absorbed
                      from (select word, pos, token, pair,
                                   min(case when pair = least then pos end) over (partition by word) as chosen
                            from state where least is not null))
                where not absorbed) a
          left join merges m on m.first = a.token and m.second = a.following)
)
select word, list(token order by pos) as ids from state where least is null group by word order by word
"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


#: Words of more bytes than this are rare and take one recursion step a merge, so they are merged by a heap instead.
LONG_WORD = 512


def merge_by_heap(raw: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """The ids of one very long word: the same leftmost pair of least rank, again and again, in n log n steps."""
    n = len(raw)
    end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(raw[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or (j := after[i]) >= n or end[j] != stop:
            continue
        end[i], after[i], alive[j] = stop, after[j], False
        if after[j] < n:
            before[after[j]] = i
            if (r := ranks.get(raw[i : end[after[j]]])) is not None:
                heapq.heappush(heap, (r, i, end[after[j]]))
        if (h := before[i]) >= 0 and (r := ranks.get(raw[h:stop])) is not None:
            heapq.heappush(heap, (r, h, stop))
    return tuple(ranks[raw[i : end[i]]] for i in range(n) if alive[i])


class _Spans(dict):
    """Spans and their ids; a span that is missing is noted and stands for nothing until it is learnt."""

    def __init__(self):
        super().__init__()
        self.missing: set[str] = set()

    def __missing__(self, span: str) -> None:
        self.missing.add(span)


class WordEncoder:
    """Encodes texts by the DuckDB recursion above, remembering spans between batches of one worker.

    A text is cut at its single spaces, for no word of the pattern crosses one except as its first character; a span
    stands for its text with that space before it, but for the first span of a text.
    """

    def __init__(self, path: str):
        import duckdb
        import regex

        self.ranks = read_ranks(path)
        self.words = regex.compile(WORD_PATTERN).findall
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        first, second, merged = [], [], []
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    first.append(a)
                    second.append(b)
                    merged.append(rank)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
        table = pa.table({"first": pa.array(first, pa.int32()), "second": pa.array(second, pa.int32()), "token": pa.array(merged, pa.int32())})
        self.db.register("merge_rows", table)
        self.db.execute("create table merges as select * from merge_rows")
        self.db.unregister("merge_rows")
        self.forget()

    def forget(self) -> None:
        self.first, self.later, self.known = _Spans(), _Spans(), {}

    def _contract(self, words: list[str], block: int = 20_000) -> None:
        """Adds the ids of the words to the dictionary."""
        for w in words:
            if len(raw := w.encode()) > LONG_WORD:
                self.known[w] = merge_by_heap(raw, self.ranks)
        words = [w for w in words if w not in self.known]
        for at in range(0, len(words), block):
            some = words[at : at + block]
            raw = [w.encode() for w in some]
            sizes = np.fromiter(map(len, raw), np.int64, len(raw))
            word = np.repeat(np.arange(len(raw), dtype=np.int32), sizes)
            pos = (np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
            token = self.byte_ids[np.frombuffer(b"".join(raw), dtype=np.uint8)]
            self.db.register("fresh", pa.table({"word": word, "pos": pos, "token": token}))
            out = self.db.sql(_CONTRACT).to_arrow_table()
            self.db.unregister("fresh")
            for w, ids in zip(some, out.column("ids").to_pylist(), strict=True):
                self.known[w] = tuple(ids)

    def _learn(self) -> None:
        """Encodes the spans that were missing."""
        split = [(spans, s, self.words(lead + s)) for spans, lead in ((self.first, ""), (self.later, " ")) for s in spans.missing]
        if fresh := list({w for _, _, words in split for w in words if w not in self.known}):
            self._contract(fresh)
        for spans, s, words in split:
            spans[s] = self.known[words[0]] if len(words) == 1 else tuple(t for w in words for t in self.known[w])
        self.first.missing.clear()
        self.later.missing.clear()

    def _look_up(self, parts: list[str]) -> list[tuple[int, ...]]:
        return [self.first[parts[0]], *map(self.later.__getitem__, parts[1:])] if parts else []

    def encode_spans(self, texts: list[str | None]) -> Iterator[tuple[list[str], list[tuple[int, ...]]]]:
        """The spans of each text and the ids of each span."""
        if len(self.later) > REMEMBERED or len(self.known) > REMEMBERED:
            self.forget()
        cuts = [cut(text) if text else [] for text in texts]
        ids, again = [], []
        for k, parts in enumerate(cuts):
            ids.append(self._look_up(parts))
            if self.first.missing or self.later.missing:
                again.append(k)
                if len(self.later.missing) > REMEMBERED:
                    self._learn()
        self._learn()
        for k in again:
            ids[k] = self._look_up(cuts[k])
        yield from zip(cuts, ids, strict=True)


def cut(text: str) -> list[str]:
    """Spans whose encodings, put together, are the encoding of the text."""
    uneven = "  " in text or " \n" in text or "\n " in text or bool((_ODD_SPACE if text.isascii() else _UNEVEN).search(text))
    return _EVEN_SPACE.split(text) if uneven else text.split(" ")


_WORKER: dict[str, WordEncoder] = {}


def worker_encoder(path: str) -> WordEncoder:
    """One encoder for each Python worker and vocabulary."""
    if path not in _WORKER:
        _WORKER[path] = WordEncoder(path)
    return _WORKER[path]


def encode_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, ids_col: str = "ids") -> DataFrame:
    """(id_col, ids_col): the token ids of each text, without special tokens.

    Null and empty texts give an empty list; strings that look like special tokens are ordinary text; repeated rows stay
    repeated; null ids stay null; an empty table gives an empty table. Other columns are left out.
    """
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField(ids_col, T.ArrayType(T.IntegerType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(vocabulary)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            at = 0
            while at < len(texts):
                end, chars = at, 0
                while end < len(texts) and (end == at or chars < 4_000_000):
                    chars += len(texts[end] or "")
                    end += 1
                sizes, flat = [0], []
                for _, ids in encoder.encode_spans(texts[at:end]):
                    before = len(flat)
                    for piece in ids:
                        flat.extend(piece)
                    sizes.append(sizes[-1] + len(flat) - before)
                lists = pa.ListArray.from_arrays(pa.array(np.array(sizes, np.int32)), pa.array(np.array(flat, np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), lists], names=[id_col, ids_col])
                at = end

    return df.select(F.col(id_col), F.col(text_col).cast("string").alias("__text")).mapInArrow(run, schema)
