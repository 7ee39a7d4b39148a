"""Splitting of oversized texts at natural boundaries, with sizes in tokens of a public vocabulary.

Every token position that begins a character is a boundary and carries a penalty: paragraph, line, sentence, clause, word,
inside a word.  A dynamic program over all of them picks the cuts, of any number, that minimise the sum of the cut
penalties and of the squared shortfalls of the pieces from the limit, with no piece above the limit and the given overlap
between neighbours.  For a given number of pieces that sum is least where their sizes are even.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmur.llm.tokens import VOCABULARY, worker_encoder

#: Penalties of a cut by the kind of boundary.
PARAGRAPH, LINE, SENTENCE, CLAUSE, WORD, INSIDE = 0.0, 0.5, 1.0, 3.0, 6.0, 20.0
#: Weight of a piece's squared shortfall, relative to the limit.
BALANCE = 4.0
#: A piece but the last brings at least this part of limit - overlap in new tokens.
LEAST = 8
HAS_INNER, WIDE = 1000.0, 10000.0
_SENTENCE_ENDS = ".!?…。！？"
_CLAUSE_ENDS = ",;:)，；：、"
_ENDS = _SENTENCE_ENDS + _CLAUSE_ENDS
_INNER = re.compile(f"[\n{re.escape(_ENDS)}]")


class Planner:
    """The cheapest cuts for one limit and overlap.

    Positions are taken in blocks as long as the least piece, so that a block rests on positions before it only: its costs
    are one matrix of block by window, which is the same for every block as long as the overlaps begin at characters.
    """

    def __init__(self, limit: int, overlap: int):
        self.limit, self.overlap, self.step = limit, overlap, limit - overlap
        self.least = max(1, self.step // LEAST)
        sizes = np.arange(limit + 4)
        self.price = np.where(sizes <= limit, BALANCE * ((limit - sizes) / limit) ** 2, np.inf)
        # by tokens that an overlap grows by: block position by window position, the window being the step before the block
        fresh = np.arange(self.least)[:, None] + self.step - np.arange(self.step)[None, :]
        fits = (fresh >= self.least) & (fresh <= self.step)
        tables = [np.where(fits, self.price[np.minimum(fresh + overlap + more, limit + 3)], np.inf) for more in range(4)]
        self.turned = np.ascontiguousarray(np.stack(tables).transpose(0, 2, 1))
        # the most and the least that a window position costs over the block, without growth and with any
        self.bounds = [(t.max(axis=(0, 2)), t.min(axis=(0, 2))) for t in (self.turned[:1], self.turned)]

    def worth(self, before: np.ndarray, uneven: bool) -> np.ndarray:
        """Window positions that may give a place of the block its least cost, by the costs up to the window's cuts."""
        most, fewest = self.bounds[uneven]
        # a cut counts only if it may come below what some cut gives for every place of the block
        bound, at_best = np.minimum.reduce(before + most), before + fewest
        kept = (at_best <= bound if bound < np.inf else at_best < np.inf).nonzero()[0]
        if len(kept) > 24:
            # nor if one before it, which the whole block can reach, costs no more, as that one's piece is the fuller; with
            # growth, up to three tokens, it is that if it is three tokens before
            growth, back = (3, 3) if uneven else (0, 1)
            costs = before.take(kept)
            first = min(int(kept.searchsorted(self.least - 1 + growth)), len(kept) - back)
            count = np.ones(len(kept), bool)
            count[first + back :] = costs[first + back :] < np.minimum.accumulate(costs[first:-back])
            kept = kept[count]
        return kept

    def plan(self, penalties: np.ndarray, more: np.ndarray) -> list[int]:
        """Ends of the pieces, in tokens, the last one being the text's end.

        penalties[p]: the penalty of a cut before token p, infinite where none may be; more[p]: by how many tokens, at
        most three, the overlap after such a cut grows. Both have a place for each token and one for the end.
        """
        total, limit, step, least = len(penalties) - 1, self.limit, self.step, self.least
        if total <= limit:
            return [total]
        # places before the text stand for the window of the first blocks
        best = np.full(step + total + 1, np.inf)
        grown = np.zeros(step + total + 1, np.int64)
        grown[step:] = more
        uneven = bool(more.any())
        even = self.turned[0]
        lowest = max(least, self.overlap + 1)
        for at in range(lowest, total, least):
            end = min(at + least, total)
            before = best[at : at + step]
            kept = self.worth(before, uneven)
            costs = before.take(kept)
            prices = self.turned[grown[at : at + step].take(kept), kept] if uneven else even.take(kept, axis=0)
            value = np.minimum.reduce(prices + costs[:, None], axis=0, initial=np.inf)[: end - at]
            if at <= limit:
                # the first piece has no overlap
                value = np.minimum(value, self.price[np.minimum(np.arange(at, end), limit + 3)])
            best[step + at : step + end] = value + penalties[at:end]
        # which cut came before is found again for the cuts of the best way alone
        out, p = [total], total
        while True:
            low = max(lowest, p - step)
            high = p if p == total else p - least + 1
            ways = best[step + low : step + high] + self.price[np.minimum(p - np.arange(low, high) + self.overlap + more[low:high], limit + 3)]
            alone = self.price[p] if p <= limit else np.inf
            if not len(ways) or alone <= ways.min():
                return out[::-1]
            p = low + int(ways.argmin())
            out.append(p)


class _Marks(dict):
    """By span: the penalty of a cut after it, with HAS_INNER on top if there are cuts inside, which are in ``inner``, and
    WIDE if it has characters of several bytes."""

    def __init__(self, encoder):
        super().__init__()
        self.encoder, self.inner = encoder, {}

    def __missing__(self, span: str) -> float:
        last = span.rstrip("\"'”’»")[-1:]
        self[span] = after = (WORD if not last else SENTENCE if last in _SENTENCE_ENDS else CLAUSE if last in _CLAUSE_ENDS else WORD) + (0.0 if span.isascii() else WIDE)
        if span.isalpha() or span[:-1].isalpha() and span.isascii():
            return after
        plain = not _INNER.search(span, 0, len(span) - 1)
        if plain and len(span) < 6:
            return after
        words = self.encoder.words(" " + span)
        if plain and len(words) <= 6:
            return after
        known = self.encoder.known
        if missing := [word for word in words[:-1] if word not in known]:
            self.encoder._contract(missing)
        found, tokens, run, many = [], 0, 0, len(words) > 6
        for word, following in itertools.pairwise(words):
            tokens += len(known[word])
            if word.isspace():
                # the line feeds of a whole run of blank words count together, at its end
                run += word.count("\n")
                if run and not following.isspace():
                    found.append((tokens, PARAGRAPH if run > 1 else LINE))
            else:
                run = 0
                if many or word[-1] in _ENDS:
                    found.append((tokens, SENTENCE if word[-1] in "。！？" else CLAUSE if word[-1] in "，；：、" else INSIDE / 2))
        if found:
            self.inner[span] = found
            self[span] = after = after + HAS_INNER
        return after


class Splitter:
    def __init__(self, vocabulary: str, limit: int, overlap: int):
        self.encoder = worker_encoder(vocabulary)
        self.limit, self.overlap = limit, overlap
        self.bytes_of = sorted(self.encoder.ranks, key=self.encoder.ranks.get)
        #: Whether a token begins with the first byte of a character.
        self.begins = np.array([t[0] & 0xC0 != 0x80 for t in self.bytes_of])
        self.planner = Planner(limit, overlap)
        self.marks = _Marks(self.encoder)

    def split(self, parts: list[str], ids: list[tuple[int, ...]]) -> list[tuple[int, int]]:
        """(first token, end) of each piece of a text given by its spans."""
        sizes = list(map(len, ids))
        total = sum(sizes)
        if total <= self.limit:
            return [(0, total)]
        if len(self.marks) > 200_000:
            self.marks = _Marks(self.encoder)
        penalties = np.full(total + 1, INSIDE)
        sizes = np.array(sizes)
        ends = np.cumsum(sizes)
        marks = np.fromiter(map(self.marks.__getitem__, parts), np.float64, len(parts))
        wide = np.flatnonzero(marks >= WIDE)
        marks[wide] -= WIDE
        parted = np.flatnonzero(marks >= HAS_INNER)
        marks[parted] -= HAS_INNER
        if (sizes == 0).any():
            np.minimum.at(penalties, ends, marks)
        else:
            penalties[ends] = marks
        inner = [self.marks.inner[parts[k]] for k in parted]
        places = np.repeat(ends[parted] - sizes[parted], [len(x) for x in inner]) + np.array([t for x in inner for t, _ in x], np.int64)
        penalties[places] = np.minimum(penalties[places], [p for x in inner for _, p in x])
        start = np.maximum(np.arange(total + 1) - self.overlap, 0)
        more = np.zeros(total + 1, np.int64)
        # only spans with characters of several bytes have tokens that don't begin one
        if len(wide):
            tokens = np.array([t for k in wide.tolist() for t in ids[k]], np.int64)
            many = sizes[wide]
            within = (np.arange(len(tokens)) + np.repeat(ends[wide] - np.cumsum(many), many))[~self.begins[tokens]]
            if len(within):
                penalties[within] = np.inf
                # an overlap reaches back to the start of a character
                begin = np.arange(total + 1)
                begin[within] = 0
                whole = np.maximum.accumulate(begin)[start]
                start, more = whole, start - whole
        pieces = self.planner.plan(penalties, more)
        return [(0 if k == 0 else int(start[pieces[k - 1]]), end) for k, end in enumerate(pieces)]


def split_oversized(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 512, overlap: int = 64, vocabulary: str = VOCABULARY, with_text: bool = True
) -> DataFrame:
    """(id_col, piece, n_pieces, first_token, end_token[, piece_text]): the ordered pieces of each text.

    A piece has at most ``limit`` tokens; neighbours share ``overlap`` tokens, or up to three more where the overlap would
    otherwise begin inside a character. A text within the limit is one piece; null, empty texts are one piece of no tokens.
    Repeated rows are split each by itself; an empty table gives an empty table.
    """
    if not 0 <= overlap < limit - 4:
        raise ValueError("the overlap must be below the limit")
    fields = [T.StructField(id_col, df.schema[id_col].dataType), *(T.StructField(n, T.IntegerType()) for n in ("piece", "n_pieces", "first_token", "end_token"))]
    schema = T.StructType([*fields, *([T.StructField("piece_text", T.StringType())] if with_text else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter(vocabulary, limit, overlap)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            at = 0
            while at < len(texts):
                end, chars = at, 0
                while end < len(texts) and (end == at or chars < 2_000_000):
                    chars += len(texts[end] or "")
                    end += 1
                rows: tuple[list, ...] = ([], [], [], [], [], [])
                for k, (parts, ids) in enumerate(splitter.encoder.encode_spans(texts[at:end])):
                    pieces = splitter.split(parts, ids)
                    flat = [t for piece in ids for t in piece] if with_text and len(pieces) > 1 else None
                    for n, (a, b) in enumerate(pieces):
                        rows[0].append(at + k)
                        rows[1].append(n)
                        rows[2].append(len(pieces))
                        rows[3].append(a)
                        rows[4].append(b)
                        if with_text:
                            rows[5].append((texts[at + k] or "") if flat is None else b"".join(splitter.bytes_of[t] for t in flat[a:b]).decode())
                columns = [batch.column(0).take(pa.array(rows[0], pa.int64())), *(pa.array(r, pa.int32()) for r in rows[1:5])]
                if with_text:
                    columns.append(pa.array(rows[5], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)
                at = end

    return df.select(F.col(id_col), F.col(text_col).cast("string").alias("__text")).mapInArrow(run, schema)
