"""Pairs of unit vectors whose dot product reaches a least value, among rows that share a key term: in memory, in bounded pieces."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Pairs looked at in one step, which bounds memory.
STEP = 1 << 17
#: A group is divided by the next common term where that gives so many times fewer entries than it has pairs, down to so many terms.
GAIN, DEEP = 4, 3
#: Entries that dividing may give at once; a group that would give more is compared as it is.
MOST = 1 << 20
#: Rows and terms of whole groups that are worked on at once; a larger group is alone.
ROWS, TERMS = 20_000, 500_000
#: Room for rounding in the bounds; what they let through is computed in full.
SLACK = 1e-9


def prefix_places(start: np.ndarray, weight: np.ndarray, least: float) -> np.ndarray:
    """Places in weight of the terms that can be the first common one: the squared norm before them is within what a pair may leave out."""
    return np.flatnonzero(_before(start, weight * weight) <= 1 - least * least + SLACK)


def pairs(key: np.ndarray, start: np.ndarray, term: np.ndarray, weight: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Yields (x, y, dot) in pieces: each pair of rows with the same key whose first common term is this key and whose dot reaches least.

    Row i has the terms term[start[i] : start[i + 1]], ascending, with weights of norm 1, among them its key. A pair shares its
    first common terms, so rows are grouped by one, then by more of these, as long as the groups are large. What a row has
    before the last of them apart from them is in no pair of the group; this, and the bits of what follows, bound the dot from
    above without the terms. Only pairs that pass are computed, and only in the group of their very first common terms.
    """
    size = np.diff(start)
    row = np.repeat(np.arange(len(size)), size)
    mass = weight * weight
    before = _before(start, mass)
    bits = _later_bits(start, term)
    small = _least_masses(start, row, mass)
    code = (row.astype(np.int64) << 32) | term

    def computed(x, y, last, depth, whole):
        """Of the pairs (x, y): those without a common term up to last but the depth that they are grouped by, or at all if whole."""
        many = size[x]
        of = np.repeat(np.arange(len(x)), many)
        at = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many) + start[x][of]
        wanted = (y[of].astype(np.int64) << 32) | term[at]
        to = np.minimum(np.searchsorted(code, wanted), len(code) - 1)
        hit = code[to] == wanted
        of, at, to = of[hit], at[hit], to[hit]
        dot = np.bincount(of, weight[at] * weight[to], len(x))
        first = np.bincount(of if whole else of[term[at] <= last[of]], minlength=len(x)) == depth
        found = first & (dot >= least - SLACK)
        return x[found], y[found], dot[found]

    def within(group, at, skipped, weights, whole):
        """Pairs of entries of the same group; group ascends. whole: pairs without further common terms."""
        rest = np.zeros(len(at)) if whole else np.maximum(1 - skipped - sum(w * w for w in weights), 0)
        norm, x_of, last = np.sqrt(rest), row[at], term[at].astype(np.int64)
        end = np.searchsorted(group, group, "right")
        many = end - np.arange(len(at)) - 1
        upto = np.cumsum(many)
        done = 0
        while done < len(at):
            stop = max(done + 1, int(np.searchsorted(upto, upto[done] - many[done] + STEP, "right")))
            a = np.repeat(np.arange(done, stop), many[done:stop])
            b = np.arange(len(a)) - np.repeat(upto[done:stop] - many[done:stop] - (upto[done] - many[done]), many[done:stop]) + a + 1
            done = stop
            dot = sum(w[a] * w[b] for w in weights)
            can = dot + norm[a] * norm[b] >= least - SLACK
            a, b, dot = a[can], b[can], dot[can]
            if not whole:
                p, q = bits[:, at[a]], bits[:, at[b]]
                lost_a = small[start[x_of[a]] + x_of[a] + np.bitwise_count(p & ~q).sum(0, dtype=np.int64)]
                lost_b = small[start[x_of[b]] + x_of[b] + np.bitwise_count(q & ~p).sum(0, dtype=np.int64)]
                can = dot + np.sqrt(np.maximum(rest[a] - lost_a, 0) * np.maximum(rest[b] - lost_b, 0)) >= least - SLACK
                a, b = a[can], b[can]
            x, y, upon = x_of[a], x_of[b], last[a]
            x, y = np.where(size[x] > size[y], y, x), np.where(size[x] > size[y], x, y)
            for i, j in _runs(np.cumsum(size[x]) // STEP):
                yield computed(x[i:j], y[i:j], upon[i:j], len(weights), whole)

    lost = 1 - least * least + SLACK
    reach = row + before

    def divided(group, at, skipped, weights):
        """Pairs of entries: a row's place in term of its last common term, its mass before that which isn't common, the weights of its common terms."""
        order = np.argsort(group, kind="stable")
        _, group, rows = np.unique(group[order], return_inverse=True, return_counts=True)
        n = rows[group]
        order, group, n = order[n > 1], group[n > 1], n[n > 1]
        at, skipped, weights = at[order], skipped[order], [w[order] for w in weights]
        kept = sum(w * w for w in weights)
        # later terms of the row that can be the next common one: those passed over are within what a pair may leave out
        ends = np.searchsorted(reach, row[at] + lost + kept + 1e-7, "right")
        many = np.minimum(ends, start[row[at] + 1]) - at - 1
        cost = np.bincount(group, many, len(rows))
        large = (GAIN * cost[group] < n * (n - 1) / 2) & (cost[group] <= MOST) & (len(weights) < DEEP)
        yield from within(group[~large], at[~large], skipped[~large], [w[~large] for w in weights], False)
        whole = large & (kept >= least * least - SLACK)
        yield from within(group[whole], at[whole], None, [w[whole] for w in weights], True)
        group, at, kept, many, weights = group[large], at[large], kept[large], many[large], [w[large] for w in weights]
        if not len(at):
            return
        cost = np.bincount(group, many)
        piece = ((np.cumsum(cost) - cost) // MOST)[group]
        for i, j in _runs(piece):
            of = np.repeat(np.arange(i, j), many[i:j])
            to = np.arange(len(of)) - np.repeat(np.cumsum(many[i:j]) - many[i:j], many[i:j]) + at[of] + 1
            passed = before[to] - kept[of]
            can = passed <= lost
            of, to = of[can], to[can]
            if len(of):
                yield from divided((group[of] << 32) | term[to], to, passed[can], [*(w[of] for w in weights), weight[to]])

    at = np.flatnonzero(term == np.repeat(key, size))
    yield from divided(key.astype(np.int64), at, before[at], [weight[at]])


def _runs(values: np.ndarray) -> Iterator[tuple[int, int]]:
    """(begin, end) of the runs of equal values."""
    return itertools.pairwise([0, *np.flatnonzero(np.diff(values)) + 1, len(values)]) if len(values) else iter(())


def tfidf(firsts: np.ndarray, dfs: np.ndarray, n: int) -> Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    """Weights of norm 1 from counts, by the rows' starts and terms, where terms are places in the order of document frequency:
    those from firsts[i] to the next occur in dfs[i] of n rows. There are at most as many such steps as the root of twice all entries."""
    idf = np.log((1 + n) / (1 + dfs)) + 1

    def weigh(start: np.ndarray, term: np.ndarray, count: np.ndarray) -> np.ndarray:
        if not len(term):
            return np.zeros(0)
        weight = (1 + np.log(count)) * idf[np.searchsorted(firsts, term, "right") - 1]
        return weight / np.repeat(np.sqrt(np.add.reduceat(weight * weight, start[:-1])), np.diff(start))

    return weigh


def prefixes(least: float, weigh: Callable | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: rows (id, terms, weights), terms ascending and weights of norm 1, or counts of which weigh makes these,
    once with each key that can be their first common term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, term, weight = _lists(batch, weigh)
            at = prefix_places(start, weight, least)
            row = np.repeat(np.arange(len(start) - 1), np.diff(start))[at]
            key = term[at].astype(np.int32)
            for i in range(0, len(at), ROWS // 2):
                rows = batch.take(pa.array(row[i : i + ROWS // 2]))
                yield pa.RecordBatch.from_arrays([pa.array(key[i : i + ROWS // 2]), *rows.columns], names=["key", *rows.schema.names])

    return run


def met(least: float, weigh: Callable | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: rows of prefixes() in the order of their keys to pairs (x, y, dot)."""

    def joined(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        start, term, weight = _lists(rows, weigh)
        found, n = [], 0
        for piece in pairs(rows.column("key").to_numpy(), start, term, weight, least):
            found.append(piece)
            n += len(piece[0])
            if n >= ROWS:
                yield output(rows.column("id"), found)
                found, n = [], 0
        if n:
            yield output(rows.column("id"), found)

    def output(ids: pa.Array, found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        x, y, dot = (np.concatenate(part) for part in zip(*found, strict=True))
        return pa.RecordBatch.from_arrays([ids.take(pa.array(x)), ids.take(pa.array(y)), pa.array(dot)], names=["x", "y", "dot"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            last = batch.column("key")[-1].as_py()
            if held[0].column("key")[0].as_py() == last or sum(b.num_rows for b in held) < ROWS and sum(len(b.column("terms").flatten()) for b in held) < TERMS:
                continue
            rows = pa.concat_batches(held)
            cut = int(np.searchsorted(rows.column("key").to_numpy(), last))  # the last group may go on
            yield from joined(rows.slice(0, cut))
            held = [rows.slice(cut)]
        if held:
            yield from joined(pa.concat_batches(held))

    return run


def _lists(rows: pa.RecordBatch, weigh: Callable | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    terms, values = rows.columns[-2:]
    start = terms.offsets.to_numpy().astype(np.int64)
    start, term, value = start - start[0], terms.flatten().to_numpy().astype(np.int64), values.flatten().to_numpy()
    return start, term, weigh(start, term, value) if weigh else value


def _before(start: np.ndarray, mass: np.ndarray) -> np.ndarray:
    """Sum of the row's masses before each place."""
    sums = np.cumsum(mass) - mass
    return sums - np.repeat(sums[start[:-1]], np.diff(start))


def _later_bits(start: np.ndarray, term: np.ndarray) -> np.ndarray:
    """128 bits for each place: one set for each later term of the row."""
    mixed = (term.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(57)
    one = np.uint64(1) << (mixed & np.uint64(63))
    own = np.stack([np.where(mixed < 64, one, 0), np.where(mixed < 64, 0, one)]).astype(np.uint64)
    out, size = np.zeros_like(own), np.diff(start)
    end = start[1:][order := np.argsort(-size, kind="stable")]
    longer = np.cumsum(np.bincount(size)[::-1])[::-1]  # rows of so many terms or more
    for k in range(2, len(longer)):
        i = end[: longer[k]] - k
        out[:, i] = out[:, i + 1] | own[:, i + 1]
    return out


def _least_masses(start: np.ndarray, row: np.ndarray, mass: np.ndarray) -> np.ndarray:
    """From place start[i] + i on: the sums of the 0, 1, 2, ... least masses of row i."""
    ordered = mass[np.lexsort((mass, row))]
    out = np.zeros(len(mass) + len(start) - 1)
    out[np.arange(len(mass)) + row + 1] = _before(start, ordered) + ordered
    return out
