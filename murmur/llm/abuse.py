"""Scores for abusive, hateful and sexual content: logistic regression by FTRL-proximal over hashed word n-grams and skip-grams.

Per-coordinate learning rates and L1 sparsity leave a few thousand weights, which are broadcast whatever the size of the
corpus. The model is fitted on at most ``most`` labelled rows; every row of the corpus is scored.
"""

from __future__ import annotations

import functools
import math
import re
import zlib
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmur.llm.confusables import shown

#: Labelled rows that the fit reads at most: those with the least hash of their id.
MOST_LABELLED = 40_000
BITS = 20
#: Score from which a row counts as abusive.
THRESHOLD = 0.5

_SPELLED = re.compile(r"(?<![^\W_])(?:[^\W\d_]([-._ ]))(?:[^\W\d_]\1)+[^\W\d_](?![^\W_])")
_TOKEN = re.compile(r"[^\W_](?:[^\W_]|[*#@$!](?=[\w*#@$]))*")
_RUN = re.compile(r"([^\W\d_])\1{2,}")
# Digits and signs that stand for letters inside words.
LETTERS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "$": "s", "!": "i"})


@functools.lru_cache(maxsize=200_000)
def _plain(token: str) -> tuple[str, ...]:
    """What a lower-case token stands for."""
    if token.isalpha():
        return (_RUN.sub(r"\1", token),)
    if token.isdigit():
        return ("0",)
    if token.isalnum():
        return (_RUN.sub(r"\1", token.translate(LETTERS)) if token[0].isalpha() or any(c.isalpha() for c in token[1:-1]) else "0",)
    return (f"<{token[0]}{len(token)}{token[-1]}>", "<masked>")


def plain_tokens(text: str) -> list[str]:
    """Lower-case words with common disguises undone: look-alikes, spelled-out and stretched words, digits for letters.

    A word with signs in place of letters becomes its first letter, length and last letter in angle brackets.
    """
    text = _SPELLED.sub(lambda m: m[0].replace(m[1], ""), shown(text).lower())
    return [w for token in _TOKEN.findall(text) for w in _plain(token)]


class _Numbers(dict):
    """Two numbers of each word: of the word itself, and of its letters without their order, 0 for short words."""

    def __missing__(self, word: str) -> tuple[int, int]:
        if len(self) > 500_000:
            self.clear()
        self[word] = out = (zlib.crc32(word.encode()), zlib.crc32(b"~" + "".join(sorted(word)).encode()) if len(word) > 3 else 0)
        return out


_NUMBERS = _Numbers()
_FACTORS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _hashed(kind: int, *parts: np.ndarray, bits: int) -> np.ndarray:
    out = np.full(len(parts[0]), kind * 0x2545F4914F6CDD1D & 0xFFFFFFFFFFFFFFFF, np.uint64)
    for factor, part in zip(_FACTORS, parts, strict=False):
        out = (out ^ part.astype(np.uint64)) * factor
        out ^= out >> np.uint64(29)
    return (out * _FACTORS[3] >> np.uint64(64 - bits)).astype(np.int64)


def features(texts: Sequence[str | None], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(number of the text, hashed feature), each pair once, in order: 1- to 3-grams, skip-grams with one or two words
    between, and words without their letters' order. Null, empty and wordless texts have none."""
    flat, owner, letters = [], [], []
    for k, text in enumerate(texts):
        words = plain_tokens(text) if text else ()
        if words:
            numbers = [_NUMBERS[w] for w in ("^", *words, "$")]
            flat += [n for n, _ in numbers]
            letters += [m for _, m in numbers]
            owner.append((k, len(numbers)))
    t, m = np.array(flat, np.int64), np.array(letters, np.int64)
    o = np.repeat([k for k, _ in owner], [n for _, n in owner]).astype(np.int64)
    near = lambda n: o[:-n] == o[n:] if n < len(o) else np.zeros(max(0, len(o) - n), bool)
    one, two, three = near(1), near(2), near(3)
    a, b = t[:-1], t[1:]
    parts = [(o, _hashed(1, t, bits=bits)), (o[m > 0], _hashed(2, m[m > 0], bits=bits)), (o[:-1][one], _hashed(3, a[one], b[one], bits=bits))]
    if len(t) > 2:
        x, y, z = t[:-2][two], t[1:-1][two], t[2:][two]
        parts += [(o[:-2][two], _hashed(4, x, y, z, bits=bits)), (o[:-2][two], _hashed(5, x, z, bits=bits))]
    if len(t) > 3:
        parts.append((o[:-3][three], _hashed(6, t[:-3][three], t[3:][three], bits=bits)))
    both = np.unique(np.concatenate([(k << bits) | h for k, h in parts])) if len(t) else np.zeros(0, np.int64)
    return both >> bits, both & ((1 << bits) - 1)


class Ftrl:
    """FTRL-proximal with per-coordinate rates for logistic loss over sets of active features."""

    def __init__(self, bits: int = BITS, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.6, l2: float = 0.5):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        # the last place is the bias, which has no penalty
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)

    def _weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        rate = (self.beta + np.sqrt(self.n[at])) / self.alpha
        weights = -(z - np.copysign(self.l1, z)) / (rate + self.l2)
        weights[np.abs(z) <= self.l1] = 0.0
        if len(at) and at[-1] == len(self.z) - 1:
            weights[-1] = -z[-1] / rate[-1]
        return weights

    def update(self, active: np.ndarray, label: int, importance: float = 1.0) -> None:
        """active: distinct features, then the bias."""
        weights = self._weights(active)
        gradient = (_logistic(weights.sum()) - label) * importance
        before = self.n[active]
        after = before + gradient * gradient
        self.z[active] += gradient - (np.sqrt(after) - np.sqrt(before)) / self.alpha * weights
        self.n[active] = after

    def model(self) -> tuple[float, dict[int, float]]:
        used = np.flatnonzero(self.n)
        weights = dict(zip(used.tolist(), self._weights(used).tolist(), strict=True))
        bias = weights.pop(len(self.z) - 1, 0.0)
        return bias, {i: w for i, w in weights.items() if w}


def _logistic(x: float) -> float:
    return 1 / (1 + math.exp(-max(-35.0, min(35.0, x))))


def fit(rows: Iterable[tuple[str, int]], epochs: int = 6, positive: float = 4.0, seed: int = 7, bits: int = BITS, **rates: float) -> tuple[float, dict[int, float]]:
    """Bias and the weights that aren't 0. ``positive``: importance of a row labelled 1."""
    rows = list(rows)
    owner, feature = features([t for t, _ in rows], bits)
    bounds = np.searchsorted(owner, np.arange(len(rows) + 1))
    data = [(np.append(feature[a:b], 1 << bits), label) for a, b, (_, label) in zip(bounds, bounds[1:], rows, strict=False)]
    order, model = np.random.default_rng(seed), Ftrl(bits, **rates)
    for _ in range(epochs):
        for k in order.permutation(len(data)):
            active, label = data[k]
            model.update(active, label, positive if label else 1.0)
    return model.model()


def scores(texts: Sequence[str | None], bias: float, weights: np.ndarray) -> np.ndarray:
    """Probabilities of abuse; 0 for null texts and texts without words. ``weights`` has a place for every feature."""
    owner, feature = features(texts, int(len(weights) - 1).bit_length())
    held = np.bincount(owner, minlength=len(texts)) > 0
    total = bias + np.bincount(owner, weights[feature], len(texts))
    return np.where(held, 1 / (1 + np.exp(-np.clip(total, -35.0, 35.0))), 0.0)


def dense(weights: dict[int, float], bits: int = BITS) -> np.ndarray:
    out = np.zeros(1 << bits)
    out[list(weights)] = list(weights.values())
    return out


def fit_abuse(df: DataFrame, labels: DataFrame, id_col: str = "row_id", text_col: str = "text", label_col: str = "abusive", most: int = MOST_LABELLED):
    """The model of ``fit`` from rows joined with their labels; null labels and texts are left out.

    Of more than ``most`` labelled ids those with the least hash are taken and broadcast, so that the corpus is read but
    not shuffled. Without rows the bias makes every score low.
    """
    known = labels.where(F.col(label_col).isNotNull()).select(F.col(id_col), F.col(label_col).cast("int").alias("__label"))
    picked = known.orderBy(F.xxhash64(id_col), id_col).limit(most)
    rows = df.select(id_col, F.col(text_col).alias("__text")).where("__text is not null").join(F.broadcast(picked), id_col).select(id_col, "__text", "__label").toPandas()
    rows = rows.sort_values([id_col, "__text"]).drop(columns=id_col)
    return fit(rows.itertuples(index=False, name=None)) if len(rows) else (-5.0, {})


def abuse_score(text: Column, model: tuple[float, dict[int, float]]) -> Column:
    """The score of each text, in 0..1."""
    bias, weights = model

    @F.pandas_udf(T.DoubleType())
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = dense(weights)
        for texts in batches:
            out = np.zeros(len(texts))
            at = 0
            held = texts.tolist()
            while at < len(held):
                end, chars = at, 0
                while end < len(held) and (end == at or chars < 500_000):
                    chars += len(held[end] or "")
                    end += 1
                out[at:end] = scores(held[at:end], bias, table)
                at = end
            yield pd.Series(out)

    return scored(text)


def scored_rows(df: DataFrame, labels: DataFrame, id_col: str = "row_id", text_col: str = "text", threshold: float = THRESHOLD, keep: Sequence[str] = ()) -> DataFrame:
    """(id_col, *keep, score, abusive) of every row. Null, empty and wordless texts score 0; repeated rows stay repeated."""
    model = fit_abuse(df, labels, id_col, text_col)
    out = df.select(id_col, *keep, abuse_score(F.col(text_col).cast("string"), model).alias("score"))
    return out.withColumn("abusive", F.col("score") >= threshold)


def rates_by_source(scored: DataFrame, source: Sequence[str]) -> DataFrame:
    """(source, rows, abusive_rows, rate); null is a source of its own."""
    counts = scored.groupBy(*source).agg(F.count("*").alias("rows"), F.count_if("abusive").alias("abusive_rows"))
    return counts.withColumn("rate", F.col("abusive_rows") / F.col("rows"))
