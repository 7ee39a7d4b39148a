"""Text normalisation as column expressions; nothing here leaves the JVM.

Character classes are written out, because ``\\s`` and ``\\b`` differ between regular-expression engines.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of Unicode.
BLANK = r"\t-\r\x1c-\x20\x{85}\p{Z}"
URL = rf"https?://[^{BLANK}]+|www\.[^{BLANK}]+"
# The ranges that count as emoji. The last one also covers CJK, kana and Hangul.
EMOJI = r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}\x{2702}-\x{27B0}\x{24C2}-\x{1F251}]+"
#: The same without East Asian scripts.
EMOJI_NARROW = r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}\x{2702}-\x{27B0}\x{24C2}\x{2600}-\x{26FF}]+"
PUNCTUATION = r"[!-/:-@\[-`{-~]"
SENTENCE_END = r"[.!?…]+|\n+"
#: Words that a tokenizer of the Penn Treebank takes apart.
CONTRACTED = r"\b(?:(can)(not)|(gon|wan)(na)|(got)(ta)|(gim|lem)(me))\b"


def clean_text(text: Column, emoji: str = EMOJI) -> Column:
    """Lower case; URLs, emoji and ASCII punctuation deleted without a space; white space collapsed and trimmed. Null stays null."""
    out = F.regexp_replace(F.lower(text), URL, "")
    out = F.regexp_replace(F.regexp_replace(out, emoji, ""), PUNCTUATION, "")
    return F.trim(F.regexp_replace(out, f"[{BLANK}]+", " "))


def all_tokens(clean: Column) -> Column:
    """Alphabetic tokens of clean text, stop words kept."""
    parted = F.regexp_replace(clean, CONTRACTED, "$1$3$5$7 $2$4$6$8")
    return F.filter(F.split(parted, " "), lambda t: t.rlike(r"^\p{L}+$"))


def content_tokens(clean: Column, stop: Sequence[str]) -> Column:
    """Alphabetic tokens of more than two letters that are no stop words."""
    keep = lambda t: (F.length(t) > 2) & ~t.isin(list(stop)) if stop else F.length(t) > 2
    return F.filter(all_tokens(clean), keep)


def tokenize_full(text: Column) -> Column:
    return all_tokens(clean_text(text))


def tokenize_surface(text: Column, stop: Sequence[str]) -> Column:
    return content_tokens(clean_text(text), stop)


def sentence_tokens(text: Column, stop: Sequence[str]) -> Column:
    """array<array<string>>: the content tokens of each sentence of the raw text; sentences without any are left out."""
    parts = F.split(text, SENTENCE_END)
    return F.filter(F.transform(parts, lambda p: tokenize_surface(p, stop)), lambda s: F.size(s) > 0)


def tokenize_named(text: Column) -> Column:
    """Tokens with their letter case: URLs, emoji and all but ASCII letters and apostrophes become blanks; alphabetic tokens are kept."""
    out = F.regexp_replace(F.regexp_replace(text, URL, " "), EMOJI, " ")
    out = F.regexp_replace(out, rf"[^A-Za-z'{BLANK}]", " ")
    return F.filter(F.split(F.trim(F.regexp_replace(out, f"[{BLANK}]+", " ")), " "), lambda t: t.rlike("^[A-Za-z]+$"))


def ngrams(sentences: Column, n: int) -> Column:
    """array<string>: all runs of n tokens inside a sentence, joined by blanks."""
    empty = F.array().cast("array<string>")

    def of(s: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(1), F.size(s) - (n - 1)), lambda i: F.array_join(F.slice(s, i, n), " "))
        return F.when(F.size(s) >= n, windows).otherwise(empty)

    return F.flatten(F.transform(sentences, of))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once for each row."""
    return F.transform(F.array(value), body)[0]


def duplicate_key(text: Column) -> Column:
    """Lower case with white space collapsed; null for blank text."""
    key = F.trim(F.regexp_replace(F.lower(text), f"[{BLANK}]+", " "))
    return F.when(key != "", key)


def term_counts(terms: Column) -> Column:
    """array<struct<term, tf>>: each distinct value of an array and how often it stands there, by sorting inside the row."""

    def of_sorted(s: Column) -> Column:
        last = F.size(s) - 1
        starts = F.when(last >= 0, F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1))))
        return let(
            starts,
            lambda at: F.transform(at, lambda v, k: F.struct(F.get(s, v).alias("term"), (F.coalesce(F.get(at, k + 1), F.size(s)) - v).cast("long").alias("tf"))),
        )

    return let(F.array_sort(terms), of_sorted)
