"""Part-of-speech tagging by rules, by context, and by both; a registry of taggers; their comparison.

A tagger is a function from an array of tokens to an array of tags. The rules run over a whole row at a time: its tokens are
joined into one string, and each rule replaces, in one pass, the tokens that it fires for by a letter for their tag. The
contextual tagger stands where a statistical one would: it patches the rules' tags by the tag before, after Brill (1992).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from murmur.functions.text import let, term_counts, tokenize_full
from murmur.lexicons import COARSE, FUNCTION_TAGS, TAG_PATTERNS

# Brill patches of ours: tag, tag before, new tag.
PATCHES = (("NN", "TO", "VB"), ("NN", "MD", "VB"), ("NN", "PRP", "VBP"), ("NNS", "PRP", "VBZ"), ("VBN", "DT", "JJ"), ("VBG", "DT", "NN"), ("VBG", "IN", "NN"), ("JJR", "DT", "NN"), ("VBN", "PRP", "VBD"))


def _by_tag() -> dict[str, list[str]]:
    groups: dict[str, list[str]] = {}
    for word, tag in FUNCTION_TAGS.items():
        groups.setdefault(tag, []).append(word)
    return groups


def rule_or_none(token: Column) -> Column:
    """The tag of the first rule that fires: closed class, title case, then patterns; null if none does."""
    lower = F.lower(token)
    out = None
    for tag, words in _by_tag().items():
        out = F.when(lower.isin(words), tag) if out is None else out.when(lower.isin(words), tag)
    out = out.when(token.rlike(r"^\p{Lu}\p{Ll}+$"), "NNP")
    for pattern, tag in TAG_PATTERNS:
        out = out.when(token.rlike(pattern), tag)
    return out


#: All tags that rules and patches give, the last one for tokens that no rule fires for, and a letter for each.
TAGS = (*dict.fromkeys([*FUNCTION_TAGS.values(), "NNP", *(t for _, t in TAG_PATTERNS), *(new for *_, new in PATCHES), "NN"]), None)
LETTER = {tag: chr(ord("A") + k) for k, tag in enumerate(TAGS)}
_OPEN, _DONE = "\\x01", "\\x02"
_REST = f"[^{_OPEN}{_DONE}]*"


def rule_letters(tokens: Column) -> Column:
    """One letter for each token, that of its rule's tag or of none; null tokens give null."""
    out = F.concat(F.lit("\x01"), F.array_join(tokens, "\x01"))

    def rule(body: str, tag: str | None) -> None:
        nonlocal out
        out = F.regexp_replace(out, f"{_OPEN}{body}(?=[{_OPEN}{_DONE}]|$)", "\x02" + LETTER[tag])

    for tag, words in _by_tag().items():
        rule(f"(?i:{'|'.join(words)})", tag)
    rule(r"\p{Lu}\p{Ll}+", "NNP")
    for pattern, tag in TAG_PATTERNS:
        rule(pattern[1:-1] if pattern.startswith("^") else _REST + "(?:" + pattern[:-1] + ")", tag)
    rule(_REST, None)
    return F.when(F.size(tokens) > 0, F.replace(out, F.lit("\x02"), F.lit(""))).otherwise(F.when(tokens.isNotNull(), ""))


def tag_letters(tokens: Column) -> Column:
    """The rule tagger's letters: nouns where no rule fires."""
    return F.translate(rule_letters(tokens), LETTER[None], LETTER["NN"])


def _patched_letter(tag: Column, before: Column) -> Column:
    out = None
    for old, previous, new in PATCHES:
        hit = (tag == LETTER[old]) & (before == LETTER[previous])
        out = F.when(hit, LETTER[new]) if out is None else out.when(hit, LETTER[new])
    return out.otherwise(tag)


def tag_of(letter: Column) -> Column:
    return F.get(F.array(*map(F.lit, TAGS)), F.ascii(letter) - ord("A"))


def _apart(letters: Column) -> Column:
    return F.filter(F.split(letters, ""), lambda c: c != "")


def _patched(letters: Column) -> Column:
    return let(_apart(letters), lambda cs: F.transform(cs, lambda c, i: _patched_letter(c, F.get(cs, i - 1))))


def tag_rules(tokens: Column) -> Column:
    return F.transform(_apart(tag_letters(tokens)), tag_of)


def tag_contextual(tokens: Column) -> Column:
    return F.transform(_patched(tag_letters(tokens)), tag_of)


def tag_hybrid(tokens: Column) -> Column:
    """The rule's tag where one fires, else the contextual tag."""
    either = lambda rule, other: tag_of(F.when(rule == LETTER[None], other).otherwise(rule))
    return let(rule_letters(tokens), lambda ls: F.zip_with(_apart(ls), _patched(F.translate(ls, LETTER[None], LETTER["NN"])), either))


TAGGERS: dict[str, Callable[[Column], Column]] = {"contextual": tag_contextual, "rules": tag_rules, "hybrid": tag_hybrid}
BASELINE = "contextual"


def tag_with(name: str, tokens: Column) -> Column:
    if name not in TAGGERS:
        raise ValueError(f"no tagger named {name!r}; there are {sorted(TAGGERS)}")
    return TAGGERS[name](tokens)


def tag_text(text: Column, name: str = "hybrid") -> Column:
    """array<struct<token, tag>> of a text's words; texts without words give an empty array."""
    return let(tokenize_full(text), lambda ts: F.arrays_zip(ts.alias("token"), tag_with(name, ts).alias("tag")))


def coarse(tag: Column) -> Column:
    """The group of a tag; ``Other`` for tags without one."""
    groups: dict[str, list[str]] = {}
    for t, group in COARSE.items():
        groups.setdefault(group, []).append(t)
    out = None
    for group, tags in groups.items():
        out = F.when(tag.isin(tags), group) if out is None else out.when(tag.isin(tags), group)
    return out.otherwise("Other")


def distribution(tag_counts: DataFrame) -> DataFrame:
    """(group, count, share) from counts by tag or word: columns ``tag``, ``count``; share in percent of all tokens."""
    groups = tag_counts.groupBy(coarse(F.col("tag")).alias("group")).agg(F.sum("count").alias("count"))
    return groups.withColumn("share", F.round(F.col("count") * 100 / F.sum("count").over(W.partitionBy()), 1))


def word_tags(counts: DataFrame) -> DataFrame:
    """Counts by word with the rule tag: rules look at one word alone, so each distinct word is tagged once."""
    return counts.withColumn("tag", F.coalesce(rule_or_none(F.col("word")), F.lit("NN")))


def key_words(counts: DataFrame, k: int = 6) -> DataFrame:
    """(group, rank, word, count): the k most frequent nouns, verbs and adjectives, the alphabetically first on ties."""
    grouped = word_tags(counts).select(coarse(F.col("tag")).alias("group"), "word", "count").where(F.col("group").isin("Noun", "Verb", "Adjective"))
    rank = F.row_number().over(W.partitionBy("group").orderBy(F.desc("count"), "word"))
    return grouped.withColumn("rank", rank).where(F.col("rank") <= k).select("group", F.col("rank").cast("long").alias("rank"), "word", "count")


def compared(df: DataFrame, tokens: Column) -> DataFrame:
    """(tagger, tag, baseline, count): counts of every pair of a tagger's tag and the baseline's for the same token.

    A token's tag by every tagger follows from its rule's tag and the one before, so these pairs are counted, inside the
    row first, and the taggers run over the few hundred of them that there are.
    """
    places = lambda s: F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.when(i == 1, F.concat(F.lit("."), F.substring(s, i, F.lit(1)))).otherwise(F.substring(s, i - 1, F.lit(2))))
    held = let(rule_letters(tokens), lambda s: F.when(F.length(s) > 0, places(s)))
    pairs = df.select(F.inline(term_counts(held))).groupBy("term").agg(F.sum("tf").alias("count"))
    noun = lambda c: F.when(c == LETTER[None], LETTER["NN"]).otherwise(c)
    rule = F.right("term", F.lit(1))
    patched = _patched_letter(noun(rule), noun(F.left("term", F.lit(1))))
    by_name = {"contextual": patched, "rules": noun(rule), "hybrid": F.when(rule == LETTER[None], patched).otherwise(rule)}
    each = pairs.select("count", F.inline(F.array(*(F.struct(F.lit(n).alias("tagger"), tag_of(by_name[n]).alias("tag"), tag_of(by_name[BASELINE]).alias("baseline")) for n in TAGGERS))))
    return each.groupBy("tagger", "tag", "baseline").agg(F.sum("count").alias("count"))


def disagreements(df: DataFrame, tokens_col: str, id_col: str = "row_id", k: int = 4) -> DataFrame:
    """(tagger, place, token, tag, baseline, context): the first k tokens, but for a row's last, that a tagger and the
    baseline tag differently, with up to two words on either side."""
    t = F.col(tokens_col)
    rows = df.select(id_col, tokens_col, *(tag_with(n, t).alias(f"__{n}") for n in TAGGERS)).where(F.size(tokens_col) > 1)
    out = None
    for name in TAGGERS:
        if name == BASELINE:
            continue
        pairs = F.transform(F.slice(F.arrays_zip(t.alias("token"), F.col(f"__{name}").alias("tag"), F.col(f"__{BASELINE}").alias("baseline")), F.lit(1), F.size(t) - 1), lambda x, i: F.struct(i.alias("at"), x["token"].alias("token"), x["tag"].alias("tag"), x["baseline"].alias("baseline"), F.array_join(F.slice(t, F.greatest(i - 1, F.lit(1)), F.least(i, F.lit(2)) + 3), " ").alias("context")))
        # a row gives k at most, so that the sort stays small
        found = rows.select(id_col, F.lit(name).alias("tagger"), F.inline(F.slice(F.filter(pairs, lambda x: x["tag"] != x["baseline"]), 1, k))).orderBy(id_col, "at").limit(k)
        out = found if out is None else out.unionByName(found)
    place = F.row_number().over(W.partitionBy("tagger").orderBy(id_col, "at"))
    return out.select("tagger", place.cast("long").alias("place"), "token", "tag", "baseline", "context")


def agreement(pairs: DataFrame) -> DataFrame:
    """(tagger, tokens, agreement): percent of tokens with the baseline's tag."""
    same = F.sum(F.when(F.col("tag") == F.col("baseline"), F.col("count")).otherwise(0))
    return pairs.groupBy("tagger").agg(F.sum("count").alias("tokens"), F.round(same * 100 / F.sum("count"), 1).alias("agreement"))


def confusion(pairs: DataFrame, k: int = 6) -> DataFrame:
    """(shift, count): the k most frequent changes of group from the baseline's to a tagger's, over all taggers."""
    shifts = pairs.select(coarse(F.col("baseline")).alias("a"), coarse(F.col("tag")).alias("b"), "count").where("a <> b")
    return shifts.groupBy(F.concat("a", F.lit(" -> "), "b").alias("shift")).agg(F.sum("count").alias("count")).orderBy(F.desc("count"), "shift").limit(k)
