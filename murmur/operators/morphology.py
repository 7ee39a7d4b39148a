"""Roots, affixes and word forms by ordered suffix rules over a lexicon.

Everything is computed on distinct words and joined back, as a corpus has far fewer of them than tokens. The lexicon
(``word``, ``pos`` with pos n, v, a or r) and the irregular forms (``form``, ``lemma``) are parameters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from murmur.storage import checkpointed

# Suffix, label, replacement, class that the base must have.
INFLECTIONS: tuple[tuple[str, str, str | None, str | None], ...] = (
    ("ies", "Plural", "y", None), ("sses", "Plural", None, None), ("es", "Plural", None, None), ("s", "Plural", None, None), ("ied", "Past tense", "y", None),
    ("ed", "Past tense", None, None), ("ing", "Present participle", None, None), ("est", "Superlative", None, "a"), ("er", "Comparative", None, "a"), ("ly", "Adverbial", None, None),
)
# Derivational suffixes and labels, tried in this order.
DERIVATIONS: tuple[tuple[str, str], ...] = (
    ("iness", "Quality"), ("ingly", "Adverbial"), ("ation", "Nominalization"), ("ment", "Nominalization"), ("ness", "Quality"), ("ance", "State"), ("ence", "State"), ("able", "Capability"), ("ible", "Capability"), ("less", "Quality"),
    ("ful", "Quality"), ("ity", "Quality"), ("ive", "Tendency"), ("ous", "Quality"), ("al", "Adjectival"), ("ing", "Present participle"), ("er", "Agent"), ("or", "Agent"), ("ly", "Manner"),
)
# Classes that a derivational suffix forces, and the order in which classes are tried by form and ending.
FORCED_POS = {"ful": "Adjective", "less": "Adjective", "able": "Adjective", "ible": "Adjective", "al": "Adjective", "ive": "Adjective", "ous": "Adjective", "ly": "Adverb"}
POS_NAMES = {"n": "Noun", "v": "Verb", "a": "Adjective", "r": "Adverb"}
FORM_ORDER = {"Plural": "navr", "Comparative": "anvr", "Superlative": "anvr", "Past tense": "vnar", "Present participle": "vnar", "Adverbial": "ranv"}
ENDING_ORDER = (("(ed|ing)$", "vnar"), ("(er|est)$", "anvr"), ("ly$", "ranv"), ("s$", "nvar"))
ANY_ORDER = "nvar"
# Endings after which a silent e is restored, and consonants that double.
SILENT_E = "(at|bl|iz|us|iv|ir)$"
DOUBLED = "bcdfghjklmnpqrstvwxz"


def _undouble(stem: Column) -> Column:
    twice = (F.length(stem) > 2) & (F.right(stem, F.lit(1)) == F.substring(stem, -2, 1)) & F.right(stem, F.lit(1)).rlike(f"[{DOUBLED}]")
    return F.when(twice, F.left(stem, F.length(stem) - 1)).otherwise(stem)


def _silent_e(stem: Column) -> Column:
    return F.when((F.length(stem) > 2) & stem.rlike(SILENT_E), F.concat(stem, F.lit("e"))).otherwise(stem)


def stem_candidates(base: Column, replacement: str | None = None) -> Column:
    """Plausible stems of a form without its suffix, the likeliest first: as it is, undoubled, with e, y for i, with a silent e."""
    if replacement:
        raw = F.array(F.concat(base, F.lit(replacement)))
    else:
        y = F.when(base.endswith("i"), F.concat(F.left(base, F.length(base) - 1), F.lit("y")))
        raw = F.array(base, _undouble(base), F.concat(base, F.lit("e")), y, _silent_e(base), _silent_e(_undouble(base)))
    return F.array_distinct(F.filter(raw, lambda c: c.isNotNull() & (F.length(c) >= 2)))


def _ending_order(word: Column) -> Column:
    out = F.lit(ANY_ORDER)
    for pattern, order in reversed(ENDING_ORDER):
        out = F.when(word.rlike(pattern), order).otherwise(out)
    return out


def _form_order(form: Column) -> Column:
    out = F.lit(ANY_ORDER)
    for name, order in FORM_ORDER.items():
        out = F.when(form == name, order).otherwise(out)
    return out


def _option(n: int, suffix: str, label: str, required: str | None):
    fixed = [F.lit(n).alias("rule"), F.lit(suffix).alias("suffix"), F.lit(label).alias("label"), F.lit(required).cast("string").alias("required")]
    return lambda candidate, place: F.struct(*fixed, place.alias("place"), candidate.alias("candidate"))


def inflection_options(words: DataFrame) -> DataFrame:
    """(word, rule, suffix, label, required, place, candidate): every stem that an inflection rule may give for a word."""
    rules = []
    for n, (suffix, label, replacement, required) in enumerate(INFLECTIONS):
        base = F.left("word", F.length("word") - len(suffix))
        fits = F.col("word").endswith(suffix) & (F.length("word") - len(suffix) >= 2)
        rows = F.transform(stem_candidates(base, replacement), _option(n, suffix, label, required))
        rules.append(F.when(fits, rows).otherwise(F.slice(rows, 1, 0)))
    return words.select("word", F.inline(F.concat(*rules)))


def peel(words: DataFrame, known: DataFrame) -> DataFrame:
    """(word, base, suffix, label): the first derivational suffix whose rest is a known word of two letters or more."""
    rules = [F.when(F.col("word").endswith(s) & (F.length("word") - len(s) >= 2), F.struct(F.lit(n).alias("ord"), F.left("word", F.length("word") - len(s)).alias("base"), F.lit(s).alias("suffix"), F.lit(label).alias("label"))) for n, (s, label) in enumerate(DERIVATIONS)]
    options = words.select("word", F.inline(F.array_compact(F.array(*rules))))
    fitting = options.join(F.broadcast(known.select(F.col("known").alias("base"))), "base", "left_semi")
    return fitting.groupBy("word").agg(F.min(F.struct("ord", "base", "suffix", "label")).alias("m")).select("word", "m.base", "m.suffix", "m.label")


def decompose(words: DataFrame, lexicon: DataFrame, irregular: DataFrame) -> DataFrame:
    """(word, root, lemma, pos, form, affixes, kinds, labels, decomposition) of distinct words.

    ``words`` has a column ``word``; null and non-alphabetic words are left out, repeated ones come once. Lexicon and
    irregular forms are broadcast and must be small, as word lists are.
    """
    words = words.select(F.lower("word").alias("word")).where(F.col("word").rlike(r"^\p{L}+$")).distinct()
    words = checkpointed(words)  # read several times below, and far smaller than the corpus it comes from
    known = lexicon.groupBy(F.col("word").alias("known")).agg(F.array_join(F.array_sort(F.collect_set("pos")), "").alias("classes"))
    options = checkpointed(inflection_options(words))
    derived = peel(options.select(F.col("candidate").alias("word")).distinct(), known).select(F.col("word").alias("candidate"), F.lit(True).alias("derivable"))
    judged = options.join(F.broadcast(known), F.col("candidate") == F.col("known"), "left").drop("known").join(derived, "candidate", "left")
    listed = judged.groupBy("word").agg(F.collect_list(F.struct("rule", "place", "candidate", "suffix", "label", "required", F.coalesce("classes", F.lit("")).alias("classes"), F.coalesce("derivable", F.lit(False)).alias("derivable"))).alias("options"))
    own = known.select(F.col("known").alias("word"), F.col("classes").alias("own"))
    rows = words.join(listed, "word", "left").join(F.broadcast(own), "word", "left").join(F.broadcast(irregular.groupBy(F.col("form").alias("word")).agg(F.min("lemma").alias("irregular"))), "word", "left")
    rows = rows.withColumns({"order": _ending_order(F.col("word")), "own": F.coalesce("own", F.lit(""))})

    def rank(o: Column) -> Column:
        """The place in the order of the first class that the candidate has and the word itself lacks; 9 for none."""
        places = F.transform(F.split(F.col("order"), ""), lambda c, i: F.when((c != "") & (F.instr(o["classes"], c) > 0) & (F.instr(F.col("own"), c) == 0), i))
        return F.coalesce(F.array_min(places), F.lit(9))

    lemma = F.array_min(F.transform(F.filter("options", lambda o: rank(o) < 9), lambda o: F.struct(rank(o).alias("rank"), o["rule"].alias("rule"), o["place"].alias("place"), o["candidate"].alias("candidate"))))["candidate"]
    rows = rows.withColumn("lemma", F.coalesce("irregular", lemma))
    accepted = F.filter("options", lambda o: F.when(F.col("lemma").isNotNull(), o["candidate"] == F.col("lemma")).when(o["required"].isNotNull(), F.instr(o["classes"], o["required"]) > 0).otherwise((o["classes"] != "") | o["derivable"]))
    rows = rows.withColumn("match", F.array_min(accepted)).select("word", "lemma", F.col("match.candidate").alias("stem"), F.col("match.suffix").alias("inflection"), F.col("match.label").alias("inflected"))
    rows = checkpointed(rows.withColumns({"bare": F.coalesce("stem", "lemma", "word"), "is_irregular": F.col("lemma").isNotNull() & F.col("stem").isNull()}))
    one = peel(rows.select(F.col("bare").alias("word")).distinct(), known).select(F.col("word").alias("bare"), F.col("base").alias("b1"), F.col("suffix").alias("s1"), F.col("label").alias("l1"))
    two = peel(one.select(F.col("b1").alias("word")).distinct(), known).select(F.col("word").alias("b1"), F.col("base").alias("b2"), F.col("suffix").alias("s2"), F.col("label").alias("l2"))
    rows = rows.join(one.join(two, "b1", "left"), "bare", "left")
    rows = rows.withColumns({c: F.when(~F.col("is_irregular"), F.col(c)) for c in ("b1", "s1", "l1", "b2", "s2", "l2")})
    form = F.when(F.col("is_irregular"), "Irregular").when(F.col("inflected").isNotNull(), F.col("inflected")).when(F.col("s1").isNotNull(), "Derived").otherwise("Base form")
    rows = rows.withColumns({"root": F.coalesce("b2", "b1", "bare"), "form": form})
    rows = rows.join(F.broadcast(known.select(F.col("known").alias("root"), F.col("classes").alias("root_classes"))), "root", "left")
    forced = F.coalesce(*(F.element_at(F.create_map(*(F.lit(x) for p in FORCED_POS.items() for x in p)), F.col(c)) for c in ("s1", "s2")))
    order = _form_order(F.col("form"))
    guess = F.coalesce(*(F.when(F.instr(F.coalesce("root_classes", F.lit("")), F.substring(order, i, 1)) > 0, F.substring(order, i, 1)) for i in range(1, 5)))
    named = F.create_map(*(F.lit(x) for p in POS_NAMES.items() for x in p))
    affixes = F.array_compact(F.array("s2", "s1", "inflection"))
    kinds = F.array_compact(F.array(*(F.when(F.col(c).isNotNull(), kind) for c, kind in (("s2", "Derivational"), ("s1", "Derivational"), ("inflection", "Inflectional")))))
    labels = F.array_compact(F.array("l2", "l1", "inflected"))
    return rows.select(
        "word", "root", F.col("bare").alias("lemma"), F.coalesce(forced, F.element_at(named, guess), F.lit("Noun")).alias("pos"), "form", affixes.alias("affixes"), kinds.alias("kinds"), labels.alias("labels"),
        F.when(F.col("is_irregular"), F.concat("root", F.lit(" → "), "word")).otherwise(F.array_join(F.concat(F.array("root"), affixes), " + ")).alias("decomposition"),
    )


def apply_affix(base: Column, suffix: str) -> Column:
    """The base with a suffix spelt on: plural, dropped e, y to i, doubled consonant of monosyllables before ed and ing."""
    hissing, consonant_y = base.rlike("(s|x|z|ch|sh)$"), base.endswith("y") & (F.length(base) > 2) & ~F.substring(base, -2, 1).rlike("[aeiou]")
    cut = F.left(base, F.length(base) - 1)
    plain = F.concat(base, F.lit(suffix))
    if suffix == "ies":
        return F.when(hissing, F.concat(base, F.lit("es"))).when(consonant_y, F.concat(cut, F.lit("ies"))).otherwise(F.concat(base, F.lit("s")))
    if suffix not in ("s", "es", "ed", "ing", "er", "est", "ly"):
        return plain
    out = F.when(base.endswith("e"), F.concat(cut, F.lit(suffix))) if suffix in ("ed", "ing", "er", "est") else F.when(F.lit(False), plain)
    out = out.when(consonant_y, F.concat(cut, F.lit("ies")) if suffix in ("s", "es") else plain if suffix == "ing" else F.concat(cut, F.lit("i" + suffix)))
    if suffix in ("s", "es"):
        out = out.when(hissing, F.concat(base, F.lit("es")))
    if suffix in ("ed", "ing"):
        single = F.greatest(F.regexp_count(base, F.lit("[aeiouy]+")), F.lit(1)) == 1
        doubles = single & base.rlike("[^aeiou][aeiou][^aeiouwxy]$")
        out = out.when(doubles, F.concat(base, F.right(base, F.lit(1)), F.lit(suffix)))
    return out.otherwise(plain)


# Forms by class.
TEMPLATES = {"Noun": (("Plural", "ies"),), "Verb": (("Third person singular", "s"), ("Past tense", "ed"), ("Present participle", "ing")), "Adjective": (("Comparative", "er"), ("Superlative", "est")), "Adverb": (("Adverbial", "ly"),)}


def word_forms(roots: DataFrame, attested: DataFrame) -> DataFrame:
    """(root, pos, place, form, label, rule, word_class) of distinct (root, pos).

    The class with most attested forms is taken, the preferred class first and every later one half a form behind; the
    base form carries the preferred class. ``attested`` has a column ``word`` and is broadcast.
    """
    templates = F.array(*(F.struct(F.lit(c).alias("word_class"), F.lit(n).alias("nth"), F.lit(k + 1).alias("place"), F.lit(label).alias("label"), F.lit("+" + suffix).alias("rule"), apply_affix(F.col("root"), suffix).alias("form")) for n, (c, rows) in enumerate(TEMPLATES.items()) for k, (label, suffix) in enumerate(rows)))
    made = roots.select("root", "pos").distinct().select("root", "pos", F.inline(templates)).where("form <> root")
    marked = made.join(F.broadcast(attested.select(F.col("word").alias("form")).distinct().withColumn("hit", F.lit(1))), "form", "left")
    nth = {c: n for n, c in enumerate(TEMPLATES)}
    preferred = F.element_at(F.create_map(*(F.lit(x) for p in nth.items() for x in p)), F.col("pos"))
    late = F.when(F.col("word_class") == F.col("pos"), 0).when(F.col("nth") < preferred, F.col("nth") + 1).otherwise(F.col("nth"))
    classes = marked.groupBy("root", "pos", "word_class", late.alias("late")).agg(F.sum(F.coalesce("hit", F.lit(0))).alias("hits"), F.collect_list(F.struct("place", "form", "label", "rule")).alias("forms"))
    best = classes.groupBy("root", "pos").agg(F.max(F.struct((F.col("hits") - 0.5 * F.col("late")).alias("score"), (-F.col("late")).alias("early"), "word_class", "forms")).alias("b"))
    base = F.array(F.struct(F.lit(0).alias("place"), F.col("root").alias("form"), F.lit("Base form").alias("label"), F.lit("").alias("rule")))
    rows = best.select("root", "pos", F.col("b.word_class").alias("chosen"), F.inline(F.concat(base, "b.forms")))
    return rows.select("root", "pos", F.col("place").cast("long").alias("place"), "form", "label", "rule", F.when(F.col("place") == 0, F.col("pos")).otherwise(F.col("chosen")).alias("word_class"))


def token_counts(df: DataFrame, tokens: Column, id_col: str) -> DataFrame:
    """(word, count, first): occurrences of each token, and its first place as (id, position)."""
    rows = df.select(id_col, F.posexplode(tokens).alias("at", "word"))
    return rows.groupBy("word").agg(F.count("*").alias("count"), F.min(F.struct(id_col, "at")).alias("first"))


def analysed(counts: DataFrame, lexicon: DataFrame, irregular: DataFrame) -> DataFrame:
    """The counts with the decomposition of each word, written once: one row for each distinct word, read several times."""
    counts = checkpointed(counts)
    return checkpointed(counts.join(decompose(counts.select("word"), lexicon, irregular), "word"))


def summary(rows: DataFrame) -> DataFrame:
    """One row: tokens, distinct forms and roots, inflected tokens, and by how many percent roots collapse the forms."""
    by_root = rows.groupBy("root").agg(F.sum("count").alias("n"), F.count("*").alias("forms"), F.sum(F.when(F.col("word") != F.col("root"), F.col("count")).otherwise(0)).alias("changed"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    out = by_root.agg(zero(F.sum("n")).alias("tokens_analyzed"), zero(F.sum("forms")).alias("distinct_forms"), F.count("*").alias("distinct_roots"), zero(F.sum("changed")).alias("inflected_tokens"))
    return out.withColumn("collapse_ratio", F.when(F.col("distinct_forms") > 0, F.round((1 - F.col("distinct_roots") / F.col("distinct_forms")) * 100, 1)).otherwise(0.0))


def top_roots(rows: DataFrame, k: int = 8) -> DataFrame:
    """(root, pos, forms, count): the k most frequent roots, first seen first on ties, with their modal class and sorted forms."""
    per_pos = rows.groupBy("root", "pos").agg(F.sum("count").alias("n"), F.min("first").alias("first"), F.collect_set("word").alias("forms"))
    roots = per_pos.groupBy("root").agg(F.sum("n").alias("count"), F.min("first").alias("first"), F.min(F.struct((-F.col("n")).alias("m"), "first", "pos"))["pos"].alias("pos"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("forms")))).alias("forms"))
    return roots.orderBy(F.desc("count"), "first").limit(k).select("root", "pos", F.array_join("forms", " ").alias("forms"), "count")


def affix_breakdown(rows: DataFrame, k: int = 6) -> DataFrame:
    """(affix, kind, label, count, share): the k most frequent affixes, share in percent of all tokens."""
    total = rows.agg(F.sum("count")).scalar()
    each = rows.select("count", F.explode(F.arrays_zip("affixes", "kinds", "labels")).alias("a"))
    counts = each.groupBy(F.concat(F.lit("+"), F.col("a.affixes")).alias("affix"), F.col("a.kinds").alias("kind"), F.col("a.labels").alias("label")).agg(F.sum("count").alias("count"))
    return counts.orderBy(F.desc("count"), "affix", "kind", "label").limit(k).withColumn("share", F.round(F.col("count") * 100 / total, 1))


def pos_breakdown(rows: DataFrame) -> DataFrame:
    """(pos, count, share) over all tokens."""
    counts = rows.groupBy("pos").agg(F.sum("count").alias("count"))
    return counts.withColumn("share", F.round(F.col("count") * 100 / F.sum("count").over(W.partitionBy()), 1))


def top_forms(rows: DataFrame, k: int = 8) -> DataFrame:
    """The k most frequent surface forms with their analysis."""
    total = rows.agg(F.sum("count")).scalar()
    top = rows.orderBy(F.desc("count"), "first").limit(k)
    return top.select("word", "root", "pos", "form", F.array_join("affixes", " ").alias("affixes"), "decomposition", "count", F.round(F.col("count") * 100 / total, 1).alias("share"))


def normalised(rows: DataFrame, dimension: DataFrame, column: str, id_col: str = "row_id") -> DataFrame:
    """(id_col, column): the tokens of ``rows`` (id_col, at, word) with each word replaced by the dimension's column, joined."""
    joined = rows.join(dimension.select("word", column), "word").groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("at", column))).alias("rs"))
    return joined.select(id_col, F.array_join(F.transform("rs", lambda r: r[column]), " ").alias(column))


def forms_of(word: str, lexicon: DataFrame, irregular: DataFrame) -> DataFrame:
    """The forms of one word's root, as from ``word_forms``, with the word's own analysis (``word``, ``decomposition``) beside them.

    The word must be letters only, at most 40 of them; else ValueError. One that neither is in the lexicon nor leads to a
    root in it gives LookupError.
    """
    if not word.isalpha() or len(word) > 40:
        raise ValueError("a word has 1 to 40 letters and nothing else")
    found = checkpointed(decompose(lexicon.sparkSession.createDataFrame([(word,)], "word string"), lexicon, irregular))
    if not found.join(lexicon.select(F.col("word").alias("root")).distinct(), "root", "left_semi").take(1):
        raise LookupError(f"no analysis of {word!r}")
    forms = word_forms(found.select("root", "pos"), lexicon.select("word"))
    return forms.join(F.broadcast(found.select("root", "word", "decomposition")), "root").orderBy("place")
