"""Named entities: a gazetteer scan, runs of capitalised words, and ordered rules for their types.

A row's tokens stay one array; scans are folds over it, so nothing is shuffled before the reports aggregate. Whether a word
has an everyday sense is looked up in a broadcast table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from murmur.functions.text import let
from murmur.lexicons import HONORIFICS, LOCATION_CUES, MIXED_CASE_BRANDS, NAME_STOPS, ORG_SUFFIXES, PERSON_CUES, SPEECH_VERBS

#: Longest run of capitalised words that is one name.
LONGEST_RUN = 3
_FOUND = "array<struct<start:int,size:int,phrase:string>>"


def gazetteer_hits(tokens: Column, gazetteer: dict[str, str]) -> Column:
    """array<struct<start, size, phrase>>: leftmost longest phrases; a single word must be capitalised, or be a brand written
    with capitals inside, and may have a plural s."""
    by_size: dict[int, list[str]] = {}
    for phrase in gazetteer:
        by_size.setdefault(len(phrase.split()), []).append(phrase)
    singles = by_size.pop(1, [])
    sizes = sorted(by_size, reverse=True)
    begins = sorted({p.split()[0] for ps in by_size.values() for p in ps})

    def single(token: Column) -> Column:
        word = F.lower(token)
        bare = F.when(word.isin(singles), word).when(word.endswith("s") & F.left(word, F.length(word) - 1).isin(singles), F.left(word, F.length(word) - 1))
        return F.when(token.rlike("^[A-Z]") | token.isin(*MIXED_CASE_BRANDS), bare)

    def step(a: Column, i: Column) -> Column:
        def found(size: int, phrase: Column) -> Column:
            return F.struct((i + size).alias("next"), F.array_append(a["found"], F.struct(i.alias("start"), F.lit(size).alias("size"), phrase.alias("phrase"))).alias("found"))

        out = F.when(i < a["next"], a)
        for size in sizes:
            phrase = F.lower(F.array_join(F.slice(tokens, i + 1, size), " "))
            out = out.when((i + size <= F.size(tokens)) & phrase.isin(by_size[size]), found(size, phrase))
        bare = single(F.get(tokens, i))
        return out.when(bare.isNotNull(), found(1, bare)).otherwise(a)

    # the fold runs over the places where an entry may begin, which most rows have none of
    may = F.filter(F.transform(tokens, lambda t, i: F.when(F.lower(t).isin(begins) | single(t).isNotNull(), i)), lambda i: i.isNotNull())
    return F.aggregate(may, F.struct(F.lit(0).alias("next"), F.array().cast(_FOUND).alias("found")), step, lambda a: a["found"])


def capitalized_runs(tokens: Column, hits: Column, stops: Sequence[str] = NAME_STOPS) -> Column:
    """array<struct<start, size>>: maximal runs of capitalised words outside hits that are no stop words, cut at three."""
    fine = F.transform(tokens, lambda t, i: t.rlike("^[A-Z]") & ~F.lower(t).isin(list(stops)) & ~F.exists(hits, lambda h: (i >= h["start"]) & (i < h["start"] + h["size"])))

    def of(flags: Column) -> Column:
        starts = F.filter(F.transform(flags, lambda f, i: F.when(f & ~F.coalesce(F.get(flags, i - 1), F.lit(False)), i)), lambda i: i.isNotNull())
        more = lambda i, n: F.coalesce(F.get(flags, i + n), F.lit(False))
        size = lambda i: F.when(~more(i, 1), 1).when(~more(i, 2), 2).otherwise(LONGEST_RUN)
        return F.transform(starts, lambda i: F.struct(i.alias("start"), size(i).alias("size")))

    return let(fine, of)


def entities(df: DataFrame, tokens_col: str, gazetteer: dict[str, str], given: Sequence[str], everyday: DataFrame, keep: Sequence[str] = ("row_id",)) -> DataFrame:
    """(*keep, start, text, type, confidence, source) of every entity: gazetteer hits, and runs that get a type.

    Runs are typed by the first rule that holds: honorific; given name and another word; a word of an organisation in it; a
    verb of speech after it; a gazetteer word in it. Runs of which every word is in ``everyday`` (column ``word``, small
    enough to be broadcast) are no names; then the word before the run decides, and else it is a weak person.
    """
    kinds = F.create_map(*(F.lit(x) for pair in gazetteer.items() for x in pair))
    singles = [p for p in gazetteer if " " not in p]

    def places(tokens: Column) -> Column:
        run = lambda r: F.struct(r["start"].alias("start"), r["size"].alias("size"), F.lit(None).cast("string").alias("phrase"))
        return let(gazetteer_hits(tokens, gazetteer), lambda hits: F.concat(hits.cast(_FOUND), F.transform(capitalized_runs(tokens, hits), run).cast(_FOUND)))

    t = F.col("__tokens")
    rows = df.select(*keep, F.col(tokens_col).alias("__tokens"), F.explode(places(F.col(tokens_col))).alias("__p")).select(*keep, "__tokens", "__p.*")
    words = F.slice(t, F.col("start") + 1, F.col("size"))
    rows = rows.select(*keep, "start", "size", "phrase", words.alias("__words"), F.transform(words, F.lower).alias("__low"), F.lower(F.get(t, F.col("start") - 1)).alias("__before"), F.lower(F.get(t, F.col("start") + F.col("size"))).alias("__after"))
    known = everyday.select("word").distinct()
    for k in range(LONGEST_RUN):
        side = F.broadcast(known.select(F.col("word").alias(f"__known{k}")))
        rows = rows.join(side, F.when(F.col("phrase").isNull(), F.get("__low", F.lit(k))) == F.col(f"__known{k}"), "left")
    ordinary = F.lit(True)
    for k in range(LONGEST_RUN):
        ordinary = ordinary & ((F.col("size") <= k) | F.col(f"__known{k}").isNotNull())
    low = F.col("__low")
    first, many = low[0], F.col("size") > 1
    listed = F.filter(low, lambda w: w.isin(singles))
    titled = first.isin(*HONORIFICS) & many
    named = ~titled & first.isin(list(given)) & many & ~F.get(low, F.lit(1)).isin(list(given))
    rules = [
        (F.col("phrase").isNotNull(), kinds[F.col("phrase")], F.when(many, 0.98).otherwise(0.90), "gazetteer"), (titled, F.lit("Person"), F.lit(0.85), "honorific"), (named, F.lit("Person"), F.lit(0.80), "name-pattern"),
        (F.exists(low, lambda w: w.isin(*ORG_SUFFIXES)), F.lit("Organization"), F.lit(0.60), "context"), (F.col("__after").isin(*SPEECH_VERBS), F.lit("Person"), F.lit(0.65), "context"), (F.size(listed) > 0, kinds[F.try_element_at(listed, F.lit(1))], F.lit(0.50), "context"),
        (ordinary, None, None, None), (F.col("__before").isin(*PERSON_CUES), F.lit("Person"), F.lit(0.75), "context"), (F.col("__before").isin(*LOCATION_CUES), F.lit("Location"), F.lit(0.50), "context"), (F.lit(True), F.lit("Person"), F.lit(0.40), "context"),
    ]
    verdict = None
    for holds, kind, confidence, source in rules:
        value = F.lit(None).cast("struct<type:string,confidence:double,source:string>") if kind is None else F.struct(kind.alias("type"), confidence.alias("confidence"), F.lit(source).alias("source"))
        verdict = F.when(holds, value) if verdict is None else verdict.when(holds, value)
    text = F.array_join(F.when(F.col("phrase").isNull() & named, F.slice("__words", 1, 2)).otherwise(F.col("__words")), " ")
    return rows.select(*keep, "start", text.alias("text"), verdict.alias("__v")).where("__v is not null").select(*keep, "start", "text", "__v.type", "__v.confidence", "__v.source")


def entity_types(found: DataFrame) -> DataFrame:
    """(type, count, share) of rows with a column ``type``; the total is taken over the few counted rows."""
    counts = found.groupBy("type").agg(F.count("*").alias("count"))
    return counts.withColumn("share", F.round(F.col("count") * 100 / F.sum("count").over(W.partitionBy()), 1))


def entity_examples(found: DataFrame, order_col: str = "row_id", k: int = 4) -> DataFrame:
    """(type, place, text, source, confidence): the first k entities of each type; a group limit keeps k rows per task."""
    place = F.row_number().over(W.partitionBy("type").orderBy(order_col, "start"))
    return found.withColumn("place", place).where(F.col("place") <= k).select("type", F.col("place").cast("long").alias("place"), "text", "source", "confidence")


def top_entities(found: DataFrame, k: int = 8) -> DataFrame:
    """(text, type, count, share): the k most frequent, the first by text and type on ties; share of the greatest count."""
    top = found.groupBy("text", "type").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "text", "type").limit(k)
    return top.withColumn("share", F.bround(F.col("count") * 100 / F.max("count").over(W.partitionBy())).cast("long"))
