"""Queries for named entities, with our own gazetteer on both sides."""

from __future__ import annotations

from pyspark.sql import functions as F

from murmur import lexicons
from murmur.functions import text as tx
from murmur.operators import entities as e
from murmur.plans import sqltext as q
from murmur.plans.basics import table

GAZETTEER = dict(lexicons.GAZETTEER)
KNOWN = lexicons.everyday_words()


def _rows(spark, folder):
    return table(spark, folder, "comments").where("text is not null").select("row_id", tx.tokenize_named(F.col("text")).alias("tokens"))


def _found(spark, folder):
    given = lexicons.words(table(spark, folder, "given_name"))
    everyday = spark.createDataFrame([(w,) for w in KNOWN], "word string")
    return e.entities(_rows(spark, folder), "tokens", GAZETTEER, given, everyday)


def gazetteer_hits(spark, folder):
    rows = _rows(spark, folder).select("row_id", F.inline(e.gazetteer_hits(F.col("tokens"), GAZETTEER)))
    return rows.select("row_id", F.col("start").cast("long").alias("start"), F.col("size").cast("long").alias("size"), "phrase")


def capitalized_runs(spark, folder):
    rows = _rows(spark, folder).select("row_id", "tokens", F.inline(e.capitalized_runs(F.col("tokens"), e.gazetteer_hits(F.col("tokens"), GAZETTEER))))
    return rows.select("row_id", F.col("start").cast("long").alias("start"), F.array_join(F.slice("tokens", F.col("start") + 1, F.col("size")), " ").alias("run"))


def entities(spark, folder):
    return _found(spark, folder).withColumn("start", F.col("start").cast("long"))


def entity_types(spark, folder):
    return e.entity_types(_found(spark, folder))


def entity_sources(spark, folder):
    return _found(spark, folder).groupBy("source").agg(F.count("*").alias("count"))


def entity_examples(spark, folder):
    return e.entity_examples(_found(spark, folder))


def top_entities(spark, folder):
    return e.top_entities(_found(spark, folder))


QUERIES = {f.__name__: f for f in (gazetteer_hits, capitalized_runs, entities, entity_types, entity_sources, entity_examples, top_entities)}


def _in(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _gram(n: int) -> str:
    return "lower(tok)" + "".join(f" || ' ' || lead(lower(tok), {k}) over w" for k in range(1, n)) + f" as g{n}"


SIZES = sorted({len(p.split()) for p in GAZETTEER} - {1})
_BASE = f"""{q.values([(p, k, len(p.split())) for p, k in GAZETTEER.items()], 'phrase, kind, n', 'gaz')},
named as (select row_id, {q.named('text')} as tokens from comments where text is not null),
tk as (select row_id, unnest(tokens) as tok, generate_subscripts(tokens, 1) - 1 as pos from named),
t as (select *, lower(tok) as l, lag(lower(tok)) over w as before, {", ".join(map(_gram, SIZES))} from tk window w as (partition by row_id order by pos)),
may as ({" union all ".join(f"select row_id, pos, phrase, n from t join gaz on g{n} = phrase and n = {n}" for n in SIZES)}),
longest as (select row_id, pos, max_by(phrase, n) as phrase, max(n) as n from may group by row_id, pos),
-- of overlapping phrases the leftmost counts; longer chains of overlaps don't occur with these phrases
multi as (select a.* from longest a where not exists (select 1 from longest b where b.row_id = a.row_id and b.pos < a.pos and b.pos + b.n > a.pos)),
covered as (select row_id, unnest(range(pos, pos + n)) as pos from multi),
single as (
    select row_id, pos, coalesce(g1.phrase, g2.phrase) as phrase, 1 as n from t left join gaz g1 on g1.n = 1 and g1.phrase = l left join gaz g2 on g2.n = 1 and ends_with(l, 's') and g2.phrase = left(l, length(l) - 1)
    where (regexp_matches(tok, '^[A-Z]') or tok in {_in(lexicons.MIXED_CASE_BRANDS)}) and coalesce(g1.phrase, g2.phrase) is not null and not exists (select 1 from covered c where c.row_id = t.row_id and c.pos = t.pos)),
hits as (select * from multi union all select * from single),
taken as (select row_id, pos from covered union all select row_id, pos from single),
caps as (
    select t.*, t.pos - row_number() over (partition by t.row_id order by t.pos) as island from t
    where regexp_matches(tok, '^[A-Z]') and l not in {_in(lexicons.NAME_STOPS)} and not exists (select 1 from taken x where x.row_id = t.row_id and x.pos = t.pos)),
placed as (select *, row_number() over (partition by row_id, island order by pos) as k from caps),
runs as (
    select row_id, min(pos) as start, count(*) as size, string_agg(tok, ' ' order by pos) as run, list(tok order by pos) as ws, list(l order by pos) as ls, list(before order by pos)[1] as before
    from placed where k <= 3 group by row_id, island)"""
_FOUND = f"""{_BASE},
everyday as (select unnest(string_split('{" ".join(KNOWN)}', ' ')) as word),
strange as (select distinct row_id, start from (select row_id, start, unnest(ls) as w from runs) where w not in (select word from everyday)),
typed as (
    select r.row_id, r.start, ws, ls, before, size, lower(n.tok) as after, s.start is null as ordinary,
        list_filter(ls, lambda w: w in {_in([p for p in GAZETTEER if ' ' not in p])}) as listed, (select list(word) from given_name) as given
    from runs r left join tk n on n.row_id = r.row_id and n.pos = r.start + size left join strange s on s.row_id = r.row_id and s.start = r.start),
judged as (
    select row_id, start, case
        when ls[1] in {_in(lexicons.HONORIFICS)} and size > 1 then ['Person', '0.85', 'honorific']
        when list_contains(given, ls[1]) and size > 1 and not list_contains(given, ls[2]) then ['Person', '0.80', 'name-pattern']
        when len(list_filter(ls, lambda w: w in {_in(lexicons.ORG_SUFFIXES)})) > 0 then ['Organization', '0.60', 'context']
        when after in {_in(lexicons.SPEECH_VERBS)} then ['Person', '0.65', 'context']
        when len(listed) > 0 then [(select kind from gaz where phrase = listed[1]), '0.50', 'context']
        when ordinary then null
        when before in {_in(lexicons.PERSON_CUES)} then ['Person', '0.75', 'context']
        when before in {_in(lexicons.LOCATION_CUES)} then ['Location', '0.50', 'context']
        else ['Person', '0.40', 'context'] end as v,
        array_to_string(case when list_contains(given, ls[1]) and size > 1 and not list_contains(given, ls[2]) and ls[1] not in {_in(lexicons.HONORIFICS)} then ws[1:2] else ws end, ' ') as text
    from typed),
found as (
    select row_id, pos as start, array_to_string(tokens[pos + 1:pos + n], ' ') as text, kind as type, case when h.n > 1 then 0.98 else 0.90 end::double as confidence, 'gazetteer' as source
    from (select row_id, pos, phrase, n::bigint as n from hits) h join named using (row_id) join (select phrase, kind from gaz) using (phrase)
    union all select row_id, start, text, v[1], v[2]::double, v[3] from judged where v is not null)"""

SQL = {
    "gazetteer_hits": f"with {_BASE} select row_id, pos::bigint as start, n::bigint as size, phrase from hits",
    "capitalized_runs": f"with {_BASE} select row_id, start::bigint as start, run from runs",
    "entities": f"with {_FOUND} select row_id, start::bigint as start, text, type, confidence, source from found",
    "entity_types": f"with {_FOUND} select type, count(*) as count, round(count(*) * 100.0 / (select count(*) from found), 1) as share from found group by type",
    "entity_sources": f"with {_FOUND} select source, count(*) as count from found group by source",
    "entity_examples": f"""with {_FOUND}, r as (select *, row_number() over (partition by type order by row_id, start) as place from found)
        select type, place, text, source, confidence from r where place <= 4""",
    "top_entities": f"""with {_FOUND}, top as (select text, type, count(*) as count from found group by all order by 3 desc, 1, 2 limit 8)
        select *, round_even(count * 100.0 / max(count) over (), 0)::bigint as share from top""",
}
