"""Queries for tagging and chunking; they use the rule tagger, which has a closed form."""

from __future__ import annotations

from pyspark.sql import functions as F

from murmur.functions import text as tx
from murmur.lexicons import COARSE, FUNCTION_TAGS, TAG_PATTERNS
from murmur.operators import chunking, pos
from murmur.plans import sqltext as q
from murmur.plans.basics import labelled, table


def _full(spark, folder):
    return table(spark, folder, "comments").where("text is not null").select("row_id", tx.tokenize_full(F.col("text")).alias("tokens"))


def _counts(spark, folder):
    return _full(spark, folder).select(F.explode("tokens").alias("word")).groupBy("word").agg(F.count("*").alias("count"))


def pos_rules(spark, folder):
    """Raw words, so that capitals, digits and signs reach their rules."""
    words = table(spark, folder, "comments").select(F.explode(F.split("text", rf"[{tx.BLANK}]+")).alias("word")).where("word <> ''").distinct()
    return words.select("word", F.coalesce(pos.rule_or_none(F.col("word")), F.lit("NN")).alias("tag"))


def pos_hybrid(spark, folder):
    return _full(spark, folder).select("row_id", F.array_join(pos.tag_hybrid(F.col("tokens")), " ").alias("tags"))


def pos_contextual(spark, folder):
    return _full(spark, folder).select("row_id", F.array_join(pos.tag_contextual(F.col("tokens")), " ").alias("tags"))


def pos_distribution(spark, folder):
    return pos.distribution(pos.word_tags(_counts(spark, folder)))


def pos_key_words(spark, folder):
    return pos.key_words(_counts(spark, folder))


def _pairs(spark, folder):
    return pos.compared(_full(spark, folder), F.col("tokens"))


def tagger_agreement(spark, folder):
    return pos.agreement(_pairs(spark, folder))


def tagger_confusion(spark, folder):
    return pos.confusion(_pairs(spark, folder))


def tagger_examples(spark, folder):
    return pos.disagreements(_full(spark, folder), "tokens")


def chunk_example(spark, folder):
    return chunking.chunk_example(_chunked(spark, folder))


def _chunked(spark, folder):
    return _full(spark, folder).withColumn("chunks", chunking.chunks(F.col("tokens")))


def chunk_rows(spark, folder):
    return _chunked(spark, folder).select("row_id", F.array_join(F.transform("chunks", lambda c: F.concat(c["type"], F.lit(":"), F.array_join(c["tokens"], " "))), "|").alias("chunks"))


def chunk_types(spark, folder):
    return chunking.chunk_types(_chunked(spark, folder))


def chunk_summary(spark, folder):
    return chunking.chunk_summary(_chunked(spark, folder))


def key_phrases(spark, folder):
    return chunking.key_phrases(_chunked(spark, folder))


def feature_strings(spark, folder):
    rows = _chunked(spark, folder)
    return rows.select("row_id", *(c.alias(n) for n, c in chunking.feature_strings(F.col("tokens"), F.col("chunks")).items()))


def study_sizes(spark, folder):
    return chunking.study_sizes(chunking.study_rows(labelled(spark, folder), "tokens", "label", "row_id"))


def study_scores(spark, folder):
    return chunking.study_scores(labelled(spark, folder), "tokens", "label", "row_id")


QUERIES = {f.__name__: f for f in (pos_rules, pos_hybrid, pos_contextual, pos_distribution, pos_key_words, tagger_agreement, tagger_confusion, tagger_examples, chunk_example, chunk_rows, chunk_types, chunk_summary, key_phrases, feature_strings, study_sizes, study_scores)}


def _quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _rule(t: str) -> str:
    by_tag: dict[str, list[str]] = {}
    for w, tag in FUNCTION_TAGS.items():
        by_tag.setdefault(tag, []).append(w)
    out = "case" + "".join(f" when lower({t}) in ({_quoted(ws)}) then '{tag}'" for tag, ws in by_tag.items())
    out += f" when regexp_full_match({t}, '\\p{{Lu}}\\p{{Ll}}+') then 'NNP'"
    return out + "".join(" when regexp_matches(" + t + ", '" + p.replace("'", "''") + f"') then '{tag}'" for p, tag in TAG_PATTERNS) + " end"


def _coarse(t: str) -> str:
    groups: dict[str, list[str]] = {}
    for tag, g in COARSE.items():
        groups.setdefault(g, []).append(tag)
    return "case" + "".join(f" when {t} in ({_quoted(ts)}) then '{g}'" for g, ts in groups.items()) + " else 'Other' end"


_SYMBOL = "case when tag = 'DT' then 'D' when tag = 'JJ' then 'J' when tag = 'JJR' then 'R' when tag = 'JJS' then 'S' when starts_with(tag, 'NN') then 'N' when tag = 'RB' then 'A' when tag = 'MD' then 'M' when starts_with(tag, 'VB') then 'V' else 'O' end"
_TOK = f"""tokened as (select row_id, {q.full('text')} as tokens from comments where text is not null),
occ as (select row_id, unnest(tokens) as word, generate_subscripts(tokens, 1) as at_pos from tokened),
dim as (select word, {_rule('word')} as rule from (select distinct word from occ)),
tagged as (select row_id, at_pos, word, rule, coalesce(rule, 'NN') as tag, lag(coalesce(rule, 'NN')) over (partition by row_id order by at_pos) as before from occ join dim using (word)),
ctx as (select *, case {" ".join(f"when tag = '{a}' and before = '{b}' then '{c}'" for a, b, c in pos.PATCHES)} else tag end as ctag from tagged)"""
_CHUNK = f"""{_TOK},
strs as (select row_id, regexp_replace(string_agg({_SYMBOL}, '' order by at_pos), 'D?[JRS]*N+', '[\\0]', 'g') as s from tagged group by row_id),
pieces as (select row_id, unnest(ps) as p, generate_subscripts(ps, 1) as k from (select row_id, regexp_extract_all(s, '\\[[A-Z]*\\]|DA+[JRS]|A+[JRS]|[RS]|M?V|.') as ps from strs)),
sized as (select row_id, p, k, case when starts_with(p, '[') then length(p) - 2 else length(p) end as n, case when starts_with(p, '[') then 'NP' when regexp_matches(p, '[JRS]') then 'ADJP' when ends_with(p, 'V') then 'VP' end as type from pieces),
placed as (select *, sum(n) over (partition by row_id order by k) - n as start from sized),
ch as (select row_id, type, start, n, string_agg(word, ' ' order by at_pos) as words, list(word order by at_pos) as ws, list(tag order by at_pos) as ts
    from placed join tagged using (row_id) where type is not null and at_pos > start and at_pos <= start + n group by row_id, type, start, n)"""


def _singular(w: str) -> str:
    return f"case when length({w}) > 3 and regexp_matches({w}, '[^aeiou]ies$') then left({w}, length({w}) - 3) || 'y' when length({w}) > 3 and regexp_matches({w}, '(ss|x|z|ch|sh)es$') then left({w}, length({w}) - 2) when length({w}) > 3 and regexp_matches({w}, '[^su]s$') then left({w}, length({w}) - 1) else {w} end"


_PAIRS = """pairs as (select 'contextual' as tagger, ctag as tag, ctag as baseline from ctx union all select 'rules', tag, ctag from ctx union all select 'hybrid', coalesce(rule, ctag), ctag from ctx)"""

SQL = {
    "pos_rules": f"with w as (select distinct unnest(string_split_regex(text, '{q.BLANK}+')) as word from comments) select word, coalesce({_rule('word')}, 'NN') as tag from w where word <> ''",
    "pos_hybrid": f"with {_TOK} select t.row_id, coalesce(s.tags, '') as tags from tokened t left join (select row_id, string_agg(coalesce(rule, ctag), ' ' order by at_pos) as tags from ctx group by row_id) s using (row_id)",
    "pos_contextual": f"with {_TOK} select t.row_id, coalesce(s.tags, '') as tags from tokened t left join (select row_id, string_agg(ctag, ' ' order by at_pos) as tags from ctx group by row_id) s using (row_id)",
    "pos_distribution": f"with {_TOK} select {_coarse('tag')} as group, count(*) as count, round(count(*) * 100.0 / (select count(*) from tagged), 1) as share from tagged group by 1".replace(" as group,", ' as "group",'),
    "pos_key_words": f"""with {_TOK}, g as (select {_coarse('tag')} as grp, word, count(*) as count from tagged group by all), r as (select *, row_number() over (partition by grp order by count desc, word) as rank from g)
        select grp as "group", rank, word, count from r where rank <= 6 and grp in ('Noun', 'Verb', 'Adjective')""",
    "tagger_agreement": f"with {_TOK}, {_PAIRS} select tagger, count(*) as tokens, round(count(*) filter (tag = baseline) * 100.0 / count(*), 1) as agreement from pairs group by tagger",
    "tagger_confusion": f"""with {_TOK}, {_PAIRS}, s as (select {_coarse('baseline')} as a, {_coarse('tag')} as b from pairs) select a || ' -> ' || b as shift, count(*) as count from s where a <> b group by 1 order by 2 desc, 1 limit 6""",
    "chunk_example": f"""with {_CHUNK}, f as (select row_id, array_to_string(tokens, ' ') as sentence from tokened where len(tokens) > 4 order by row_id limit 1)
        select row_id, sentence, coalesce(string_agg('[' || words || ' ' || type || ']', ' ' order by start), '') as chunks from f left join ch using (row_id) group by all""",
    "tagger_examples": f"""with {_TOK}, w as (
            select *, coalesce(rule, ctag) as htag, lead(word) over r as w1, lead(word, 2) over r as w2, lag(word) over r as b1, lag(word, 2) over r as b2 from ctx window r as (partition by row_id order by at_pos)),
        d as (select 'rules' as tagger, row_id, at_pos, word, tag as t, ctag, w1, w2, b1, b2 from w union all select 'hybrid', row_id, at_pos, word, htag, ctag, w1, w2, b1, b2 from w),
        n as (select *, row_number() over (partition by tagger order by row_id, at_pos) as place from d where t <> ctag and w1 is not null)
        select tagger, place, word as token, t as tag, ctag as baseline, concat_ws(' ', b2, b1, word, w1, w2) as context from n where place <= 4""",
    "chunk_rows": f"with {_CHUNK} select t.row_id, coalesce(s.c, '') as chunks from tokened t left join (select row_id, string_agg(type || ':' || words, '|' order by start) as c from ch group by row_id) s using (row_id)",
    "chunk_types": f"with {_CHUNK} select type, count(*) as count, round(count(*) * 100.0 / (select count(*) from ch), 1) as share from ch group by type",
    "chunk_summary": f"with {_CHUNK} select (select count(*) from tokened) as comments, count(*) as chunks, round(count(*)::double / (select count(*) from tokened), 2) as mean_chunks from ch",
    "key_phrases": f"""with {_CHUNK}, kept as (select row_id, start, list_transform(list_filter(list_zip(ws, ts), lambda x: x[2] not in ('DT', 'CC', 'PRP$', 'CD')), lambda x: {_singular('x[1]')}) as k from ch where type in ('NP', 'ADJP')),
        ph as (select row_id, array_to_string(k, ' ') as phrase from kept where len(k) between 1 and 3 and (len(k) > 1 or length(k[1]) >= 3)),
        top as (select phrase, count(*) as count, count(distinct row_id) as documents from ph group by phrase order by 2 desc, 3 desc, 1 limit 6)
        select phrase, count, documents, round_even(count * 100.0 / max(count) over (), 0)::bigint as share, round(documents * 100.0 / (select count(*) from tokened), 1) as comment_share from top""",
    "feature_strings": f"""with {_CHUNK}, f as (select row_id, string_agg(word, ' ' order by at_pos) as u, string_agg(word || '_' || {_coarse('tag')}, ' ' order by at_pos) as p from tagged group by row_id),
        c as (select row_id, string_agg(array_to_string(ws, '_'), ' ' order by start) as c from ch group by row_id),
        x as (select t.row_id, coalesce(u, '') as unigrams, coalesce(p, '') as pos, coalesce(c, u, '') as chunks from tokened t left join f using (row_id) left join c using (row_id))
        select *, unigrams || ' || ' || pos || ' || ' || chunks as combined from x""",
    "study_sizes": f"""with {q.BASE}, n as (select count(distinct array_to_string(tokens, ' ')) as n from base where label in ('positive', 'negative'))
        select f as fraction, least(n, greatest(6, round_even(n * f, 0)))::bigint as train_size from n, (values (0.25::double), (0.5), (0.75), (1.0)) v(f) where n >= 12""",
}
