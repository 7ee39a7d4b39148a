"""Queries for similarity and word senses."""

from __future__ import annotations

from pyspark.sql import functions as F

from murmur import lexicons
from murmur.functions import text as tx
from murmur.operators import senses as ws
from murmur.operators import similarity as sim
from murmur.plans import sqltext as q
from murmur.plans.basics import labelled, stop_words, table
from murmur.plans.grammar import _singular
from murmur.storage import checkpointed

TARGETS = sorted({r[0] for r in lexicons.SENSES})


def _featured(spark, folder):
    rows = labelled(spark, folder).where("text is not null")
    return rows.withColumn("features", sim.folded_features(tx.tokenize_full(F.col("text")), stop_words(spark, folder)))


def folded_features(spark, folder):
    return _featured(spark, folder).select("row_id", F.array_join("features", " ").alias("features"))


def feature_classes(spark, folder):
    return sim.classes(_featured(spark, folder), F.col("features"))


def similar_pairs(spark, folder):
    return sim.similar_pairs(_featured(spark, folder), F.col("features"))


def video_labels(spark, folder):
    """Videos as groups: what each is about."""
    return sim.group_labels(_featured(spark, folder), "video_id", "features", "row_id")


def video_sentiment(spark, folder):
    return sim.group_sentiment(_featured(spark, folder), "video_id")


def video_concentration(spark, folder):
    """The six videos with most comments, as groups."""
    rows = table(spark, folder, "comments").where("text is not null")
    sizes = rows.groupBy("video_id").agg(F.count("*").alias("size"))
    return sim.redundancy(sizes, rows.agg(F.count("*")).scalar())


def discussion_groups(spark, folder):
    members = sim.group_similar(_featured(spark, folder), F.col("features"), "video_id", "row_id")
    return sim.merge_groups(members, "video_id", "row_id")


def _discussion_members(spark, folder):
    return checkpointed(sim.group_similar(_featured(spark, folder), F.col("features"), "video_id", "row_id"))


def discussion_sentiment(spark, folder):
    named = sim.named_members(_discussion_members(spark, folder), "video_id", "row_id").select("video_id", "row_id", "label")
    moods = _featured(spark, folder).select(F.col("row_id").alias("__row"), F.col("label").alias("mood"))
    return sim.discussion_sentiment(named.join(moods, F.col("row_id") == F.col("__row")), "video_id", "mood")


def redundancy(spark, folder):
    """How many comments of the six largest discussion groups say what another says."""
    sizes = sim.merge_groups(_discussion_members(spark, folder), "video_id", "row_id").select("video_id", "label", "size")
    rows = table(spark, folder, "comments").where(F.col("text").rlike(r"\S"))
    return sim.redundancy(sizes, F.lit(rows.count()))


def _contexts(spark, folder):
    rows = table(spark, folder, "comments").where("text is not null")
    return ws.contexts(rows, tx.tokenize_full(F.col("text")), TARGETS)


def _senses(spark):
    return lexicons.frame(spark, lexicons.SENSES, "word string, rank int, sense string, gloss string, cues string")


def wsd_targets(spark, folder):
    return _contexts(spark, folder).select("row_id", "at", "word", "target")


def wsd_context(spark, folder):
    return _contexts(spark, folder).select("row_id", "target", F.array_join("context", " ").alias("context"))


def gloss_overlap(spark, folder):
    return ws.gloss_overlap(_contexts(spark, folder), _senses(spark))


def sense_scores(spark, folder):
    return ws.sense_scores(_contexts(spark, folder), _senses(spark))


def disambiguate(spark, folder):
    return ws.disambiguate(sense_scores(spark, folder), _senses(spark))


def wsd_breakdown(spark, folder):
    return ws.breakdown(sense_scores(spark, folder))


def wsd_report(spark, folder):
    return ws.report(sense_scores(spark, folder))


QUERIES = {f.__name__: f for f in (folded_features, feature_classes, similar_pairs, video_labels, video_sentiment, video_concentration, discussion_groups, discussion_sentiment, redundancy, wsd_targets, wsd_context, gloss_overlap, sense_scores, disambiguate, wsd_breakdown, wsd_report)}

_SYN = q.values(lexicons.SYNONYMS.items(), "w, c", "syn")
_FEAT = f"""{q.BASE}, {_SYN},
ft as (select row_id, unnest(tokens) as w, generate_subscripts(tokens, 1) as k from (select row_id, {q.full('text')} as tokens from comments where text is not null)),
sg as (select *, {_singular('w')} as s from ft),
fo as (
    select row_id, k, coalesce(s1.c, s2.c, s) as f from sg left join syn s1 on s1.w = sg.s left join syn s2 on s2.w = sg.w
    where sg.w not in (select word from stop_word) and sg.s not in (select word from stop_word)),
feat as (select c.row_id, coalesce(x.f, '') as f, x.bag from (select row_id from comments where text is not null) c left join (select row_id, string_agg(f, ' ' order by k) as f, string_agg(f, ' ' order by f) as bag from fo group by row_id) x using (row_id))"""
_CTX = f"""wt as (select row_id, unnest(tokens) as w, generate_subscripts(tokens, 1) - 1 as pos, tokens from (select row_id, {q.full('text')} as tokens from comments where text is not null)),
targets as (select unnest({TARGETS!r}) as t),
tg as (
    select row_id, w, pos, tokens, case when w in (select t from targets) then w when {_singular('w')} in (select t from targets) then {_singular('w')}
        when ends_with(w, 'es') and left(w, length(w) - 2) in (select t from targets) then left(w, length(w) - 2) when left(w, length(w) - 1) in (select t from targets) then left(w, length(w) - 1) end as target from wt),
hit as (select *, row_number() over (partition by row_id, target order by pos) as rn from tg where target is not null),
ctx as (select row_id, pos, w, target, list_concat(tokens[greatest(pos - 5, 1):pos], tokens[pos + 2:pos + 7]) as context from hit where rn = 1),
{q.values(lexicons.SENSES, 'word, rank, sense, gloss, cues', 'senses')},
voc as (select *, list_distinct(regexp_extract_all(lower(gloss), '[a-z]+')[1:24]) as g, string_split(cues, ' ') as c from senses),
scored as (
    select row_id, pos, w, target, sense, rank, 2.0 * coalesce(len(list_intersect(list_distinct(context), list_distinct(list_concat(g, c))))::double / nullif(len(list_distinct(context)), 0), 0) + 2.5 * least(len(list_intersect(list_distinct(context), c)), 3) as x
    from ctx join voc on voc.word = target),
ss as (select row_id, pos as at_pos, w as word, target, sense, rank, round(exp(x) / sum(exp(x)) over (partition by row_id, pos), 6) as probability, row_number() over (partition by row_id, pos order by x desc, rank) as place from scored)"""

SQL = {
    "folded_features": f"with {_FEAT} select row_id, f as features from feat",
    "feature_classes": f"with {_FEAT} select row_id, min(row_id) over (partition by bag) as class_id from feat where bag is not null",
    "similar_pairs": f"""with {_FEAT}, reps as (select min(row_id) as id from feat where bag is not null group by bag),
        tf as (select id, f as term, count(*) as tf from reps join fo on fo.row_id = id group by all), df as (select term, count(*) as df from tf group by term),
        w as (select id, term, (1 + ln(tf)) * (ln((1.0 + (select count(*) from reps)) / (1 + df)) + 1) as w from tf join df using (term)),
        v as (select id, term, w / sqrt(sum(w * w) over (partition by id)) as w from w)
        select x.id as a, y.id as b, round(sum(x.w * y.w), 6) as cosine from v x join v y on x.term = y.term and x.id < y.id group by 1, 2 having round(sum(x.w * y.w), 6) >= 0.8""",
    "video_labels": f"""with {_FEAT}, o as (select video_id, row_id, k, f from fo join comments using (row_id)),
        p as (select video_id, f, count(distinct row_id) as df, min(row_id * 100000 + k) as first, f in ('bad', 'good') as op from o group by video_id, f),
        r as (select *, row_number() over (partition by video_id order by op, df desc, first, f) as rk from p),
        l as (select video_id, string_agg(upper(f[1]) || f[2:], ' ' order by rk) as label from r where rk <= 2 group by video_id)
        select video_id, coalesce(label, 'General') as label from (select distinct video_id from comments where text is not null) left join l using (video_id)""",
    "video_sentiment": f"""with {q.BASE}, c as (select video_id, label, count(*) as n from base where text is not null group by all)
        select video_id, sum(n)::bigint as size, case when max(n) >= greatest(2, sum(n) / 2) then arg_max(label, (n, label)) else 'mixed' end as sentiment from c group by video_id""",
    "video_concentration": """with s as (select video_id, count(*) as size from comments where text is not null group by 1), t as (select * from s where size >= 2 order by size desc, video_id limit 6)
        select coalesce(sum(size), 0)::bigint as grouped, count(*) as groups, (coalesce(sum(size), 0) - count(*))::bigint as redundant, coalesce(round((sum(size) - count(*)) * 100.0 / nullif((select count(*) from comments where text is not null), 0), 1), 0) as compression, coalesce(sum(size * (size - 1) // 2), 0)::bigint as redundant_pairs from t""",
    "wsd_targets": f'with {_CTX} select row_id, pos::bigint as "at", w as word, target from ctx',
    "wsd_context": f"with {_CTX} select row_id, target, array_to_string(context, ' ') as context from ctx",
    "gloss_overlap": f"""with {_CTX}, x as (select row_id, target, sense, rank, len(list_intersect(g, list_distinct(context)))::double / len(g) as s from ctx join voc on voc.word = target)
        select row_id, target, arg_max(sense, (s, -rank)) as sense, round(least(0.5, max(s)), 3) as confidence from x where s > 0 group by row_id, target""",
    "sense_scores": f'with {_CTX} select row_id, at_pos::bigint as "at", word, target, sense, rank::bigint as rank, probability, place from ss',
    "disambiguate": f"""with {_CTX}, o as (select row_id, at_pos, word, list(sense order by place) as s, list(probability order by place) as p from ss group by row_id, at_pos, word, target)
        select row_id, at_pos::bigint as "at", o.word, s[1] as sense, split_part(gloss, ';', 1) as gloss, round(p[1], 3) as confidence, round(p[1] - coalesce(p[2], 0), 3) as margin,
            array_to_string(list_transform(list_zip(s[2:4], p[2:4]), lambda x: x[1] || ' ' || printf('%.3f', round_even(x[2], 3))), ', ') as alternatives from o join senses on senses.sense = s[1]""",
    "wsd_breakdown": f"""with {_CTX}, b as (select word, sense, count(*) as count, round(avg(probability), 3) as confidence from ss where place = 1 group by all),
        r as (select *, row_number() over (partition by word order by count desc, sense) as place from b)
        select word, place, sense, count, confidence from r where place <= 4""",
    "wsd_report": f"""with {_CTX}, b as (select word, sense, count(*) as n, sum(probability) as p from ss where place = 1 group by all)
        select word, sum(n)::bigint as occurrences, count(*) as senses, arg_min(sense, (-n, sense)) as top_sense, round(sum(p) / sum(n), 3) as confidence from b group by word order by 2 desc, 1 limit 8""",
}
