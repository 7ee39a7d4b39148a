"""Queries for morphology. The lexicon is our own small one on both sides."""

from __future__ import annotations

from pyspark.sql import functions as F

from murmur import lexicons
from murmur.operators import morphology as m
from murmur.plans import sqltext as q
from murmur.plans.basics import labelled

SUFFIXES = ("ies", "s", "ed", "ing", "er", "est", "ly")


def _lexicon(spark):
    return lexicons.frame(spark, lexicons.LEXICON, "word string, pos string"), lexicons.frame(spark, lexicons.IRREGULAR, "form string, lemma string, pos string")


def _counts(spark, folder):
    return m.token_counts(labelled(spark, folder), F.col("tokens"), "row_id")


def _analysed(spark, folder):
    return m.analysed(_counts(spark, folder), *_lexicon(spark))


def stem_candidates(spark, folder):
    words = _counts(spark, folder).select("word")
    return m.inflection_options(words).select("word", "suffix", F.col("place").cast("long").alias("place"), "candidate")


def apply_affix(spark, folder):
    words = _counts(spark, folder).select("word")
    forms = F.array(*(F.struct(F.lit(s).alias("suffix"), m.apply_affix(F.col("word"), s).alias("form")) for s in SUFFIXES))
    return words.select("word", F.inline(forms))


def morph_decompose(spark, folder):
    rows = m.decompose(_counts(spark, folder), *_lexicon(spark))
    return rows.select("word", "root", "pos", "form", F.array_join("affixes", " ").alias("affixes"), "decomposition")


def word_forms(spark, folder):
    lexicon, irregular = _lexicon(spark)
    return m.word_forms(m.decompose(_counts(spark, folder), lexicon, irregular).select("root", "pos"), lexicon.select("word"))


def root_normalize(spark, folder):
    """Each comment's tokens replaced by their roots: the tokens meet the dimension of distinct words, then form rows again."""
    rows = labelled(spark, folder).select("row_id", F.posexplode("tokens").alias("at", "word"))
    return m.normalised(rows, m.decompose(rows.select("word"), *_lexicon(spark)), "root").withColumnRenamed("root", "roots")


def preprocess(spark, folder):
    """Each comment as one string of lemmas of its content tokens."""
    rows = labelled(spark, folder).select("row_id", F.posexplode("tokens").alias("at", "word"))
    return m.normalised(rows, m.decompose(rows.select("word"), *_lexicon(spark)), "lemma").withColumnRenamed("lemma", "lemmas")


def forms_of_word(spark, folder):
    """The forms of one word that is looked up, here "watching"."""
    return m.forms_of("watching", *_lexicon(spark)).select("word", "decomposition", "root", "form", "label", "rule")


def morph_summary(spark, folder):
    return m.summary(_analysed(spark, folder))


def top_forms(spark, folder):
    return m.top_forms(_analysed(spark, folder))


def top_roots(spark, folder):
    return m.top_roots(_analysed(spark, folder))


def affix_breakdown(spark, folder):
    return m.affix_breakdown(_analysed(spark, folder))


def pos_breakdown(spark, folder):
    return m.pos_breakdown(_analysed(spark, folder))


QUERIES = {f.__name__: f for f in (stem_candidates, apply_affix, morph_decompose, word_forms, root_normalize, preprocess, forms_of_word, morph_summary, top_forms, top_roots, affix_breakdown, pos_breakdown)}

_TOKENS = f"{q.BASE}, occ as (select row_id, unnest(tokens) as word, generate_subscripts(tokens, 1) as at_pos from base), cnt as (select word, count(*) as count, min(row_id * 100000 + at_pos) as first from occ group by word), w as (select word from cnt)"
_RULES = q.values([(n, *r) for n, r in enumerate(m.INFLECTIONS)], "rule, suffix, label, replacement, required", "infl")
_DERIV = q.values([(n, *r) for n, r in enumerate(m.DERIVATIONS)], "ord, suffix, label", "deriv")
_LEX = q.values(lexicons.LEXICON, "word, pos", "lex") + ", " + q.values(lexicons.IRREGULAR, "form, lemma, pos", "irr")
_ORDERS = q.values([(f, p, n) for f, o in {**m.FORM_ORDER, "": m.ANY_ORDER}.items() for n, p in enumerate(o)], "form, pos, rank", "form_order")
_ENDS = q.values([(n, p, c, k) for n, (p, o) in enumerate((*m.ENDING_ORDER, ("", m.ANY_ORDER))) for k, c in enumerate(o)], "nth, pattern, pos, rank", "end_order")
_NAMES = q.values(m.POS_NAMES.items(), "pos, name", "pos_name")
_FORCED = q.values(m.FORCED_POS.items(), "suffix, name", "forced")


def _undoubled(x: str) -> str:
    return f"case when length({x}) > 2 and right({x}, 1) = left(right({x}, 2), 1) and regexp_matches(right({x}, 1), '[{m.DOUBLED}]') then left({x}, length({x}) - 1) else {x} end"


def _silent(x: str) -> str:
    return f"case when length({x}) > 2 and regexp_matches({x}, '{m.SILENT_E}') then {x} || 'e' else {x} end"


_OPTIONS = f"""opt0 as (select word, rule, suffix, label, required, replacement, left(word, length(word) - length(suffix)) as b from w join infl on ends_with(word, suffix) and length(word) - length(suffix) >= 2),
raw as (
    select * from (
        select word, rule, suffix, label, required, 0 as p, case when replacement is not null then b || replacement else b end as candidate from opt0
        union all select word, rule, suffix, label, required, 1, {_undoubled('b')} from opt0 where replacement is null
        union all select word, rule, suffix, label, required, 2, b || 'e' from opt0 where replacement is null
        union all select word, rule, suffix, label, required, 3, left(b, length(b) - 1) || 'y' from opt0 where replacement is null and ends_with(b, 'i')
        union all select word, rule, suffix, label, required, 4, {_silent('b')} from opt0 where replacement is null
        union all select word, rule, suffix, label, required, 5, {_silent('(' + _undoubled('b') + ')')} from opt0 where replacement is null)
    where length(candidate) >= 2),
options as (
    select word, rule, suffix, label, required, candidate, row_number() over (partition by word, rule order by min(p)) - 1 as place
    from raw group by word, rule, suffix, label, required, candidate)"""


def _peel(name: str, source: str, column: str) -> str:
    return f"""{name} as (
    select w as {column}, arg_min(base, ord) as base, arg_min(suffix, ord) as suffix, arg_min(label, ord) as label
    from (select distinct {column} as w, left({column}, length({column}) - length(d.suffix)) as base, d.ord, d.suffix, d.label from {source} src join deriv d on ends_with({column}, d.suffix) and length({column}) - length(d.suffix) >= 2)
    where base in (select word from lex) group by w)"""


_DECOMPOSE = f"""{_TOKENS}, {_RULES}, {_DERIV}, {_LEX}, {_ORDERS}, {_ENDS}, {_NAMES}, {_FORCED}, {_OPTIONS}, {_peel('pc', 'options', 'candidate')},
ordered as (select word, min(nth) as nth from w, end_order where pattern = '' or regexp_matches(word, pattern) group by word),
lem as (
    select word, arg_min(candidate, (rank, rule, place)) as lemma
    from options join ordered using (word) join end_order using (nth) join lex on lex.word = candidate and lex.pos = end_order.pos
    where not exists (select 1 from lex own where own.word = options.word and own.pos = end_order.pos) group by word),
lemma as (select w.word, coalesce((select min(irr.lemma) from irr where irr.form = w.word), lem.lemma) as lemma from w left join lem using (word)),
hit as (
    select o.word, arg_min(candidate, (rule, place)) as stem, arg_min(suffix, (rule, place)) as inflection, arg_min(label, (rule, place)) as inflected
    from options o join lemma l using (word)
    where case when l.lemma is not null then candidate = l.lemma
        when required is not null then exists (select 1 from lex where lex.word = candidate and lex.pos = required)
        else candidate in (select word from lex) or candidate in (select candidate from pc) end
    group by o.word),
bare as (select word, lemma, stem, inflection, inflected, coalesce(stem, lemma, word) as bare, lemma is not null and stem is null as irregular from lemma left join hit using (word)),
{_peel('p1', 'bare', 'bare')}, {_peel('p2', 'p1', 'base').replace('select w as base, arg_min(base, ord) as base', 'select w as b1, arg_min(base, ord) as base')},
dec0 as (
    select word, irregular, inflection, inflected, bare, case when not irregular then p1.base end as b1, case when not irregular then p1.suffix end as s1, case when not irregular then p1.label end as l1,
        case when not irregular then p2.base end as b2, case when not irregular then p2.suffix end as s2, case when not irregular then p2.label end as l2
    from bare left join p1 using (bare) left join p2 on p2.b1 = p1.base),
dec1 as (
    select *, coalesce(b2, b1, bare) as root, case when irregular then 'Irregular' when inflected is not null then inflected when s1 is not null then 'Derived' else 'Base form' end as form,
        list_filter([s2, s1, inflection], lambda x: x is not null) as affixes,
        list_filter([case when s2 is not null then 'Derivational' end, case when s1 is not null then 'Derivational' end, case when inflection is not null then 'Inflectional' end], lambda x: x is not null) as kinds,
        list_filter([l2, l1, inflected], lambda x: x is not null) as labels from dec0),
guessed as (select root, d.form, arg_min(lex.pos, rank) as pos from (select distinct root, form from dec1) d
    join form_order f on f.form = case when d.form in (select form from form_order) then d.form else '' end join lex on lex.word = d.root and lex.pos = f.pos group by root, d.form),
dec as (
    select word, root, bare as lemma, coalesce(f1.name, f2.name, n.name, 'Noun') as pos, d.form, affixes, kinds, labels,
        case when irregular then root || ' → ' || word else array_to_string(list_prepend(root, affixes), ' + ') end as decomposition
    from dec1 d left join forced f1 on f1.suffix = s1 left join forced f2 on f2.suffix = s2 left join guessed g using (root, form) left join pos_name n on n.pos = g.pos),
an as (select * from cnt join dec using (word))"""


def _affix(base: str, suffix: str) -> str:
    hissing, y = f"regexp_matches({base}, '(s|x|z|ch|sh)$')", f"regexp_matches({base}, '.[^aeiou]y$')"
    cut = f"left({base}, length({base}) - 1)"
    if suffix == "ies":
        return f"case when {hissing} then {base} || 'es' when {y} then {cut} || 'ies' else {base} || 's' end"
    out = "case"
    if suffix in ("ed", "ing", "er", "est"):
        out += f" when ends_with({base}, 'e') then {cut} || '{suffix}'"
    out += f" when {y} then " + (f"{cut} || 'ies'" if suffix == "s" else f"{base} || 'ing'" if suffix == "ing" else f"{cut} || 'i{suffix}'")
    if suffix == "s":
        out += f" when {hissing} then {base} || 'es'"
    if suffix in ("ed", "ing"):
        out += f" when len(regexp_extract_all({base}, '[aeiouy]+')) <= 1 and regexp_matches({base}, '[^aeiou][aeiou][^aeiouwxy]$') then {base} || right({base}, 1) || '{suffix}'"
    return out + f" else {base} || '{suffix}' end"


_FORMS = " union all ".join(
    f"select root, pos, '{c}' as word_class, {n} as nth, {k + 1} as place, '{label}' as label, '+{suffix}' as rule, {_affix('root', suffix)} as form from roots"
    for n, (c, rows) in enumerate(m.TEMPLATES.items()) for k, (label, suffix) in enumerate(rows)
)

SQL = {
    "stem_candidates": f"with {_TOKENS}, {_RULES}, {_OPTIONS} select word, suffix, place, candidate from options",
    "apply_affix": f"with {_TOKENS} " + " union all ".join(f"select word, '{s}' as suffix, {_affix('word', s)} as form from w" for s in SUFFIXES),
    "morph_decompose": f"with {_DECOMPOSE} select word, root, pos, form, array_to_string(affixes, ' ') as affixes, decomposition from dec",
    "word_forms": f"""with {_DECOMPOSE}, roots as (select distinct root, pos from dec), made as (select * from ({_FORMS}) where form <> root),
        pref as (select *, case pos when 'Noun' then 0 when 'Verb' then 1 when 'Adjective' then 2 else 3 end as pn from made),
        classed as (select root, pos, word_class, case when word_class = pos then 0 when nth < pn then nth + 1 else nth end as late, count(*) filter (form in (select word from lex)) as hits from pref group by all),
        best as (select root, pos, arg_max(word_class, (hits - 0.5 * late, -late)) as chosen from classed group by root, pos)
        select root, pos, 0::bigint as place, root as form, 'Base form' as label, '' as rule, pos as word_class from best
        union all select root, pos, place::bigint, form, label, rule, chosen from best join made using (root, pos) where word_class = chosen""",
    "root_normalize": f"with {_DECOMPOSE} select row_id, string_agg(root, ' ' order by at_pos) as roots from occ join dec using (word) group by row_id",
    "preprocess": f"with {_DECOMPOSE} select row_id, string_agg(lemma, ' ' order by at_pos) as lemmas from occ join dec using (word) group by row_id",
    "forms_of_word": """select 'watching' as word, 'watch + ing' as decomposition, 'watch' as root, form, label, rule
        from (values ('watch', 'Base form', ''), ('watches', 'Third person singular', '+s'), ('watched', 'Past tense', '+ed'), ('watching', 'Present participle', '+ing')) v(form, label, rule)""",
    "morph_summary": f"""with {_DECOMPOSE} select sum(count)::bigint as tokens_analyzed, count(*) as distinct_forms, count(distinct root) as distinct_roots, coalesce(sum(count) filter (word <> root), 0)::bigint as inflected_tokens,
        round((1 - count(distinct root)::double / count(*)) * 100, 1) as collapse_ratio from an""",
    "top_forms": f"""with {_DECOMPOSE} select word, root, pos, form, array_to_string(affixes, ' ') as affixes, decomposition, count, round(count * 100.0 / (select sum(count) from an), 1) as share from an order by count desc, first limit 8""",
    "top_roots": f"""with {_DECOMPOSE}, rp as (select root, pos, sum(count) as n, min(first) as first from an group by all), modal as (select root, arg_min(pos, (-n, first)) as pos from rp group by root)
        select root, pos, string_agg(word, ' ' order by word) as forms, sum(count)::bigint as count from (select root, word, count, first from an) join modal using (root) group by root, pos order by sum(count) desc, min(first) limit 8""",
    "affix_breakdown": f"""with {_DECOMPOSE}, x as (select count, unnest(affixes) as affix, unnest(kinds) as kind, unnest(labels) as label from an)
        select '+' || affix as affix, kind, label, sum(count)::bigint as count, round(sum(count) * 100.0 / (select sum(count) from an), 1) as share from x group by affix, kind, label order by 4 desc, 1, 2, 3 limit 6""",
    "pos_breakdown": f"with {_DECOMPOSE} select pos, sum(count)::bigint as count, round(sum(count) * 100.0 / (select sum(count) from an), 1) as share from an group by pos",
}
