"""Pieces of DuckDB SQL that the oracle queries share; written apart from the Spark expressions, from the same definitions."""

from __future__ import annotations

BLANK = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"
FILLED = r"[^\t-\r\x1c-\x20\x{85}\p{Z}]"
EMOJI = r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}\x{2702}-\x{27B0}\x{24C2}-\x{1F251}]+"
URL = rf"https?://{FILLED}+|www\.{FILLED}+"


def clean(text: str) -> str:
    out = f"regexp_replace(lower({text}), '{URL}', '', 'g')"
    out = f"regexp_replace({out}, '{EMOJI}', '', 'g')"
    out = f"regexp_replace({out}, '[!-/:-@\\[-`{{-~]', '', 'g')"
    return f"trim(regexp_replace({out}, '{BLANK}+', ' ', 'g'))"


def full(text: str) -> str:
    parted = f"regexp_replace({clean(text)}, '\\b(?:(can)(not)|(gon|wan)(na)|(got)(ta)|(gim|lem)(me))\\b', '\\1\\3\\5\\7 \\2\\4\\6\\8', 'g')"
    return f"list_filter(string_split({parted}, ' '), lambda t: regexp_full_match(t, '\\p{{L}}+'))"


def surface(text: str) -> str:
    return f"list_filter({full(text)}, lambda t: length(t) > 2 and not list_contains(stop, t))"


def sentences(text: str) -> str:
    parts = f"string_split_regex({text}, '[.!?…]+|\\n+')"
    return f"list_filter(list_transform({parts}, lambda p: {surface('p')}), lambda s: len(s) > 0)"


def named(text: str) -> str:
    out = f"regexp_replace(regexp_replace({text}, '{URL}', ' ', 'g'), '{EMOJI}', ' ', 'g')"
    out = f"regexp_replace({out}, '[^A-Za-z''\\t-\\r\\x1c-\\x20\\x{{85}}\\p{{Z}}]', ' ', 'g')"
    return f"list_filter(string_split(trim(regexp_replace({out}, '{BLANK}+', ' ', 'g')), ' '), lambda t: regexp_full_match(t, '[A-Za-z]+'))"


#: stop(stop): one row with all stop words.
STOP = "stopping as (select list(word) as stop from stop_word)"
#: one row a comment, with its content tokens, sentences, polarity and label.
BASE = f"""{STOP},
toks as (select row_id, text, author, likes, published_at, updated_at, video_id, {surface('text')} as tokens from comments, stopping),
scored as (
    select row_id, coalesce(avg(p.polarity), 0.0) as polarity
    from toks left join (select row_id, unnest(tokens) as word from toks) u using (row_id) left join polarity p on p.word = u.word
    group by row_id),
base as (
    select t.*, s.polarity, case when s.polarity > 0.1 then 'positive' when s.polarity < -0.1 then 'negative' else 'neutral' end as label
    from toks t join scored s using (row_id))"""
SENT = f"""{STOP},
sent as (select row_id, unnest(ss) as s from (select row_id, {sentences('text')} as ss from comments, stopping))"""


def grams(n: int) -> str:
    """CTE g{n}(row_id, phrase): every n-gram occurrence, those of one repeated word left out."""
    keep = "" if n == 1 else "where len(list_distinct(string_split(phrase, ' '))) > 1"
    return f"""g{n} as (
    select row_id, phrase from (
        select row_id, array_to_string(s[i:i + {n - 1}], ' ') as phrase from (select row_id, s, unnest(range(1, len(s) - {n} + 2)) as i from sent)) {keep})"""


def counted(n: int) -> str:
    return f"c{n} as (select phrase, count(*) as count, count(distinct row_id) as documents from g{n} group by phrase)"


def top(n: int, k: int = 6) -> str:
    return f"""t{n} as (
    select * from (select * from c{n} order by count desc, documents desc, phrase limit {k})
    where count >= case when (select max(count) from c{n}) >= 2 then 2 else 1 end)"""


def values(rows, columns: str, name: str) -> str:
    """CTE of literal rows."""
    lit = lambda v: "null" if v is None else str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"
    return f"{name}({columns}) as (values " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + ")"
