"""The same results in DuckDB's SQL, for the queries that SQL expresses."""

_LATEST = """
latest as (
    select comment_id, video_id, author, likes from comments
    qualify row_number() over (partition by comment_id order by greatest(published_at, updated_at) desc nulls last, row_id desc) = 1),
keyed as (
    select comment_id, video_id, coalesce(likes, 0) as score, lower(trim(regexp_replace(author, '[\\s\\x{00A0}]+', ' ', 'g'))) as who from latest),
placed as (
    select comment_id, video_id, case when who is not null and who not in ('', 'anonymous')
        then row_number() over (partition by video_id, who order by score desc, comment_id) end as position from keyed)
"""
_WORDS = r"""
words as (select row_id, unnest(regexp_extract_all(lower(text), '\p{L}+')) as term from comments),
tf as (select row_id, term, count(*) as tf from words group by all),
df as (select term, count(*) as records, sum(tf)::bigint as occurrences from tf group by term)
"""

SQL = {
    "p1_found": f"with {_LATEST} select comment_id from placed where position > 5",
    "p1_kept": f"with {_LATEST} select comment_id, video_id, position from placed where position is null or position <= 5",
    "p4_found": f"with {_WORDS} select row_id, term from tf join df using (term) where regexp_full_match(term, '[a-z]{{6,}}') and tf >= 3 and records between 2 and 12",
    "p4_scores": f"""with {_WORDS},
        size as (select c.row_id, count(w.term) as size from comments c left join words w on w.row_id = c.row_id group by c.row_id),
        stats as (select count(*) as n, avg(size) as mean from size)
        select row_id, term, tf, round(ln(1 + (n - records + 0.5) / (records + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean)), 6) as score
        from tf join df using (term) join size using (row_id), stats""",
    "p5_found": f"with {_WORDS} select term, case when records <= 2 then 'rare' else 'common' end as mark from df where records <= 2 or records >= 0.1 * (select count(*) from comments)",
    "p5_counts": f"""with {_WORDS} select term, occurrences, records,
        case when records <= 2 then 'rare' when records >= 0.1 * (select count(*) from comments) then 'common' end as mark from df""",
}
