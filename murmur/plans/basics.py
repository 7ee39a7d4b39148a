"""Queries for normalisation, sources, sentiment, keywords, n-grams and trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur import lexicons
from murmur.functions import text as tx
from murmur.operators import keywords, ngrams, sampling, sentiment
from murmur.plans import sqltext as q
from murmur.sources import demo, urls
from murmur.storage import spread


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table; comments, on which all the work in the row is done, spread over the cores if the file has few parts."""
    rows = spark.read.parquet(f"{folder}/{name}.parquet")
    return spread(rows) if name == "comments" else rows


def stop_words(spark: SparkSession, folder: str) -> list[str]:
    return lexicons.words(table(spark, folder, "stop_word"))


def polarity_of(spark: SparkSession, folder: str, tokens: Column) -> Column:
    return sentiment.polarity(tokens, lexicons.pairs(table(spark, folder, "polarity"), "word", "polarity"))


def labelled(spark: SparkSession, folder: str) -> DataFrame:
    """comments with tokens, polarity and label."""
    rows = table(spark, folder, "comments").withColumn("tokens", F.coalesce(tx.tokenize_surface(F.col("text"), stop_words(spark, folder)), F.array().cast("array<string>")))
    rows = rows.withColumn("polarity", polarity_of(spark, folder, F.col("tokens")))
    return rows.withColumn("label", sentiment.label(F.col("polarity")))


def with_sentences(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "comments").withColumn("sentences", tx.sentence_tokens(F.col("text"), stop_words(spark, folder)))


def _joined(tokens: Column) -> Column:
    return F.array_join(tokens, " ")


def clean_text(spark, folder):
    return table(spark, folder, "comments").select("row_id", tx.clean_text(F.col("text")).alias("clean"))


def tokenize_full(spark, folder):
    return table(spark, folder, "comments").select("row_id", _joined(tx.tokenize_full(F.col("text"))).alias("tokens"))


def tokenize_surface(spark, folder):
    return table(spark, folder, "comments").select("row_id", _joined(tx.tokenize_surface(F.col("text"), stop_words(spark, folder))).alias("tokens"))


def sentence_tokens(spark, folder):
    return with_sentences(spark, folder).select("row_id", F.array_join(F.transform("sentences", lambda s: F.array_join(s, " ")), " ‖ ").alias("sentences"))


def named_tokens(spark, folder):
    return table(spark, folder, "comments").select("row_id", _joined(tx.tokenize_named(F.col("text"))).alias("tokens"))


def duplicate_rate(spark, folder):
    keys = table(spark, folder, "comments").select(tx.duplicate_key(F.col("text")).alias("key"))
    return keys.groupBy("key").agg(F.count("key").alias("n")).agg(
        F.sum("n").alias("texts"), F.count("key").alias("distinct_texts"), F.coalesce(F.round((F.sum("n") - F.count("key")) * 100 / F.sum("n"), 1), F.lit(0.0)).alias("rate")
    )


def url_parse(spark, folder):
    return table(spark, folder, "videos").select("video_id", urls.video_id(F.col("url")).alias("parsed"))


def video_titles(spark, folder):
    comments, videos = table(spark, folder, "comments"), table(spark, folder, "videos")
    return comments.select("row_id", "video_id").join(videos.select("video_id", "title"), "video_id", "left").select("row_id", F.coalesce("title", F.lit("Unknown Video")).alias("title"))


def demo_metrics(spark, folder):
    return demo.metrics(table(spark, folder, "videos"))


def _feed(spark, folder):
    return labelled(spark, folder).select(
        "row_id", "label", F.substring("text", 1, 200).alias("text"), F.coalesce(F.date_format("published_at", "HH:mm"), F.lit("")).alias("time"), F.coalesce("likes", F.lit(0)).cast("string").alias("likes"),
        F.array_join(F.transform(F.slice(F.filter(F.split(F.coalesce("author", F.lit("Anonymous")), " "), lambda w: w != ""), 1, 2), lambda w: F.upper(F.left(w, F.lit(1)))), "").alias("initials"),
    )


def comment_feed(spark, folder):
    return _feed(spark, folder).orderBy("row_id").limit(20)


def feed_page(spark, folder):
    return _feed(spark, folder).where("label = 'positive'").orderBy("row_id").offset(5).limit(5)


def sentiment_label(spark, folder):
    return labelled(spark, folder).select("row_id", F.round("polarity", 6).alias("polarity"), "label")


def sentiment_mix(spark, folder):
    return sentiment.sentiment_mix(labelled(spark, folder).select("label"))


def headline_metrics(spark, folder):
    return sentiment.headline_metrics(labelled(spark, folder))


def summary_candidates(spark, folder):
    rows = labelled(spark, folder)
    return sentiment.summary_candidates(rows, F.col("polarity")).select("row_id", "score", "sentences")


def summary(spark, folder):
    return sentiment.summarize(labelled(spark, folder), F.col("polarity"))


def tfidf_keywords(spark, folder):
    tokens = F.regexp_extract_all(tx.clean_text(F.col("text")), F.lit(r"([\p{L}\p{N}]{2,})"), F.lit(1))
    stop = stop_words(spark, folder)
    return keywords.tfidf_keywords(table(spark, folder, "comments").where("text is not null"), F.filter(tokens, lambda t: ~t.isin(stop)))


def simple_keywords(spark, folder):
    return keywords.simple_keywords(table(spark, folder, "comments"), tx.clean_text(F.col("text")))


def block_topics(spark, folder):
    return keywords.block_topics(labelled(spark, folder), F.col("tokens"))


def lda_topics(spark, folder):
    return keywords.lda_topics(labelled(spark, folder), F.col("tokens"))


def top_unigrams(spark, folder):
    return ngrams.top_ngrams(with_sentences(spark, folder), F.col("sentences"), 1)


def top_bigrams(spark, folder):
    return ngrams.top_ngrams(with_sentences(spark, folder), F.col("sentences"), 2)


def top_trigrams(spark, folder):
    return ngrams.top_ngrams(with_sentences(spark, folder), F.col("sentences"), 3)


def ngram_summary(spark, folder):
    return ngrams.ngram_summary(with_sentences(spark, folder), F.col("sentences"))


def phrase_coverage(spark, folder):
    return ngrams.phrase_coverage(with_sentences(spark, folder), F.col("sentences"))


def _timed(df: DataFrame) -> DataFrame:
    return df.withColumn("at", F.coalesce("published_at", "updated_at"))


def time_buckets(spark, folder):
    return ngrams.time_buckets(_timed(table(spark, folder, "comments")), "at").select("row_id", "bucket")


def sequential_buckets(spark, folder):
    return ngrams.sequential_buckets(table(spark, folder, "comments").select("row_id"), "row_id").select("row_id", "bucket")


def _trends(spark, folder):
    rows = labelled(spark, folder).withColumn("sentences", tx.sentence_tokens(F.col("text"), stop_words(spark, folder)))
    return ngrams.phrase_trends(ngrams.time_buckets(_timed(rows), "at"), F.col("sentences"), F.col("label"))


def phrase_trends(spark, folder):
    return _trends(spark, folder).withColumn("series", F.array_join(F.col("series").cast("array<string>"), ","))


def trend_lift(spark, folder):
    return ngrams.trend_lift(_trends(spark, folder))


def trend_chart(spark, folder):
    positive = sentiment.headline_metrics(labelled(spark, folder)).select("positive").scalar()
    return ngrams.trend_chart(_trends(spark, folder), positive)


def corpus_trends(spark, folder):
    """By time where every comment has one, else by place."""
    rows = labelled(spark, folder).withColumn("sentences", tx.sentence_tokens(F.col("text"), stop_words(spark, folder)))
    trends = ngrams.phrase_trends(ngrams.corpus_buckets(rows, "published_at", "row_id"), F.col("sentences"), F.col("label"))
    return trends.withColumn("series", F.array_join(F.col("series").cast("array<string>"), ","))


def stratified_sample(spark, folder):
    return sampling.stratified_sample(labelled(spark, folder).select("row_id", "label"), "label", "row_id")


QUERIES = {f.__name__: f for f in (
    clean_text, tokenize_full, tokenize_surface, sentence_tokens, named_tokens, duplicate_rate, url_parse, video_titles, demo_metrics, comment_feed, feed_page, sentiment_label, sentiment_mix, headline_metrics, summary_candidates, summary, tfidf_keywords,
    simple_keywords, block_topics, lda_topics, top_unigrams, top_bigrams, top_trigrams, ngram_summary, phrase_coverage, time_buckets, sequential_buckets, phrase_trends, trend_lift, corpus_trends, trend_chart, stratified_sample,
)}

_FEED = f"""with {q.BASE}, feed as (
    select row_id, label, substring(text, 1, 200) as text, coalesce(strftime(timezone('UTC', published_at), '%H:%M'), '') as time, coalesce(likes, 0)::varchar as likes,
        array_to_string(list_transform(list_filter(string_split(coalesce(author, 'Anonymous'), ' '), lambda w: w <> '')[1:2], lambda w: upper(w[1:1])), '') as initials from base)"""
_TIMED = """timed as (select row_id, coalesce(published_at, updated_at) as t_at from comments),
ends as (select min(epoch_us(t_at)) as low, max(epoch_us(t_at)) as high from timed),
bucketed as (select row_id, least(7, floor((epoch_us(t_at) - low)::double / case when high > low then high - low else 1 end * 8))::bigint as bucket from timed, ends where t_at is not null)"""
_TRENDS = f"""{q.BASE}, {q.SENT.split(',', 1)[1].strip()}, {q.grams(2)}, {q.counted(2)}, {q.top(2, 4)}, {_TIMED},
leaders as (select phrase, row_number() over (order by count desc, documents desc, phrase) as rank from t2),
cells as (
    select rank, phrase, bucket, count(*) as n, count(*) filter (label = 'positive') as pos, count(*) filter (label = 'negative') as neg
    from (select distinct row_id, phrase from g2) join leaders using (phrase) join bucketed using (row_id) join base using (row_id) group by all),
grid as (select rank, phrase, b as bucket from leaders, range(0, 8) r(b)),
dense as (select g.rank, g.phrase, g.bucket, coalesce(n, 0) as n, coalesce(pos, 0) as pos, coalesce(neg, 0) as neg from grid g left join cells c on c.phrase = g.phrase and c.bucket = g.bucket),
trends as (
    select rank, phrase, sum(n)::bigint as documents, list(n order by bucket) as series, sum(pos) as pos, sum(neg) as neg,
        (sum(n) filter (bucket >= 6) - sum(n) filter (bucket < 2))::double / greatest(sum(n) filter (bucket < 2), 1) as m
    from dense group by rank, phrase)"""
_ALL_TIMED = """ends as (select min(epoch_us(published_at)) as low, max(epoch_us(published_at)) as high, count(*) = count(published_at) as complete, count(*) as n from comments),
placed as (select row_id, published_at, row_number() over (order by row_id) - 1 as i from comments),
bucketed as (select row_id, case when complete then least(7, floor((epoch_us(published_at) - low)::double / case when high > low then high - low else 1 end * 8))::bigint else least(7, i // greatest(1, n // 8))::bigint end as bucket from placed, ends)"""
_ALL_TRENDS = _TRENDS.replace(_TIMED, _ALL_TIMED)
_METRICS = """metrics as (
    select comments, round_even(p * 100.0 / greatest(comments, 1), 0)::bigint as positive, round_even(n * 100.0 / greatest(comments, 1), 0)::bigint as negative
    from (select count(*) as comments, count(*) filter (label = 'positive') as p, count(*) filter (label = 'negative') as n from base))"""
_HOURS = ", ".join(f"({i}, '{h}', {o})" for i, (h, o) in enumerate(zip(ngrams.CHART_HOURS, ngrams.CHART_OFFSETS, strict=True)))


def _top(n: int) -> str:
    return f"with {q.SENT}, {q.grams(n)}, {q.counted(n)}, {q.top(n)} select phrase, count, documents, round_even(count * 100.0 / max(count) over (), 0)::bigint as share from t{n}"


SQL = {
    "clean_text": f"select row_id, {q.clean('text')} as clean from comments",
    "tokenize_full": f"select row_id, array_to_string({q.full('text')}, ' ') as tokens from comments",
    "tokenize_surface": f"with {q.STOP} select row_id, array_to_string({q.surface('text')}, ' ') as tokens from comments, stopping",
    "sentence_tokens": f"with {q.STOP} select row_id, array_to_string(list_transform({q.sentences('text')}, lambda s: array_to_string(s, ' ')), ' ‖ ') as sentences from comments, stopping",
    "named_tokens": f"select row_id, array_to_string({q.named('text')}, ' ') as tokens from comments",
    "duplicate_rate": f"""with k as (select trim(regexp_replace(lower(text), '{q.BLANK}+', ' ', 'g')) as k from comments)
        select count(k) as texts, count(distinct k) as distinct_texts, round((count(k) - count(distinct k)) * 100.0 / count(k), 1) as rate from k where k <> ''""",
    "url_parse": urls.SQL.replace("FROM_TABLE", "videos"),
    "video_titles": "select c.row_id, coalesce(v.title, 'Unknown Video') as title from comments c left join videos v using (video_id)",
    "demo_metrics": demo.SQL,
    "comment_feed": f"{_FEED} select * from feed order by row_id limit 20",
    "feed_page": f"{_FEED} select * from feed where label = 'positive' order by row_id limit 5 offset 5",
    "sentiment_label": f"with {q.BASE} select row_id, round(polarity, 6) as polarity, label from base",
    "sentiment_mix": f"""with {q.BASE} select l.label, count(b.row_id) as comments, round_even(count(b.row_id) * 100.0 / (select count(*) from base), 0)::bigint as percent
        from (values ('positive'), ('neutral'), ('negative')) l(label) left join base b using (label) group by l.label""",
    "headline_metrics": f"with {q.BASE}, {_METRICS} select *, 100 - positive - negative as neutral, round(comments / 100.0, 1)::double as engagement from metrics",
    "summary_candidates": f"""with {q.BASE}, s as (select row_id, polarity, len(list_filter(list_transform(string_split_regex(text, '[.!?…]+|\\n+'), lambda p: trim(p)), lambda p: p <> '')) as n from base where text is not null)
        select row_id, round(n + polarity, 6) as score, n as sentences from s order by round(n + polarity, 6) desc, row_id limit 9""",
    "summary": f"""with {q.BASE}, c as (select row_id, polarity, text, len(list_filter(list_transform(string_split_regex(text, '[.!?…]+|\\n+'), lambda p: trim(p)), lambda p: p <> '')) as n from base where text is not null),
        best as (select text, row_id, round(n + polarity, 6) as score from c order by round(n + polarity, 6) desc, row_id limit 9),
        j as (select coalesce(string_agg(text, ' ' order by score desc, row_id), '') as whole from best),
        k as (select whole, list_filter(list_transform(string_split_regex(whole, '[.!?…]+|\\n+'), lambda p: trim(p)), lambda p: p <> '') as s from j)
        select case when trim(whole) = '' then 'No comments to summarize.' when len(s) = 0 then left(whole, 300) else array_to_string(s[1:3], '. ') end as summary from k""",
    "tfidf_keywords": f"""with {q.STOP}, w as (select row_id, unnest(list_filter(regexp_extract_all({q.clean('text')}, '[\\p{{L}}\\p{{N}}]{{2,}}'), lambda t: not list_contains(stop, t))) as term from comments, stopping where text is not null),
        tf as (select row_id, term, count(*) as tf from w group by all),
        voc as (select term, sum(tf) as c, count(*) as df from tf group by term order by c desc, term limit 500),
        x as (select row_id, term, tf * (ln((1.0 + (select count(*) from comments where text is not null)) / (1 + df)) + 1) as w from tf join voc using (term)),
        nrm as (select row_id, sqrt(sum(w * w)) as norm from x group by row_id),
        s as (select term, sum(w / norm) as total from x join nrm using (row_id) group by term order by round(sum(w / norm), 6) desc, term limit 8)
        select term, round(total * 100 / max(total) over ())::bigint as weight from s""",
    "simple_keywords": f"with w as (select unnest(string_split({q.clean('text')}, ' ')) as term from comments) select term, count(*) as count from w where length(term) > 2 group by term order by count desc, term limit 8",
    "block_topics": f"""with {q.BASE}, w as (select unnest(tokens) as term from base), t as (select term, count(*) as c from w group by term order by c desc, term limit 20),
        r as (select term, row_number() over (order by c desc, term) as rn from t)
        select ((rn - 1) // 5)::bigint as topic, string_agg(term, ' ' order by rn) as words from r group by 1""",
    "top_unigrams": _top(1),
    "top_bigrams": _top(2),
    "top_trigrams": _top(3),
    "ngram_summary": f"""with {q.SENT} select count(distinct row_id) as documents, (sum(len(s)) + count(*) - count(distinct row_id))::bigint as total_tokens,
        sum(len(s) + greatest(len(s) - 1, 0) + greatest(len(s) - 2, 0))::bigint as total_grams from sent""",
    "phrase_coverage": f"""with {q.SENT}, {q.grams(2)}, {q.counted(2)}, {q.top(2)}
        select round((select count(distinct row_id) from g2 where phrase in (select phrase from t2)) * 100.0 / (select count(distinct row_id) from sent), 1) as coverage""",
    "time_buckets": f"with {_TIMED} select row_id, bucket from bucketed",
    "sequential_buckets": "select row_id, least(7, (row_number() over (order by row_id) - 1) // greatest(1, (select count(*) from comments) // 8))::bigint as bucket from comments",
    "phrase_trends": f"""with {_TRENDS} select rank, phrase, documents as count, documents, array_to_string(series, ',') as series, round(m, 2) as momentum,
        case when m > 0.2 then 'rising' when m < -0.2 then 'cooling' else 'steady' end as direction,
        case when pos = 0 and neg = 0 then 'neutral' when pos >= 2 * neg then 'positive' when neg >= 2 * pos then 'negative' else 'mixed' end as stance from trends""",
    "trend_lift": f"with {_TRENDS} select rank, phrase, round((series[-1] - series[1]) * 100.0 / nullif(series[1], 0), 1) as lift from trends",
    "corpus_trends": f"""with {_ALL_TRENDS} select rank, phrase, documents as count, documents, array_to_string(series, ',') as series, round(m, 2) as momentum,
        case when m > 0.2 then 'rising' when m < -0.2 then 'cooling' else 'steady' end as direction,
        case when pos = 0 and neg = 0 then 'neutral' when pos >= 2 * neg then 'positive' when neg >= 2 * pos then 'negative' else 'mixed' end as stance from trends""",
    "trend_chart": f"""with {_TRENDS}, {_METRICS}, slots(i, time, off) as (values {_HOURS}),
        lead as (select row_number() over (order by documents desc, rank) - 1 as i, series from trends),
        p as (select s.i, s.time, s.off, coalesce(l.series[s.i + 1], 0) as v from slots s left join lead l on l.i = s.i)
        select time, case when max(v) over () > 0 then round_even(positive * (0.72 + 0.45 * v / max(v) over ()), 0)::bigint else positive + off end as value from p, metrics""",
    "stratified_sample": f"""with {q.BASE}, f as (select label, row_number() over (partition by label order by row_id) - 1 as i, count(*) over (partition by label) as n, (select count(*) from base) as total,
            (select count(distinct label) from base) as classes, row_id from base),
        p as (select row_id, i, n, total, 250 // classes as quota, greatest(1, n // (250 // classes)) as step from f)
        select row_id from p where total <= 250 or (i % step = 0 and i // step < quota) order by row_id limit case when (select count(*) from base) <= 250 then 250 else 250 end""",
}
