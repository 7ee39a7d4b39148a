"""Video ids out of URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hosts that are accepted.
HOSTS = ("youtube.com", "www.youtube.com", "m.youtube.com", "youtu.be")


def video_id(url: Column) -> Column:
    """The id in a URL of an accepted host: the first path segment of the short host, else the query value ``v``.

    An id has 6 to 20 letters, digits, ``_`` or ``-``. Anything else, text that is no URL included, gives null.
    """
    trimmed = F.trim(url)
    host = F.lower(F.try_parse_url(trimmed, F.lit("AUTHORITY")))
    path = F.split_part(F.regexp_replace(F.coalesce(F.try_parse_url(trimmed, F.lit("PATH")), F.lit("")), "^/+", ""), F.lit("/"), F.lit(1))
    found = F.when(host == "youtu.be", path).when(host.isin(*HOSTS), F.try_parse_url(trimmed, F.lit("QUERY"), F.lit("v")))
    return F.when(found.rlike("^[A-Za-z0-9_-]{6,20}$"), found)


_HOST = r"lower(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))"
SQL = f"""
select video_id, case when regexp_full_match(found, '[A-Za-z0-9_-]{{6,20}}') then found end as parsed from (
    select video_id, case
        when {_HOST} = 'youtu.be' then regexp_extract(trim(url), '^[^:]+://[^/?#]*/+([^/?#]*)', 1)
        when {_HOST} in ('youtube.com', 'www.youtube.com', 'm.youtube.com', 'youtu.be') then regexp_extract(trim(url), '[?&]v=([^&#]*)', 1) end as found
    from FROM_TABLE)"""
