"""The query for new and changed comments per run, and its SQL."""

from pyspark.sql import DataFrame, SparkSession

from murmur.operators.incremental import hand_on


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """In leases of 20 runs, each of which reads only its own rows and the states that those before it left."""
    return hand_on(spark.read.parquet(f"{folder}/comments.parquet"), spark.read.parquet(f"{folder}/fetch_runs.parquet"), most=20)


QUERIES = {"p7_found": p7_found}
SQL = {
    "p7_found": """
    with good as (select run_id from fetch_runs where lower(trim(status)) = 'succeeded'),
    assigned as (
        select c.comment_id, (select min(g.run_id) from good g where g.run_id >= c.run_id) as run_id, greatest(c.published_at, c.updated_at) as version
        from comments c),
    batches as (select comment_id, run_id, max(version) as version from assigned where run_id is not null group by all),
    seen as (
        select *, count(*) over past as earlier, max(version) over past as greatest from batches
        window past as (partition by comment_id order by run_id rows between unbounded preceding and 1 preceding))
    select run_id, comment_id from seen where earlier = 0 or version > greatest
    """
}
