"""A deterministic sample with equal quotas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.operators.ordering import with_index


def stratified_sample(df: DataFrame, label_col: str, order_col: str, size: int = 250) -> DataFrame:
    """(order_col): all rows of a table of at most ``size``; else per class every n-th row in order up to size // classes.

    The step of a class is its rows // quota, at least 1. Places within a class come from one range sort by class and
    order, so that a class with most of the rows isn't one task; the classes' starts are one small table. A null label is
    a class of its own. There should be fewer classes than ``size``.
    """
    indexed = with_index(df.select(label_col, order_col), [F.col(label_col).asc(), F.col(order_col).asc()], "__index")
    classes = indexed.groupBy(F.col(label_col).alias("__label")).agg(F.min("__index").alias("__first"), F.count("*").alias("__n"))
    total, count = indexed.agg(F.count("*")).scalar(), classes.agg(F.count("*")).scalar()
    placed = indexed.join(classes, F.col(label_col).eqNullSafe(F.col("__label"))).withColumns({"__total": total, "__quota": F.floor(F.lit(size) / count)})
    at = F.col("__index") - F.col("__first")
    step = F.greatest(F.lit(1), F.floor(F.col("__n") / F.col("__quota")))
    chosen = (at % step == 0) & (F.floor(at / step) < F.col("__quota"))
    return placed.where((F.col("__total") <= size) | chosen).select(order_col).orderBy(order_col).limit(size)
