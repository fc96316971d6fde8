"""What the two vector searches share: usable vectors, blocks of rows, the best k of each query."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def usable(table: DataFrame, zero_too: bool) -> DataFrame:
    """vec_id, row, times, embedding of the rows that take part: an id, and a vector of finite components only
    (``zero_too``: also if all are zero). Rows that repeat both are one row with a number, times; ``row``, a hash
    of both, tells rows of one id apart."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    keep = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite
    if not zero_too:
        keep = keep & F.exists("embedding", lambda x: x != 0)
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(keep).groupBy("vec_id", "embedding").agg(F.count("*").alias("times"))
    return rows.select("vec_id", F.xxhash64("vec_id", "embedding").alias("row"), "times", "embedding")


def matrix(column: pd.Series, dims: int, dtype: str) -> np.ndarray:
    """Vectors as rows; shorter ones are padded with zeros."""
    out = np.zeros((len(column), dims), dtype)
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def best(hits: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest scores of each query (query_id, query_row), ties to the
    smaller id. A hit counts ``times``, a query's ranks come ``asked`` times."""
    order = Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id")
    each = hits.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least("times", F.lit(k)))))
    ranked = each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "asked"))).select("query_id", "rank", "vec_id", "score")


def top_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    return np.lexsort((ids, -scores))[:k]
