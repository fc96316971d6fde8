"""Layouts: L (long: series_id, t, value), P (panel: one array a series), W (one array a window).

Every operator of the package takes and gives DataFrames in these layouts, lazily. Series are the unit of
partitioning: windows and groups are always by ``series_id`` (and channel, where there is one).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def to_long(events: DataFrame, series: str, order: list[str], value: str) -> DataFrame:
    """series_id, t (0, 1, ... in the order of ``order``), ts (the first of ``order``), value."""
    place = Window.partitionBy(series).orderBy(*order)
    t = (F.row_number().over(place) - 1).cast("long")
    return events.select(F.col(series).alias("series_id"), t.alias("t"), F.col(order[0]).alias("ts"), F.col(value).cast("double").alias("value"))


def to_panel(long: DataFrame) -> DataFrame:
    """series_id, values: the series as an array in order of t."""
    pairs = F.array_sort(F.collect_list(F.struct("t", "value")))
    return long.groupBy("series_id").agg(pairs.alias("p")).select("series_id", F.transform("p", lambda x: x["value"]).alias("values"))


def from_panel(panel: DataFrame, key: str = "series_id") -> DataFrame:
    """The inverse of ``to_panel``."""
    return panel.select(F.col(key).alias("series_id"), F.posexplode("values").alias("t", "value")).withColumn("t", F.col("t").cast("long"))


def finite_or_zero(c: Column) -> Column:
    """Null, NaN and infinite values as 0."""
    bad = c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return F.when(bad, F.lit(0.0)).otherwise(c)


def cut(long: DataFrame, start: int, stop: int) -> DataFrame:
    """Elements ``start`` <= t < ``stop`` of every series, counted anew."""
    return long.where((F.col("t") >= start) & (F.col("t") < stop)).withColumn("t", F.col("t") - start)


def spread(long: DataFrame) -> DataFrame:
    """``long`` with each series in one of as many partitions as the session shuffles to. For work that is heavy for its
    bytes: adaptive execution would put small series together by size, down to one task."""
    return long.repartition(int(long.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), "series_id")


def by_series() -> Window:
    return Window.partitionBy("series_id").orderBy("t")


def whole_series() -> Window:
    return Window.partitionBy("series_id")
