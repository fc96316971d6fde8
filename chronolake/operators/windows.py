"""Windows of series: sizes, trajectory windows, pages, supervised pairs, averages back to points."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolake.operators.layouts import by_series, to_panel, whole_series


def window_size(n: Column, percent: float | None = None, explicit: int | None = None) -> Column:
    """A detector's window length for series of n values: given, a percentage, or a tenth, at least 8; never
    more than n; n under 4: n. Shares are decimals, so that halves are halves; they go to the even number."""
    if explicit is not None:
        size = F.greatest(F.lit(2), F.least(F.lit(explicit), n))
    elif percent is not None:
        size = F.greatest(F.lit(2), F.least(F.bround(n * (Decimal(str(percent)) / 100)).cast("int"), n))
    else:
        size = F.least(F.greatest(F.lit(8), F.bround(n * Decimal("0.1")).cast("int")), n)
    return F.when(n < 4, F.greatest(F.lit(1), n)).otherwise(size)


def stride_of(size: Column, explicit: int | None = None) -> Column:
    """A detector's stride: given (at least 1), else a quarter of the window."""
    return F.lit(max(1, explicit)) if explicit is not None else F.greatest(F.lit(1), F.floor(size / 4).cast("int"))


def trajectory_length(n: Column, size: int | None = None) -> Column:
    """Window length of a trajectory matrix: size - 1, else 0.35 n (a decimal, half to even); n // 3 unless 2 <= it <= n / 2."""
    raw = F.lit(size - 1) if size is not None else F.bround(n * Decimal("0.35")).cast("int")
    return F.when((raw < 2) | (raw > n / 2), F.floor(n / 3).cast("int")).otherwise(raw)


def sliding(long: DataFrame, width: int, stride: int) -> DataFrame:
    """series_id, window_id, start, end (exclusive), t, value: a row for each point of each full window.

    A point explodes into the windows that cover it; no window is ever gathered in one row."""
    n = F.count("*").over(whole_series())
    rows = long.select("series_id", "t", "value", n.alias("n"))
    first = F.greatest(F.lit(0), F.ceil((F.col("t") - width + 1) / stride))
    last = F.least(F.floor(F.col("t") / stride), F.floor((F.col("n") - width) / stride))
    ids = F.when(first <= last, F.sequence(first, last))
    out = rows.select("series_id", "t", "value", F.explode(ids).alias("window_id"))
    return out.select("series_id", "window_id", (F.col("window_id") * stride).alias("start"), (F.col("window_id") * stride + width).alias("end"), "t", "value")


def window_sums(points: DataFrame) -> DataFrame:
    """start, end, first, last, sum of each window of ``sliding``."""
    return points.groupBy("series_id", "window_id").agg(
        F.first("start").alias("start"),
        F.first("end").alias("end"),
        F.min_by("value", "t").alias("first"),
        F.max_by("value", "t").alias("last"),
        F.sum("value").alias("sum"),
    )


def window_statistics(points: DataFrame) -> DataFrame:
    """mean, std (population), min, max, last - first of each window."""
    return points.groupBy("series_id", "window_id").agg(
        F.first("start").alias("start"),
        F.first("end").alias("end"),
        F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        (F.max_by("value", "t") - F.min_by("value", "t")).alias("trend"),
    )


def gap_fractions(points: DataFrame, most: float = 0.5) -> DataFrame:
    """gap_fraction (the share of missing values) of each window of ``sliding``, and valid: at most ``most``."""
    share = F.avg(F.when(F.col("value").isNull(), 1.0).otherwise(0.0))
    return points.groupBy("series_id", "window_id").agg(share.alias("gap_fraction"), (share <= most).alias("valid"))


def pages(long: DataFrame, width: int) -> DataFrame:
    """Blocks of ``width`` values that don't overlap, as rows of ``sliding``; a partial last one is dropped."""
    return sliding(long, width, width)


def supervised(long: DataFrame, width: int, horizon: int, stride: int = 1) -> DataFrame:
    """series_id, window_id, x (the window), y (the ``horizon`` values after it)."""
    panel = to_panel(long).withColumn("n", F.size("values"))
    top = F.floor((F.col("n") - width - horizon) / stride).cast("int")
    ids = F.when(top >= 0, F.sequence(F.lit(0), top))
    rows = panel.select("series_id", "values", F.explode(ids).alias("window_id"))
    at = F.col("window_id") * stride + 1
    return rows.select("series_id", F.col("window_id").cast("long").alias("window_id"), F.slice("values", at, F.lit(width)).alias("x"), F.slice("values", at + width, F.lit(horizon)).alias("y"))


def points_of(scored: DataFrame, long: DataFrame, score: str) -> DataFrame:
    """series_id, t, score: the mean over the windows that cover each point of ``long``; 0 where none does."""
    each = scored.select("series_id", F.explode(F.sequence("start", F.col("end") - 1)).alias("t"), F.col(score).alias("s"))
    mean = each.groupBy("series_id", "t").agg(F.avg("s").alias("s"))
    return long.select("series_id", "t").join(mean, ["series_id", "t"], "left").select("series_id", "t", F.coalesce("s", F.lit(0.0)).alias("score"))


def diagonal_average(points: DataFrame) -> DataFrame:
    """Windows back to a series: the mean of what the windows hold for each t."""
    return points.groupBy("series_id", "t").agg(F.avg("value").alias("value"))


def piecewise_means(long: DataFrame, pieces: int) -> DataFrame:
    """series_id, piece, value: means of ``pieces`` stretches of each series, of lengths that differ by one at most."""
    n = F.count("*").over(whole_series())
    rows = long.select("series_id", "value", F.floor(F.col("t") * pieces / n).alias("piece"))
    return rows.groupBy("series_id", "piece").agg(F.avg("value").alias("value"))


def lag_table(long: DataFrame, lags: int, horizon: int) -> DataFrame:
    """series_id, t, lag_1 ..., lead_1 ...: complete rows only."""
    w = by_series()
    back = [F.lag("value", i).over(w).alias(f"lag_{i}") for i in range(1, lags + 1)]
    ahead = [F.lead("value", i).over(w).alias(f"lead_{i}") for i in range(1, horizon + 1)]
    return long.select("series_id", "t", "value", *back, *ahead).dropna()
