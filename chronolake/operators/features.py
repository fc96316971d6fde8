"""Scalar features of whole series: nine basic statistics and nineteen shape features.

Each family is one grouped aggregate over at most one sort by (series, t); families share their
partitioning by series, so joining them moves nothing again.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolake.operators.layouts import by_series, spread, whole_series

BASIC = ["mean", "median", "std", "max", "min", "q5", "q25", "q75", "q95"]


def pearson(x: Column, y: Column) -> Column:
    """Correlation as an aggregate; null where one side is constant."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def basic(long: DataFrame, keys: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """mean, median, std (population), max, min, q5, q25, q75, q95 (linear)."""
    return long.groupBy(*keys).agg(*_basic()).select(*keys, *BASIC)


def _quantiles() -> Column:
    """The median and q5, q25, q75, q95 from one set of counted values."""
    return F.percentile("value", F.array(*map(F.lit, (0.5, 0.05, 0.25, 0.75, 0.95))))


def _basic() -> list[Column]:
    q = [F.get(_quantiles(), F.lit(i)).alias(name) for i, name in enumerate(("median", "q5", "q25", "q75", "q95"))]
    return [F.avg("value").alias("mean"), q[0], F.stddev_pop("value").alias("std"), F.max("value").alias("max"), F.min("value").alias("min"), *q[1:]]


def _moments() -> list[Column]:
    square = F.avg(F.col("value") * F.col("value"))
    return [
        F.skewness("value").alias("skewness"),
        F.kurtosis("value").alias("kurtosis"),
        F.regr_slope("value", F.col("t").cast("double")).alias("slope"),
        (F.get(_quantiles(), F.lit(3)) - F.get(_quantiles(), F.lit(2))).alias("iqr"),
        square.alias("energy"),
        (F.max("value") - F.min("value")).alias("ptp"),
        F.try_divide(F.max(F.abs("value")), F.sqrt(square)).alias("crest"),
    ]


def moments(long: DataFrame) -> DataFrame:
    """skewness and excess kurtosis (biased), slope on 0..n-1, iqr, energy, ptp, crest."""
    return long.groupBy("series_id").agg(*_moments())


def peaks(long: DataFrame) -> DataFrame:
    """series_id, t of the strict local maxima; a plateau counts once, at its middle; edges never do."""
    before = F.lag("value").over(by_series())
    turn = F.when(before.isNull() | (before != F.col("value")), 1).otherwise(0)
    runs = long.select("series_id", "t", "value", turn.alias("turn"))
    runs = runs.select("series_id", "t", "value", F.sum("turn").over(by_series()).alias("run"))
    runs = runs.groupBy("series_id", "run").agg(F.min("t").alias("a"), F.max("t").alias("b"), F.first("value").alias("value"))
    order = whole_series().orderBy("run")
    around = runs.select("series_id", "a", "b", "value", F.lag("value").over(order).alias("l"), F.lead("value").over(order).alias("r"))
    return around.where("value > l and value > r").select("series_id", F.floor((F.col("a") + F.col("b")) / 2).alias("t"))


def peak_features(long: DataFrame) -> DataFrame:
    """n_peaks, and mean_peak_distance (null under two peaks)."""
    found = peaks(long).groupBy("series_id").agg(F.count("*").alias("n"), F.min("t").alias("a"), F.max("t").alias("b"))
    every = long.select("series_id").distinct().join(found, "series_id", "left")
    distance = F.when(F.col("n") > 1, (F.col("b") - F.col("a")) / (F.col("n") - 1))
    return every.select("series_id", F.coalesce("n", F.lit(0)).alias("n_peaks"), distance.alias("mean_peak_distance"))


def sequence_features(long: DataFrame, more: list[Column] | None = None) -> DataFrame:
    """cross_rate, autocorrelation (circular, lag 1), mobility, complexity, petrosian, ema; and ``more`` aggregates of value
    and t in the same pass."""
    w, all_ = by_series(), whole_series()
    n = F.count("*").over(all_)
    rows = long.select(
        "series_id",
        "t",
        "value",
        n.alias("n"),
        F.lag("value").over(w).alias("p1"),
        F.lag("value", 2).over(w).alias("p2"),
        F.max_by("value", "t").over(all_).alias("last"),
        (F.col("value") > (F.min("value").over(all_) + F.max("value").over(all_)) / 2).alias("up"),
    )
    rows = rows.withColumn("was_up", F.lag("up").over(w))
    d1 = F.col("value") - F.col("p1")
    d0 = F.col("p1") - F.col("p2")
    span = F.greatest(F.lit(2), F.floor(F.col("n") / 10))
    weight = F.pow(1 - 2 / (span + 1), F.col("n") - 1 - F.col("t"))
    m2, m4, power = F.avg(d1 * d1), F.avg((d1 - d0) * (d1 - d0)), F.avg(F.col("value") * F.col("value"))
    count, turns = F.count("*"), F.count_if(d1 * d0 < 0)
    return rows.groupBy("series_id").agg(
        (F.count_if(F.col("up") != F.col("was_up")) / count).alias("cross_rate"),
        pearson(F.col("value"), F.coalesce("p1", "last")).alias("autocorrelation"),
        F.sqrt(F.try_divide(m2, power)).alias("mobility"),
        F.sqrt(F.try_divide(m4 * power, m2 * m2)).alias("complexity"),
        F.try_divide(F.log10(count), F.log10(count) + F.log10(count / (count + 0.4 * turns))).alias("petrosian"),
        (F.sum(weight * F.col("value")) / F.sum(weight)).alias("ema"),
        *(more or []),
    )


def entropy(long: DataFrame) -> DataFrame:
    """shannon: entropy in bits of the distribution of distinct values."""
    counts = long.groupBy("series_id", "value").agg(F.count("*").alias("k"))
    counts = counts.withColumn("p", F.col("k") / F.sum("k").over(whole_series()))
    return counts.groupBy("series_id").agg((-F.sum(F.col("p") * F.log2("p"))).alias("shannon"))


def benford(long: DataFrame) -> DataFrame:
    """benford: correlation of the shares of first significant digits 1 to 9 with Benford's."""
    text = F.abs("value").cast("decimal(24,6)").cast("string")
    digit = F.expr("try_cast(substring(trim(LEADING '0.' FROM d), 1, 1) AS INT)")
    counts = long.select("series_id", text.alias("d")).groupBy("series_id", digit.alias("digit")).agg(F.count("*").alias("k"))
    share = counts.groupBy("series_id").pivot("digit", list(range(1, 10))).agg(F.first("k"))
    pairs = F.explode(F.array(*[F.struct(F.lit(d).alias("d"), F.coalesce(F.col(str(d)), F.lit(0)).alias("k")) for d in range(1, 10)]))
    rows = share.select("series_id", pairs.alias("x")).select("series_id", F.log10(1 + 1 / F.col("x.d")).alias("e"), F.col("x.k").cast("double").alias("k"))
    return rows.groupBy("series_id").agg(pearson(F.col("e"), F.col("k")).alias("benford"))


def moving_median(long: DataFrame) -> DataFrame:
    """moving_median: mean of the medians of all windows of max(2, n // 10) values; one value where there is none.

    A running median over each series' values, which one task holds."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        v = group["value"].to_numpy()[np.argsort(group["t"].to_numpy())]
        span = max(2, len(v) // 10)
        if len(v) < span:
            medians = v
        elif len(v) * span < 1 << 20:
            medians = np.median(np.lib.stride_tricks.sliding_window_view(v, span), axis=1)
        else:
            medians = pd.Series(v).rolling(span).median().to_numpy()[span - 1 :]
        return pd.DataFrame({"series_id": group["series_id"].iloc[:1], "moving_median": [medians.mean()]})

    kind = long.schema["series_id"].dataType.simpleString()
    return spread(long.select("series_id", "t", "value")).groupBy("series_id").applyInPandas(run, f"series_id {kind}, moving_median double")


def distribution_entropy(long: DataFrame) -> DataFrame:
    """base_entropy: natural entropy of the values as shares of their sum (positive shares count); below: values under
    0.01."""
    p = F.try_divide(F.col("value"), F.sum("value").over(whole_series()))
    rows = long.select("series_id", "value", p.alias("p"))
    return rows.groupBy("series_id").agg((-F.sum(F.when(F.col("p") > 0, F.col("p") * F.ln("p")))).alias("base_entropy"), F.count_if(F.col("value") < 0.01).alias("below"))


def all_features(long: DataFrame) -> DataFrame:
    """The nine basic statistics and nineteen further columns of every series; nulls and NaN are 0."""
    parts = [sequence_features(long, [*_basic(), *_moments()]), peak_features(long), entropy(long), benford(long), moving_median(long)]
    both = reduce(lambda a, b: a.join(b, "series_id"), parts)
    clean = [F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(c) for c in both.columns if c != "series_id"]
    return both.select("series_id", *clean)
