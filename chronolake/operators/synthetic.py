"""Series made by rule: waves, walks, autoregressions, noise, and labelled sets of them.

Randomness is a hash of seed, series and place, so that a series is the same on every run and partitioning."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronolake.operators.layouts import by_series, spread


def places(spark: SparkSession, n_series: int, length: int) -> DataFrame:
    """series_id, t."""
    t = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(length - 1).cast("long")))
    return spark.range(n_series).select(F.col("id").alias("series_id"), t.alias("t"))


def uniform(seed: int, *keys: str) -> Column:
    """Between 0 and 1, both excluded."""
    return (F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 40)) + 0.5) / float(1 << 40)


def normal(seed: int, *keys: str) -> Column:
    """Standard normal, from two uniform values."""
    return F.sqrt(-2 * F.ln(uniform(seed, *keys))) * F.cos(2 * math.pi * uniform(seed + 1_000_003, *keys))


def make(spark: SparkSession, kind: str, n_series: int, length: int, seed: int = 0, size: float = 1.0, period: float = 24.0, order: tuple[float, ...] = (0.7,), width: int = 5) -> DataFrame:
    """``at`` the places of ``n_series`` series of ``length``, with noise and phases from hashes."""
    noise, phase = size * normal(seed, "series_id", "t"), 2 * math.pi * uniform(seed, "series_id")
    return at(places(spark, n_series, length).select("series_id", "t", noise.alias("noise"), phase.alias("phase")), kind, size, period, order, width)


def at(rows: DataFrame, kind: str, size: float = 1.0, period: float = 24.0, order: tuple[float, ...] = (0.7,), width: int = 5) -> DataFrame:
    """series_id, t, value at the places of ``rows`` (series_id, t, noise, phase), which may be those of a given table:
    ``sin`` (of ``size``, without noise), ``random_walk``, ``auto_regression`` (weights ``order`` of the values before),
    ``smooth_normal`` (noise under a centred mean of ``width``) or ``quadratic`` (noise under a centred local parabola of
    ``width``, by its closed weights)."""
    if kind == "sin":
        return rows.select("series_id", "t", (size * F.sin(2 * math.pi * F.col("t") / period + F.col("phase"))).alias("value"))
    rows = rows.select("series_id", "t", F.col("noise").alias("value"))
    if kind == "random_walk":
        return rows.select("series_id", "t", F.sum("value").over(by_series().rowsBetween(Window.unboundedPreceding, 0)).alias("value"))
    half = width // 2
    if kind == "smooth_normal":
        return rows.select("series_id", "t", F.avg("value").over(by_series().rowsBetween(-half, half)).alias("value"))
    if kind == "quadratic":
        k = np.arange(-half, half + 1)
        weights = np.linalg.pinv(np.stack([k**0, k, k**2], axis=1))[0]
        inside = [F.coalesce(F.lag("value", int(-d)).over(by_series()), F.col("value")) * float(w) for d, w in zip(k, weights, strict=True)]
        return rows.select("series_id", "t", sum(inside[1:], inside[0]).alias("value"))
    if kind == "auto_regression":

        def run(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values("t")
            out = group["value"].to_numpy("float64").copy()
            for i in range(len(out)):
                out[i] += sum(w * out[i - 1 - j] for j, w in enumerate(order) if i > j)
            return group.assign(value=out)

        kinds = {c: rows.schema[c].dataType.simpleString() for c in ("series_id", "t")}
        return spread(rows).groupBy("series_id").applyInPandas(run, f"series_id {kinds['series_id']}, t {kinds['t']}, value double")
    raise ValueError(f"unknown kind {kind}")


def labelled_at(rows: DataFrame, kinds: list[str], period: float = 24.0) -> DataFrame:
    """sample_id, target, values: each series of ``rows``, as the kind whose turn its place among the keys is."""
    turn = F.pmod("series_id", F.lit(len(kinds)))
    out = None
    for i, kind in enumerate(kinds):
        made = at(rows.where(turn == i), kind, period=period).groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("t", "value"))).alias("p"))
        made = made.select(F.col("series_id").alias("sample_id"), F.lit(i).alias("target"), F.transform("p", lambda x: x["value"]).alias("values"))
        out = made if out is None else out.unionByName(made)
    return out


def labelled(spark: SparkSession, kinds: list[str], each: int, length: int, seed: int = 0) -> DataFrame:
    """sample_id, target (which of ``kinds``), values: ``each`` series of every kind."""
    out = None
    for i, kind in enumerate(kinds):
        rows = make(spark, kind, each, length, seed + 17 * i).groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("t", "value"))).alias("p"))
        rows = rows.select((F.col("series_id") + i * each).alias("sample_id"), F.lit(i).alias("target"), F.transform("p", lambda x: x["value"]).alias("values"))
        out = rows if out is None else out.unionByName(rows)
    return out
