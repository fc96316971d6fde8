"""Cleaning: times, repeated times, gaps, regular grids, filling, scaling, channel reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolake.operators.layouts import by_series, whole_series


def seconds(c: Column) -> Column:
    """A numeric, numeric-text or ISO time as seconds; null where it can't be read."""
    text = c.cast("string")
    return F.coalesce(F.try_to_number(text, F.lit("999999999999.999999")).cast("double"), F.unix_micros(F.try_to_timestamp(text)) / 1e6)


def dedup_times(rows: DataFrame, keys: list[str], order: Column, value: str, policy: str) -> DataFrame:
    """One row for each ``keys``: ``keep_last`` by ``order``, ``mean``, or ``drop`` what occurs twice."""
    if policy == "keep_last":
        return rows.groupBy(*keys).agg(F.max_by(value, order).alias(value))
    if policy == "mean":
        return rows.groupBy(*keys).agg(F.avg(value).alias(value))
    if policy == "drop":
        return rows.groupBy(*keys).agg(F.first(value).alias(value), F.count("*").alias("n")).where("n = 1").drop("n")
    raise ValueError(f"unknown policy {policy}")


def gap_statistics(long: DataFrame, factor: float = 1.5) -> DataFrame:
    """series_id, nominal_dt (median of the positive steps), n_gaps (steps above ``factor`` of it), gap_seconds."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    step = (at - F.lag(at).over(by_series())) / 1e6
    steps = long.select("series_id", step.alias("d")).where("d > 0")
    steps = steps.withColumn("dt", F.percentile("d", F.lit(0.5)).over(whole_series()))
    gap = F.col("d") / F.col("dt") > factor
    return steps.groupBy("series_id").agg(
        F.first("dt").alias("nominal_dt"), F.count_if(gap).alias("n_gaps"), F.sum(F.when(gap, F.col("d") - F.col("dt")).otherwise(0.0)).alias("gap_seconds")
    )


def regular_grid(long: DataFrame, policy: str = "mark_only", step_seconds: float | None = None) -> DataFrame:
    """series_id, slot (0, 1, ...), second (since the epoch), value, is_gap: each series on a grid from its first
    time to its last. Slots are ``step_seconds`` apart, or the median of the positive steps between its times.

    A value goes to the slot nearest to its time (halves to the even one); of several the latest stays. Empty
    slots stay null (``mark_only``), take the value before, at the head the one after (``forward_fill``), or lie
    on the line between both (``interpolate_linear``); is_gap tells them, filled or not, and slots that stay null."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = long.select("series_id", "t", micros.alias("at"), "value").withColumn("d", F.col("at") - F.lag("at").over(by_series()))
    step = F.lit(step_seconds * 1e6) if step_seconds else F.coalesce(F.percentile(F.when(F.col("d") > 0, F.col("d")), F.lit(0.5)), F.lit(1e6))
    each = rows.groupBy("series_id").agg(F.min("at").alias("a"), F.max("at").alias("b"), step.alias("dt"))
    each = each.withColumn("n", F.ceil((F.col("b") - F.col("a")) / F.col("dt") + 0.5))
    slot = F.least(F.bround((F.col("at") - F.col("a")) / F.col("dt")).cast("long"), F.col("n") - 1)
    held = rows.join(each, "series_id").groupBy("series_id", slot.alias("slot")).agg(F.max_by(F.struct("value"), F.struct("at", "t")).alias("v"))
    every = each.select("series_id", "a", "dt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("slot"))
    grid = every.join(held, ["series_id", "slot"], "left")
    grid = grid.select("series_id", "slot", ((F.col("a") + F.col("slot") * F.col("dt")) / 1e6).alias("second"), F.col("v.value").alias("value"), F.col("v").isNull().alias("empty"))
    if policy != "mark_only":
        grid = grid.withColumn("value", fill("series_id", "slot", "value", policy))
    return grid.select("series_id", "slot", "second", "value", (F.col("empty") | F.col("value").isNull()).alias("is_gap"))


def carried_index(long: DataFrame) -> DataFrame:
    """series_id, t, carried: the place of the latest value that isn't missing; null before the first."""
    known = F.when(F.col("value").isNotNull(), F.col("t"))
    return long.select("series_id", "t", F.max(known).over(by_series().rowsBetween(Window.unboundedPreceding, 0)).alias("carried"))


def fill(key: str, order: str, value: str, policy: str) -> Column:
    """Nulls of ``value`` filled within ``key``; see ``regular_grid``. A key without values: 0."""
    w = Window.partitionBy(key).orderBy(order)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    before, after = F.last(value, True).over(back), F.first(value, True).over(ahead)
    if policy == "forward_fill":
        return F.coalesce(before, after, F.lit(0.0))
    place = F.when(F.col(value).isNotNull(), F.col(order))
    s0, s1 = F.last(place, True).over(back), F.first(place, True).over(ahead)
    line = before + (after - before) * (F.col(order) - s0) / (s1 - s0)
    return F.coalesce(F.col(value), line, before, after, F.lit(0.0))


def robust_scale(long: DataFrame) -> DataFrame:
    """z = (value - median) / MAD by series; a MAD under 1e-8 counts as 1."""
    centred = long.withColumn("m", F.percentile("value", F.lit(0.5)).over(whole_series()))
    spread = centred.withColumn("d", F.percentile(F.abs(F.col("value") - F.col("m")), F.lit(0.5)).over(whole_series()))
    return spread.select("series_id", "t", ((F.col("value") - F.col("m")) / F.when(F.col("d") < 1e-8, 1.0).otherwise(F.col("d"))).alias("z"))


def z_normalise(long: DataFrame) -> DataFrame:
    """z with the population deviation, at least 1e-6."""
    w = whole_series()
    return long.select("series_id", "t", ((F.col("value") - F.avg("value").over(w)) / F.greatest(F.stddev_pop("value").over(w), F.lit(1e-6))).alias("z"))


def min_max(long: DataFrame, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Values scaled to [low, high] by series."""
    w = whole_series()
    a, b = F.min("value").over(w), F.max("value").over(w)
    return long.select("series_id", "t", (low + (high - low) * (F.col("value") - a) / F.greatest(b - a, F.lit(1e-8))).alias("scaled"))


def rolling_mean(long: DataFrame, width: int) -> DataFrame:
    """Mean of each value and the ``width`` - 1 before it."""
    return long.select("series_id", "t", F.avg("value").over(by_series().rowsBetween(1 - width, 0)).alias("smooth"))


def differences(long: DataFrame) -> DataFrame:
    """First differences, the first of a series 0."""
    return long.select("series_id", "t", F.coalesce(F.col("value") - F.lag("value").over(by_series()), F.lit(0.0)).alias("diff"))


def integrate(long: DataFrame) -> DataFrame:
    """Running sums."""
    return long.select("series_id", "t", F.sum("value").over(by_series().rowsBetween(Window.unboundedPreceding, 0)).alias("total"))


def runs(flagged: DataFrame, flag: str, least: int = 1) -> DataFrame:
    """series_id, start, end (inclusive), length of the runs of consecutive t where ``flag`` holds."""
    island = F.col("t") - F.row_number().over(by_series())
    found = flagged.where(flag).select("series_id", "t", island.alias("island"))
    out = found.groupBy("series_id", "island").agg(F.min("t").alias("start"), F.max("t").alias("end"), F.count("*").alias("length"))
    return out.where(F.col("length") >= least).drop("island")


def saturation_runs(long: DataFrame, least: int = 2, upper: float = 0.9) -> DataFrame:
    """Runs of at least ``least`` values at or above the series' quantile ``upper``."""
    flagged = long.withColumn("hit", F.col("value") >= F.percentile("value", F.lit(upper)).over(whole_series()))
    return runs(flagged, "hit", least)


def channel_report(long: DataFrame) -> DataFrame:
    """series_id, missing, repeats (values equal to the one before), dead (variance under 1e-10), noise_floor
    (median absolute step), span (range)."""
    before = F.lag("value").over(by_series())
    rows = long.select("series_id", "value", (F.col("value") == before).alias("same"), F.abs(F.col("value") - before).alias("step"))
    return rows.groupBy("series_id").agg(
        F.count_if(F.col("value").isNull()).alias("missing"),
        F.count_if("same").alias("repeats"),
        (F.var_pop("value") < 1e-10).alias("dead"),
        F.percentile("step", F.lit(0.5)).alias("noise_floor"),
        (F.max("value") - F.min("value")).alias("span"),
    )


def varied(long: DataFrame, least: float = 0.01) -> DataFrame:
    """Series with a population variance above ``least``."""
    return long.groupBy("series_id").agg(F.var_pop("value").alias("variance")).where(F.col("variance") > least)


def fill_by_trend(long: DataFrame) -> DataFrame:
    """Missing values on the least-squares line of their series."""
    w = whole_series()
    t = F.when(F.col("value").isNotNull(), F.col("t").cast("double"))
    a, b = F.regr_slope("value", t).over(w), F.regr_intercept("value", t).over(w)
    return long.select("series_id", "t", F.coalesce("value", a * F.col("t") + b).alias("value"))


def quantile_bins(rows: DataFrame, value: str, edges: list[float]) -> DataFrame:
    """``rows`` with bin: how many of the quantiles ``edges`` of all values lie at or below the value."""
    q = rows.agg(F.percentile(value, F.array(*map(F.lit, edges))).alias("q"))
    return rows.crossJoin(F.broadcast(q)).withColumn("bin", F.size(F.filter("q", lambda x: x <= F.col(value))).cast("long")).drop("q")
