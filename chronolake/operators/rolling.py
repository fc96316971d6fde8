"""Forecasts from rolling origins: steps through each series, errors by step, intervals from the errors so far."""

from __future__ import annotations

from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolake.operators.layouts import by_series, whole_series


def origins(long: DataFrame, horizon: int, step: int, context: int | None = None) -> DataFrame:
    """series_id, n, step, train_end: origins ``step`` apart, from max(horizon, 2) values (``context`` for rolling ones)
    on, as long as a value follows. Series that aren't longer than the horizon and that have none."""
    first = context or max(horizon, 2)
    sizes = long.groupBy("series_id").agg(F.count("*").alias("n")).where((F.col("n") > horizon) & (F.col("n") > first))
    ends = F.posexplode(F.sequence(F.lit(first).cast("long"), F.col("n") - 1, F.lit(step).cast("long")))
    return sizes.select("series_id", "n", ends.alias("step", "train_end")).withColumn("step", F.col("step").cast("long"))


def _fitted(long: DataFrame, method: str, context: int | None) -> DataFrame:
    """series_id, at, level, slope of the forecaster fitted to the values before ``at``."""
    back = by_series().rowsBetween(1 - context if context else Window.unboundedPreceding, 0)
    n, first, last = F.count("*").over(back), F.first("value").over(back), F.col("value")
    level = {"last": last, "mean": F.avg("value").over(back), "drift": last}[method]
    slope = F.when(n > 1, (last - first) / (n - 1)).otherwise(0.0) if method == "drift" else F.lit(0.0)
    return long.select("series_id", (F.col("t") + 1).alias("at"), level.alias("level"), slope.alias("slope"))


def rolling_forecasts(long: DataFrame, horizon: int, method: str, step: int = 1, context: int | None = None, refit: str = "always", every: int = 1, drift: float | None = None) -> DataFrame:
    """series_id, step, train_end, refit, h, y_true, y_pred of ``last``, ``mean`` or ``drift`` forecasts from each origin.

    ``context``: how many values before the origin are seen (all). ``refit``: ``always``, ``never`` (only at the first
    step), ``periodic`` (at each ``every``-th) or ``drift`` (where the mean absolute error of the step before lies
    above ``drift``); a forecaster that isn't fitted anew repeats the forecast of its last fit. All but ``drift``,
    whose steps follow one from the other, are joins on equal places."""
    steps = origins(long, horizon, step, context)
    models = _fitted(long, method, context)
    if refit == "drift":
        return _drifting(long, steps, models, horizon, drift)
    used = {"always": F.col("step"), "never": F.lit(0).cast("long"), "periodic": F.col("step") - F.col("step") % every}
    if refit not in used:
        raise ValueError(f"unknown policy {refit}")
    first = F.first("train_end").over(by_origin())
    steps = steps.withColumn("at", first + used[refit] * step).withColumn("refit", F.col("at") == F.col("train_end"))
    both = steps.join(models, ["series_id", "at"])
    ahead = F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(horizon).cast("long"), F.col("n") - F.col("train_end"))))
    rows = both.withColumn("h", ahead).withColumn("t", F.col("train_end") + F.col("h") - 1)
    truth = long.select("series_id", "t", F.col("value").alias("y_true"))
    return rows.join(truth, ["series_id", "t"]).select("series_id", "step", "train_end", "refit", "h", "y_true", (F.col("level") + F.col("slope") * F.col("h")).alias("y_pred"))


def by_origin() -> Window:
    return whole_series().orderBy("step")


def _drifting(long: DataFrame, steps: DataFrame, models: DataFrame, horizon: int, limit: float | None) -> DataFrame:
    """The steps of a series in turn, in one task; each comes with the values of its own horizon."""
    if limit is None:
        raise ValueError("the policy drift needs a limit")
    rows = steps.join(models, (steps["series_id"] == models["series_id"]) & (F.col("train_end") == F.col("at"))).drop(models["series_id"])
    ahead = F.explode(F.sequence(F.col("train_end"), F.least(F.col("train_end") + horizon, F.col("n")) - 1)).alias("t")
    values = steps.select("series_id", "step", "n", "train_end").select("series_id", "step", ahead).join(long.select("series_id", "t", "value"), ["series_id", "t"])
    values = values.groupBy("series_id", "step").agg(F.array_sort(F.collect_list(F.struct("t", "value"))).alias("v"))
    rows = rows.join(values, ["series_id", "step"]).select("series_id", "n", "step", "train_end", "level", "slope", F.transform("v", lambda x: x["value"]).alias("v"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        out, error, model = [], float("inf"), None
        for r in group.sort_values("step").itertuples():
            anew = model is None or error > limit
            model = (r.level, r.slope) if anew else model
            part = [(h, float(y), model[0] + model[1] * h) for h, y in enumerate(r.v, 1)]
            error = sum(abs(y - p) for _, y, p in part) / len(part)
            out += [(r.series_id, r.step, r.train_end, anew, *x) for x in part]
        return pd.DataFrame(out, columns=["series_id", "step", "train_end", "refit", "h", "y_true", "y_pred"])

    kind = long.schema["series_id"].dataType.simpleString()
    return rows.groupBy("series_id").applyInPandas(run, f"series_id {kind}, step long, train_end long, refit boolean, h long, y_true double, y_pred double")


def step_errors(forecasts: DataFrame) -> DataFrame:
    """series_id, step, train_end, mae, rmse of each step of ``rolling_forecasts``."""
    e = F.col("y_true") - F.col("y_pred")
    return forecasts.groupBy("series_id", "step", "train_end").agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"))


def summary(forecasts: DataFrame) -> DataFrame:
    """series_id, steps, mae, rmse: means over the steps."""
    return step_errors(forecasts).groupBy("series_id").agg(F.count("*").alias("steps"), F.avg("mae").alias("mae"), F.avg("rmse").alias("rmse"))


def intervals(forecasts: DataFrame, level: float = 0.9, floor: float = 1e-6, least: int = 10) -> DataFrame:
    """series_id, step, h, y_true, y_pred, low, high, enough: normal intervals of the given level. Their scale is the
    population deviation of the residuals of the steps before, at least ``floor`` (which it is without any);
    enough: at least ``least`` residuals were known."""
    z = NormalDist().inv_cdf(0.5 + level / 2)
    e = F.col("y_true") - F.col("y_pred")
    sums = forecasts.groupBy("series_id", "step").agg(F.count("*").alias("n"), F.sum(e).alias("s"), F.sum(e * e).alias("q"))
    before = by_origin().rowsBetween(Window.unboundedPreceding, -1)
    n, s, q = (F.coalesce(F.sum(c).over(before), F.lit(0)) for c in ("n", "s", "q"))
    past = sums.select("series_id", "step", n.alias("known"), s.alias("ps"), q.alias("pq"))
    mean = F.try_divide(F.col("ps"), F.col("known"))
    scale = F.sqrt(F.greatest(F.try_divide(F.col("pq"), F.col("known")) - mean * mean, F.lit(0.0)))
    radius: Column = z * F.greatest(F.coalesce(scale, F.lit(0.0)), F.lit(floor))
    out = forecasts.join(past, ["series_id", "step"])
    return out.select("series_id", "step", "h", "y_true", "y_pred", (F.col("y_pred") - radius).alias("low"), (F.col("y_pred") + radius).alias("high"), (F.col("known") >= least).alias("enough"))


def coverage(intervals_: DataFrame) -> DataFrame:
    """series_id, coverage: the share of values that lie in their interval, and the mean width, over steps with
    enough residuals."""
    inside = F.col("y_true").between(F.col("low"), F.col("high")).cast("double")
    return intervals_.where("enough").groupBy("series_id").agg(F.avg(inside).alias("coverage"), F.avg(F.col("high") - F.col("low")).alias("width"))
