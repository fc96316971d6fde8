"""Forecasts by series, folds in time, and closed-form learners."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolake.operators.layouts import spread, whole_series


def naive(long: DataFrame, horizon: int, method: str, width: int = 3) -> DataFrame:
    """series_id, h (1 to ``horizon``), y by ``last``, ``mean``, ``drift``, ``moving_average`` or ``linear_trend``."""
    n, h = F.count("*"), F.col("h")
    last = F.max_by("value", "t")
    if method == "last":
        base = long.groupBy("series_id").agg(last.alias("a"), F.lit(0.0).alias("b"))
    elif method == "mean":
        base = long.groupBy("series_id").agg(F.avg("value").alias("a"), F.lit(0.0).alias("b"))
    elif method == "drift":
        step = F.when(n > 1, (last - F.min_by("value", "t")) / (n - 1)).otherwise(0.0)
        base = long.groupBy("series_id").agg(last.alias("a"), step.alias("b"))
    elif method == "linear_trend":
        t = F.col("t").cast("double")
        slope, start = F.coalesce(F.regr_slope("value", t), F.lit(0.0)), F.coalesce(F.regr_intercept("value", t), F.avg("value"))
        base = long.groupBy("series_id").agg((start + slope * (n - 1)).alias("a"), slope.alias("b"))
    elif method == "moving_average":
        rows = long.withColumn("n", n.over(whole_series())).where(F.col("t") >= F.col("n") - width)
        base = rows.groupBy("series_id").agg(F.avg("value").alias("a"), F.lit(0.0).alias("b"))
    else:
        raise ValueError(f"unknown method {method}")
    steps = base.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizon)).cast("array<bigint>")))
    return steps.select("series_id", "h", (F.col("a") + F.col("b") * h).alias("y"))


def seasonal_naive(long: DataFrame, horizon: int, season: int) -> DataFrame:
    """series_id, h, y: the last season, repeated."""
    rows = long.withColumn("n", F.count("*").over(whole_series())).where(F.col("t") >= F.col("n") - season)
    rows = rows.select("series_id", (F.col("t") - F.col("n") + season).alias("place"), F.col("value").alias("y"))
    steps = rows.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizon)).cast("array<bigint>")))
    return steps.where((F.col("h") - 1) % season == F.col("place")).select("series_id", "h", "y")


def split_last(long: DataFrame, horizon: int) -> DataFrame:
    """``long`` with split: the last ``horizon`` points of a series are ``test``."""
    n = F.count("*").over(whole_series())
    return long.withColumn("split", F.when(F.col("t") >= n - horizon, "test").otherwise("train"))


def folds(long: DataFrame, horizon: int, kind: str, most: int = 10, gap: int = 0, step: int | None = None) -> DataFrame:
    """series_id, fold, train_start, train_end, test_start, test_end (ends exclusive).

    ``holdout``: the last horizon. ``expanding``: origins from max(horizon + 2, 4) on, ``step`` (default the
    horizon) apart, ending at the series' end, the last ``most`` of them; ``rolling``: the same with training windows of that
    least length; ``series_split``: ``most`` equal test blocks at the end, as many as fit."""
    least = max(horizon + 2, 4)
    sizes = long.groupBy("series_id").agg(F.count("*").alias("n"))
    n = F.col("n")
    if kind == "holdout":
        out = sizes.where(n >= least + horizon + gap).select("series_id", n, F.lit(0).cast("long").alias("fold"), (n - horizon).alias("test_start"), F.lit(horizon).cast("long").alias("size"))
    elif kind in ("expanding", "rolling"):
        by = step or horizon
        count = F.floor((n - least - horizon - gap) / by) + 1
        kept = F.least(count, F.lit(most).cast("long"))
        rows = sizes.where(n >= least + horizon + gap).select("series_id", n, F.explode(F.sequence(F.lit(0).cast("long"), kept - 1)).alias("fold"), kept.alias("kept"))
        out = rows.select("series_id", n, "fold", (n - horizon - (F.col("kept") - 1 - F.col("fold")) * by).alias("test_start"), F.lit(horizon).cast("long").alias("size"))
    elif kind == "series_split":
        size = F.floor(n / (most + 1))
        rows = sizes.where(size >= 1).select("series_id", n, size.alias("size"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(most - 1).cast("long"))).alias("fold"))
        out = rows.select("series_id", n, "fold", (n - (most - F.col("fold")) * F.col("size")).alias("test_start"), "size")
    else:
        raise ValueError(f"unknown kind {kind}")
    end = F.col("test_start") - gap
    start = F.greatest(F.lit(0).cast("long"), end - least) if kind == "rolling" else F.lit(0).cast("long")
    return out.select("series_id", "fold", start.alias("train_start"), end.alias("train_end"), "test_start", (F.col("test_start") + F.col("size")).alias("test_end"))


def _by_series(long: DataFrame, forecast, horizon: int) -> DataFrame:
    """Applies ``forecast(values, horizon)`` to each series; one series is one task's array."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        y = forecast(group.sort_values("t")["value"].to_numpy("float64"), horizon)
        return pd.DataFrame({"series_id": group["series_id"].iloc[0], "h": range(1, horizon + 1), "y": y})

    kind = long.schema["series_id"].dataType.simpleString()
    return spread(long.select("series_id", "t", "value")).groupBy("series_id").applyInPandas(run, f"series_id {kind}, h long, y double")


#: Most lags of the models that are fitted to one series: what they solve has so many rows and columns.
MOST_LAGS = 128
#: Windows of a series that are looked at together.
CHUNK = 8192


def windows_of(v: np.ndarray, width: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(v, width)


def _recursive(v: np.ndarray, lag: int, horizon: int, strength: float) -> list[float]:
    """Ridge on the ``lag`` values before, applied to its own forecasts; sums of products by chunks of windows."""
    gram, top, x = np.zeros((lag + 1, lag + 1)), np.zeros(lag + 1), windows_of(v[:-1], lag)
    for at in range(0, len(x), CHUNK):
        part = np.column_stack([x[at : at + CHUNK], np.ones(len(x[at : at + CHUNK]))])
        gram += part.T @ part
        top += part.T @ v[lag + at : lag + at + len(part)]
    gram[np.arange(lag), np.arange(lag)] += strength
    w, tail, out = np.linalg.lstsq(gram, top, rcond=None)[0], v[-lag:], []
    for _ in range(horizon):
        out.append(float(tail @ w[:-1] + w[-1]))
        tail = np.r_[tail[1:], out[-1]]
    return out


def lagged_ridge(long: DataFrame, horizon: int, strength: float = 1.0) -> DataFrame:
    """Ridge regression of each value on the tenth of the series (2 to ``MOST_LAGS``) before it, applied recursively."""

    def forecast(v: np.ndarray, h: int) -> list[float]:
        w = min(max(2, round(0.1 * len(v))), len(v) - 1, MOST_LAGS)
        return _recursive(v, w, h, strength) if w >= 1 else [float(v[-1])] * h

    return _by_series(long, forecast, horizon)


def directions(v: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Singular values, largest first, and right singular vectors (as columns) of the trajectory matrix (windows as
    rows), from its products summed by chunks."""
    gram, x = np.zeros((width, width)), windows_of(v, width)
    for at in range(0, len(x), CHUNK):
        gram += x[at : at + CHUNK].T @ x[at : at + CHUNK]
    values, vectors = np.linalg.eigh(gram)
    return np.sqrt(np.maximum(values[::-1], 0)), vectors[:, ::-1]


def rank_of(s: np.ndarray, share: float, least: int = 1) -> int:
    """The least rank that explains ``share`` of the squared singular values."""
    energy = np.cumsum(s * s)
    rank = int(np.searchsorted(energy, share * energy[-1] * (1 - 1e-12))) + 1 if energy[-1] > 0 else 1
    return min(len(s), max(least, rank))


def trajectory_width(n: int) -> int:
    """A third of the series, at most ``MOST_LAGS``."""
    return max(1, min(n // 3, MOST_LAGS))


def smoothed(v: np.ndarray, share: float) -> np.ndarray:
    """The series from its trajectory matrix at low rank, by averages over the anti-diagonals, chunk by chunk."""
    width = trajectory_width(len(v))
    s, vectors = directions(v, width)
    basis, x = vectors[:, : rank_of(s, share)], windows_of(v, width)
    total, times = np.zeros(len(v)), np.zeros(len(v))
    for at in range(0, len(x), CHUNK):
        part = x[at : at + CHUNK] @ basis @ basis.T
        for k in range(width):
            total[at + k : at + k + len(part)] += part[:, k]
            times[at + k : at + k + len(part)] += 1
    return total / times


def ssa(long: DataFrame, horizon: int, share: float = 0.95) -> DataFrame:
    """Singular spectrum analysis: the trajectory matrix at low rank, averaged back, then lagged ridge."""

    def forecast(v: np.ndarray, h: int) -> list[float]:
        if len(v) < 4:
            return [float(v[-1])] * h
        return _recursive(smoothed(v, share), min(max(2, len(v) // 3), 12, len(v) - 2), h, 1e-3)

    return _by_series(long, forecast, horizon)


def low_rank_ridge(long: DataFrame, horizon: int, share: float = 0.95, strength: float = 1.0) -> DataFrame:
    """Ridge regression of the ``horizon`` values that follow on the window before them, a tenth of the series
    (horizon + 2 to ``MOST_LAGS``), projected on its leading directions (two at least)."""

    def forecast(v: np.ndarray, h: int) -> list[float]:
        w = min(max(h + 2, round(0.1 * len(v))), MOST_LAGS)
        if len(v) < w + h + 2:
            return [float(v[-1])] * h
        x, y = windows_of(v[:-h], w), windows_of(v[w:], h)
        s, vectors = directions(v[:-h], w)
        basis = vectors[:, : rank_of(s, share, 2)]
        k = basis.shape[1]
        gram, top = np.zeros((k + 1, k + 1)), np.zeros((k + 1, h))
        for at in range(0, len(x), CHUNK):
            part = np.column_stack([x[at : at + CHUNK] @ basis, np.ones(len(x[at : at + CHUNK]))])
            gram += part.T @ part
            top += part.T @ y[at : at + CHUNK]
        gram[np.arange(k), np.arange(k)] += strength
        return (np.r_[v[-w:] @ basis, 1.0] @ np.linalg.lstsq(gram, top, rcond=None)[0]).tolist()

    return _by_series(long, forecast, horizon)


def forced_operator(long: DataFrame, horizon: int, share: float = 0.99, decay: float = 0.85) -> DataFrame:
    """Leading coordinates of the trajectory matrix, the last of them as a forcing: linear transitions of the others
    by all of them, and of the forcing by itself; forecasts advance the state, the forcing fading by ``decay``."""

    def forecast(v: np.ndarray, h: int) -> list[float]:
        w = min(max(h + 2, round(0.15 * len(v))), MOST_LAGS, len(v) - 1)
        if len(v) < w + 3 or w < 2:
            return [float(v[-1])] * h
        s, vectors = directions(v, w)
        basis = vectors[:, : rank_of(s, share, 2)]
        z = windows_of(v, w) @ basis
        if len(z) < 3:
            return [float(v[-1])] * h
        design = np.column_stack([z[:-1], np.ones(len(z) - 1)])
        move = np.linalg.lstsq(design, z[1:, :-1], rcond=None)[0]
        force = np.linalg.lstsq(np.column_stack([z[:-1, -1], np.ones(len(z) - 1)]), z[1:, -1], rcond=None)[0]
        state, out = z[-1], []
        for _ in range(h):
            state = np.r_[np.r_[state, 1.0] @ move, decay * (force[0] * state[-1] + force[1])]
            out.append(float((basis @ state)[-1]))
        return out

    return _by_series(long, forecast, horizon)


def autoregression(long: DataFrame, horizon: int, order: int = 3) -> DataFrame:
    """Least squares on the ``order`` values before, applied recursively."""
    return _by_series(long, lambda v, h: _recursive(v, min(order, len(v) - 1), h, 1e-9) if len(v) > 2 else [float(v[-1])] * h, horizon)


def hybrid(forecasts: DataFrame, truth: DataFrame) -> DataFrame:
    """series_id, model, weight: least-squares weights of the models on ``truth`` by pseudo-inverse, negative ones as
    0, normalised; equal where none is positive.

    ``forecasts``: series_id, model, h, y; ``truth``: series_id, h, value. A series' forecasts are one task's matrix of
    horizon times models."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        wide = group.pivot(index="h", columns="model", values="y").dropna()
        y = group.groupby("h")["value"].first().loc[wide.index]
        w = np.maximum(np.linalg.pinv(wide.to_numpy()) @ y.to_numpy(), 0) if len(wide) else np.zeros(wide.shape[1])
        w = w / w.sum() if w.sum() > 0 else np.full(len(w), 1 / max(1, len(w)))
        return pd.DataFrame({"series_id": group["series_id"].iloc[0], "model": wide.columns, "weight": w})

    kind = forecasts.schema["series_id"].dataType.simpleString()
    both = forecasts.join(truth, ["series_id", "h"]).select("series_id", "model", "h", "y", "value")
    return both.groupBy("series_id").applyInPandas(run, f"series_id {kind}, model string, weight double")
