"""Operators that need linear algebra or sequential state: one series is one task's array, by grouped pandas."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronolake.operators.chunks import chunked, scanned, surroundings
from chronolake.operators.forecast import directions, rank_of, smoothed, trajectory_width, windows_of
from chronolake.operators.layouts import by_series, spread


def per_series(long: DataFrame, make: Callable[[np.ndarray], dict], columns: str) -> DataFrame:
    """A row (or rows, where ``make`` gives arrays) for each series; ``columns`` is their DDL."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame({k: np.atleast_1d(v) for k, v in make(group.sort_values("t")["value"].to_numpy("float64")).items()})
        out.insert(0, "series_id", group["series_id"].iloc[0])
        return out

    kind = long.schema["series_id"].dataType.simpleString()
    return spread(long.select("series_id", "t", "value")).groupBy("series_id").applyInPandas(run, f"series_id {kind}, {columns}")


def _reach(x: float, hull: list[tuple[int, float]], sign: int) -> float:
    """The greatest sign * (y - x * i) over the points (i, y) of a hull that is convex to that side."""
    low, high = 0, len(hull) - 1
    while low < high:
        middle = (low + high) // 2
        (i, y), (j, z) = hull[middle], hull[middle + 1]
        if sign * (z - x * j) > sign * (y - x * i):
            low = middle + 1
        else:
            high = middle
    i, y = hull[low]
    return sign * (y - x * i)


def _onto(hull: list[tuple[int, float]], point: tuple[int, float], sign: int) -> None:
    while len(hull) > 1:
        (a, p), (b, q) = hull[-2], hull[-1]
        if sign * ((q - p) * (point[0] - b) - (point[1] - q) * (b - a)) > 0:
            break
        hull.pop()
    hull.append(point)


def hurst(long: DataFrame) -> DataFrame:
    """hurst: slope of log(R / S) on log n over all prefixes of two values or more. The range of a prefix's running
    sums about their mean line is read from the convex hulls of the sums, which grow with it."""

    def make(v: np.ndarray) -> dict:
        n = np.arange(1, len(v) + 1)
        sums, squares = np.cumsum(v), np.cumsum(v * v)
        mean = sums / n
        deviation = np.sqrt(np.maximum(squares / n - mean * mean, 0))
        upper, lower, spread = [], [], np.zeros(len(v))
        for k, (y, m) in enumerate(zip(sums.tolist(), mean.tolist(), strict=True)):
            _onto(upper, (k + 1, y), 1)
            _onto(lower, (k + 1, y), -1)
            spread[k] = _reach(m, upper, 1) + _reach(m, lower, -1)
        good = (deviation > 1e-12) & (spread > 1e-12) & (n > 1)
        return {"hurst": np.polyfit(np.log(n[good]), np.log(spread[good] / deviation[good]), 1)[0] if good.sum() > 1 else 0.0}

    return per_series(long, make, "hurst double")


def spectrum(long: DataFrame) -> DataFrame:
    """bin, power of the periodogram of each series without its mean."""

    def make(v: np.ndarray) -> dict:
        p = np.abs(np.fft.rfft(v - v.mean())) ** 2 / len(v)
        return {"bin": np.arange(len(p)), "power": p}

    return per_series(long, make, "bin long, power double")


def dominant_period(long: DataFrame) -> DataFrame:
    """period (of the strongest bin but 0; 0 if there is none), concentration (its share), flatness."""

    def make(v: np.ndarray) -> dict:
        p = np.abs(np.fft.rfft(v - v.mean()))[1:] ** 2
        if not len(p) or p.sum() <= 1e-12:
            return {"period": 0.0, "concentration": 0.0, "flatness": 0.0}
        return {"period": len(v) / (1 + p.argmax()), "concentration": p.max() / p.sum(), "flatness": float(np.exp(np.log(p + 1e-12).mean()) / (p + 1e-12).mean())}

    return per_series(long, make, "period double, concentration double, flatness double")


def short_time_spectrum(long: DataFrame, width: int = 16, hop: int = 8) -> DataFrame:
    """frame, bin, power of Hann-windowed frames, the series reflected at both ends."""
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(width) / width)

    def make(v: np.ndarray) -> dict:
        v = np.pad(v, min(width // 2, len(v) - 1), "reflect")
        if len(v) < width:
            v = np.pad(v, (0, width - len(v)))
        p = np.abs(np.fft.rfft(np.lib.stride_tricks.sliding_window_view(v, width)[::hop] * window)) ** 2
        frame, bin_ = np.indices(p.shape)
        return {"frame": frame.ravel(), "bin": bin_.ravel(), "power": p.ravel()}

    return per_series(long, make, "frame long, bin long, power double")


def singular_values(long: DataFrame, share: float = 0.95) -> DataFrame:
    """Of the trajectory matrix of a third of the series (``forecast.MOST_LAGS`` at most): rank (least that explains
    ``share`` of the squared singular values), hard_rank (those of at least 2.858 medians), condition, and
    leading (the first's part of the sum of all, in percent)."""

    def make(v: np.ndarray) -> dict:
        s, _ = directions(v, trajectory_width(len(v)))
        rank = rank_of(s, share) if s.any() else 0
        leading = 100 * s[0] / s.sum() if s.any() else 0.0
        return {"rank": rank, "hard_rank": int((s >= 2.858 * np.median(s)).sum()), "condition": s[0] / max(s[-1], 1e-6 * s[0], 1e-12), "leading": leading}

    return per_series(long, make, "rank long, hard_rank long, condition double, leading double")


def low_rank(long: DataFrame, share: float = 0.9) -> DataFrame:
    """t, value of each series rebuilt from its trajectory matrix at low rank."""
    return per_series(long, lambda v: {"t": np.arange(len(v)), "value": smoothed(v, share)}, "t long, value double")


def dynamic_modes(long: DataFrame, width: int = 8, rank: int = 4) -> DataFrame:
    """mode, growth (absolute value), frequency (turns a step), amplitude of the exact dynamic modes of each series'
    windows: the eigenvalues of the linear operator, of at most ``rank``, that takes each window to the next."""

    def make(v: np.ndarray) -> dict:
        w = min(width, len(v) // 2)
        if w < 1 or len(v) < w + 2:
            return {"mode": np.empty(0, "int64"), "growth": np.empty(0), "frequency": np.empty(0), "amplitude": np.empty(0)}
        x = windows_of(v, w)
        a, b = x[:-1], x[1:]
        gram, cross = a.T @ a, a.T @ b
        values, vectors = np.linalg.eigh(gram)
        keep = np.argsort(-values)[:rank]
        keep = keep[values[keep] > 1e-10 * max(values.max(), 1e-300)]
        if not len(keep):
            return {"mode": np.empty(0, "int64"), "growth": np.empty(0), "frequency": np.empty(0), "amplitude": np.empty(0)}
        u, s2 = vectors[:, keep], values[keep]
        operator = (u.T @ cross @ u) / s2[:, None]
        turns, right = np.linalg.eig(operator.T)
        start = np.linalg.lstsq(right, (x[0] @ u).astype(complex), rcond=None)[0]
        order = np.lexsort((np.angle(turns), -np.abs(turns)))
        return {"mode": np.arange(len(order)), "growth": np.abs(turns)[order], "frequency": np.angle(turns)[order] / (2 * np.pi), "amplitude": np.abs(start)[order]}

    return per_series(long, make, "mode long, growth double, frequency double, amplitude double")


def haar(long: DataFrame) -> DataFrame:
    """series_id, k, approximation, detail: one level of the Haar transform; an odd last value stays alone."""
    pairs = long.groupBy("series_id", F.floor(F.col("t") / 2).alias("k")).agg(F.min_by("value", "t").alias("a"), F.max_by("value", "t").alias("b"))
    root = F.sqrt(F.lit(2.0))
    return pairs.select("series_id", "k", ((F.col("a") + F.col("b")) / root).alias("approximation"), ((F.col("a") - F.col("b")) / root).alias("detail"))


def kalman(long: DataFrame, process: float = 0.01, noise: float = 1.0) -> DataFrame:
    """t, level: local-level filter with the given ratio of variances; its state goes from batch to batch of a series."""

    def step(state: tuple, values: np.ndarray) -> tuple[tuple, dict]:
        level, spread = state
        out = np.empty(len(values))
        for i, x in enumerate(values):
            level = x if level is None else level
            spread += process
            gain = spread / (spread + noise)
            level += gain * (x - level)
            spread *= 1 - gain
            out[i] = level
        return (level, spread), {"level": out}

    return scanned(long, lambda: (None, noise), step, "level double")


def subspace_change(long: DataFrame, width: int = 6, chunk: int = 2048) -> DataFrame:
    """t, score: 1 - the squared overlap of the leading directions of the past and the coming windows; 0 where a series
    has too little of either. A task holds ``chunk`` places with the windows around them."""
    span = 2 * width
    kind = long.schema["series_id"].dataType.simpleString()

    def run(group: pd.DataFrame) -> pd.DataFrame:
        start, own, v = surroundings(group, span, span, chunk)
        scores = np.zeros(own)
        if own:
            inside = np.arange(own)[:, None, None] + np.arange(width)[None, :, None] + np.arange(width + 1)[None, None, :]
            whole = np.flatnonzero(np.isfinite(v[np.arange(own)[:, None] + np.arange(2 * span)[None, :]]).all(axis=1))
            past = np.linalg.svd(v[inside[whole]], full_matrices=False)[0][:, :, :2]
            coming = np.linalg.svd(v[inside[whole] + span], full_matrices=False)[0][:, :, 0]
            overlap = np.einsum("twk,tw->tk", past, coming)
            scores[whole] = np.maximum(0.0, 1 - (overlap**2).sum(axis=1))
        return pd.DataFrame({"series_id": group["series_id"].iloc[0], "t": np.arange(start, start + own), "score": scores})

    return chunked(long, span, span, chunk).groupBy("series_id", "chunk").applyInPandas(run, f"series_id {kind}, t long, score double")


def kernel_features(long: DataFrame, dilations: tuple[int, ...] = (1, 2, 4), together: int = 12) -> DataFrame:
    """kernel, dilation, ppv: share of positive values of the series under nine-tap kernels of three 2s and six
    -1s (all 84 of them), against the median response as bias; ``together`` kernels at once."""
    kernels = np.full((84, 9), -1.0)
    for i, c in enumerate(combinations(range(9), 3)):
        kernels[i, list(c)] = 2.0

    def make(v: np.ndarray) -> dict:
        which, width, shares = [], [], []
        for d in dilations:
            n = len(v) - 8 * d
            if n < 1:
                continue
            taps = np.stack([v[d * k : d * k + n] for k in range(9)])
            for at in range(0, 84, together):
                y = kernels[at : at + together] @ taps
                shares.append((y > np.median(y, axis=1, keepdims=True)).mean(axis=1))
            which.append(np.arange(84))
            width.append(np.full(84, d))
        none = np.empty(0, "int64")
        return {"kernel": np.concatenate([none, *which]), "dilation": np.concatenate([none, *width]), "ppv": np.concatenate([np.empty(0), *shares])}

    return per_series(long, make, "kernel long, dilation long, ppv double")


def isolation_scores(points: DataFrame, columns: list[str], trees: int = 50, sample: int = 256, seed: int = 3) -> DataFrame:
    """``points`` with score: isolation forest, applied in one pass. Each tree is fitted on ``sample`` rows of its
    own, by a hash of the row's other columns (its keys; all columns if there are none) and the tree's number;
    tasks hand on their best ``sample`` rows of each tree alone."""
    keys = [c for c in points.columns if c not in columns] or points.columns
    kind = ", ".join(f"`{i}` double" for i in range(len(columns)))
    plain = points.select(F.xxhash64(F.lit(seed), *keys).alias("h"), *[F.col(c).cast("double").alias(str(i)) for i, c in enumerate(columns)])
    names = [str(i) for i in range(len(columns))]

    def drawn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: list[pd.DataFrame | None] = [None] * trees
        for batch in batches:
            h = batch["h"].to_numpy().astype("uint64")
            for t in range(trees):
                x = (h ^ np.uint64((t + 1) * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
                x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
                x = (x ^ (x >> np.uint64(32))) >> np.uint64(1)
                at = np.argpartition(x, sample)[:sample] if len(x) > sample else np.arange(len(x))
                new = batch.iloc[at][names].assign(tree=t, spot=x[at].astype("int64"))
                both = new if best[t] is None else pd.concat([best[t], new])
                best[t] = both.nsmallest(sample, "spot")
        for rows in best:
            if rows is not None:
                yield rows[["tree", "spot", *names]]

    place = F.row_number().over(Window.partitionBy("tree").orderBy("spot", *names))
    found = plain.mapInPandas(drawn, f"tree int, spot long, {kind}").withColumn("place", place).where(F.col("place") <= sample).toPandas()
    found = found.sort_values(["tree", "place"])
    samples = [found.loc[found["tree"] == t, names].to_numpy("float64") for t in range(trees)]
    size = len(samples[0])
    rng = np.random.default_rng(seed)
    deepest = int(np.ceil(np.log2(max(2, size))))

    def mean_path(n: int) -> float:
        return 0.0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    def grow(rows: np.ndarray, depth: int):
        spread = np.ptp(rows, axis=0) if len(rows) else np.zeros(len(columns))
        if depth == deepest or len(rows) < 2 or not spread.any():
            return depth + mean_path(len(rows))
        c = int(rng.choice(np.flatnonzero(spread)))
        at = rng.uniform(rows[:, c].min(), rows[:, c].max())
        return c, at, grow(rows[rows[:, c] < at], depth + 1), grow(rows[rows[:, c] >= at], depth + 1)

    forest = [grow(rows, 0) for rows in samples]
    scale = max(mean_path(size), 1e-9)

    def depth_of(tree, x: np.ndarray) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        c, at, low, high = tree
        left = x[:, c] < at
        out = np.empty(len(x))
        out[left], out[~left] = depth_of(low, x[left]), depth_of(high, x[~left])
        return out

    @F.pandas_udf("double")
    def score(*series: pd.Series) -> pd.Series:
        x = np.column_stack([s.to_numpy("float64") for s in series])
        return pd.Series(2.0 ** -(sum(depth_of(t, x) for t in forest) / len(forest) / scale))

    return points.withColumn("score", score(*[F.col(c).cast("double") for c in columns]))


def change_rates(long: DataFrame) -> DataFrame:
    """switching: share of sign changes of the steps; a cheap regime diagnostic without Python."""
    step = F.col("value") - F.lag("value").over(by_series())
    rows = long.select("series_id", "t", F.signum(step).alias("s")).withColumn("p", F.lag("s").over(by_series()))
    return rows.groupBy("series_id").agg((F.count_if(F.col("s") != F.col("p")) / F.greatest(F.count("p"), F.lit(1))).alias("switching"))
