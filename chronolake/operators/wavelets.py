"""Wavelets: filter banks as sums over exploded contributions, and the continuous transform by chunks.

Nulls aren't expected in a series (fill it first). A filter bank's level gives floor((n + taps - 1) / 2) values of a
series of n; beyond its ends a series goes on in the direction of its last step (a single value stays)."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolake.operators.chunks import SIZE, chunked, surroundings
from chronolake.operators.layouts import by_series, whole_series

SCALES = (2, 4, 10, 20)
#: Samples of a wavelet's integral, as 2 to this power.
PRECISION = 10


def daubechies(moments: int) -> list[float]:
    """Low-pass taps (2 * ``moments`` of them, largest first) of the orthogonal filter with so many vanishing moments,
    of least phase: the roots inside the unit circle of its half-band polynomial."""
    half = [math.comb(moments - 1 + k, k) for k in range(moments)]
    taps = np.ones(1)
    for y in np.roots(half[::-1]):
        z = np.roots([1, 4 * y - 2, 1])
        taps = np.convolve(taps, [1, -z[np.abs(z).argmin()]])
    for _ in range(moments):
        taps = np.convolve(taps, [1, 1])
    taps = np.real(taps)
    return (taps * math.sqrt(2) / taps.sum()).tolist()


def filtered(long: DataFrame, low: list[float]) -> DataFrame:
    """series_id, t, approximation, detail: one level of the filter bank. Every value, and what the series' ends are
    continued by, gives its share to the outputs that it reaches; these are summed by (series_id, t)."""
    n_taps = len(low)
    high = [(-1) ** (i + 1) * x for i, x in enumerate(low)]
    n, t, value = F.count("*").over(whole_series()), F.col("t"), F.col("value")
    step_on, step_back = F.lead("value").over(by_series()) - value, value - F.lag("value").over(by_series())
    rows = long.select("series_id", "t", "value", n.alias("n"), F.coalesce(step_on, F.lit(0.0)).alias("on"), F.coalesce(step_back, F.lit(0.0)).alias("back"))
    beyond = F.sequence(F.lit(1).cast("long"), F.lit(n_taps).cast("long"))
    before = F.transform(beyond, lambda s: F.struct((-s).alias("at"), (value - s * F.col("on")).alias("x")))
    after = F.transform(beyond, lambda s: F.struct((t + s).alias("at"), (value + s * F.col("back")).alias("x")))
    none = F.array().cast("array<struct<at:bigint,x:double>>")
    points = F.concat(F.array(F.struct(t.alias("at"), value.alias("x"))), F.when(t == 0, before).otherwise(none), F.when(t == F.col("n") - 1, after).otherwise(none))
    points = rows.select("series_id", "n", F.inline(points))
    first, last = F.greatest(F.ceil((F.col("at") - 1) / 2), F.lit(0).cast("long")), F.least(F.floor((F.col("at") + n_taps - 2) / 2), F.floor((F.col("n") + n_taps - 1) / 2) - 1)
    reached = points.where(first <= last).select("series_id", "at", "x", F.explode(F.sequence(first, last)).alias("k"))
    tap = (2 * F.col("k") + 1 - F.col("at")).cast("int")
    # taps from the last to the first: the sums are convolutions with the reversed filter
    parts = [F.sum(F.get(F.array(*map(F.lit, taps)), tap) * F.col("x")) for taps in (low[::-1], high)]
    return reached.groupBy("series_id", F.col("k").alias("t")).agg(parts[0].alias("approximation"), parts[1].alias("detail"))


def cascade(long: DataFrame, low: list[float], levels: int) -> DataFrame:
    """series_id, level, kind (detail, and approximation at the last level), t, value of ``levels`` levels."""
    out, current = None, long
    for level in range(1, levels + 1):
        found = filtered(current, low)
        kinds = ["detail", "approximation"] if level == levels else ["detail"]
        pairs = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in kinds])
        rows = found.select("series_id", F.lit(level).alias("level"), "t", F.inline(pairs)).select("series_id", "level", "kind", "t", "value")
        out = rows if out is None else out.unionByName(rows)
        current = found.select("series_id", "t", F.col("approximation").alias("value"))
    return out


def packet_sums(long: DataFrame, low: list[float], levels: int = 3) -> DataFrame:
    """series_id, path, total: the sums along the paths that take the approximation (a, aa, ...) or the detail (d, dd,
    ...) at every level."""
    out = None
    for kind, name in (("approximation", "a"), ("detail", "d")):
        current = long
        for level in range(1, levels + 1):
            current = filtered(current, low).select("series_id", "t", F.col(kind).alias("value"))
            rows = current.groupBy("series_id").agg(F.sum("value").alias("total")).select("series_id", F.lit(name * level).alias("path"), "total")
            out = rows if out is None else out.unionByName(rows)
    return out


#: Wavelets of the continuous transform, each with the range that it is sampled over.
WAVELETS: dict[str, tuple[Callable[[np.ndarray], np.ndarray], float]] = {
    "mexh": (lambda x: (1 - x * x) * np.exp(-x * x / 2) * 2 / (math.sqrt(3) * math.pi**0.25), 8.0),
    "morl": (lambda x: np.exp(-x * x / 2) * np.cos(5 * x), 8.0),
    "gaus1": (lambda x: -2 * x * np.exp(-x * x) / (math.pi / 2) ** 0.25, 5.0),
}


def taps_of(wavelet: str, scale: float) -> tuple[np.ndarray, int]:
    """Taps w and offset o of a scale: the transform at t is the sum of w[j] * x[t + o - j]. They are the differences
    of the wavelet's integral, read at steps of 1 / scale."""
    psi, reach = WAVELETS[wavelet]
    x = np.linspace(-reach, reach, 2**PRECISION)
    step = x[1] - x[0]
    at = (np.arange(scale * 2 * reach + 1) / (scale * step)).astype(int)
    integral = np.cumsum(psi(x) * step)[at[at < len(x)]][::-1]
    return -math.sqrt(scale) * np.diff(np.r_[0.0, integral, 0.0]), max(0, (len(integral) - 2) // 2) + 1


def continuous(long: DataFrame, wavelet: str = "mexh", scales: tuple[float, ...] = SCALES, size: int = SIZE) -> DataFrame:
    """series_id, scale, t, value of the continuous transform; a series counts as 0 beyond its ends. A task holds a
    chunk with as many values around it as the widest scale reaches."""
    taps = {s: taps_of(wavelet, s) for s in scales}
    before, after = max(len(w) - 1 - o for w, o in taps.values()), max(o for _, o in taps.values())

    def run(group: pd.DataFrame) -> pd.DataFrame:
        start, own, x = surroundings(group, before, after, size)
        x, out = np.nan_to_num(x), []
        for s, (w, o) in taps.items() if own else ():
            low = before + o - (len(w) - 1)
            y = np.convolve(x[low : low + own + len(w) - 1], w, "valid")
            out.append(pd.DataFrame({"scale": float(s), "t": np.arange(start, start + own), "value": y}))
        return pd.concat(out).assign(series_id=group["series_id"].iloc[0])[["series_id", "scale", "t", "value"]] if out else pd.DataFrame({"series_id": group["series_id"][:0], "scale": [], "t": [], "value": []})

    kind = long.schema["series_id"].dataType.simpleString()
    return chunked(long, before, after, size).groupBy("series_id", "chunk").applyInPandas(run, f"series_id {kind}, scale double, t long, value double")
