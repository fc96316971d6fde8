"""Soft alignment of sequences, many pairs at once, and sliding features: shapelets and random projections.

Null sequences take no part; nulls within one count as 0; an empty sequence has no distance (null)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def soft_alignment(a: np.ndarray, b: np.ndarray, gamma: float) -> np.ndarray:
    """Soft-DTW of each row of ``a`` with that row of ``b``: squared differences along the best warping, with a soft
    minimum of temperature ``gamma``. Cells of an anti-diagonal depend on the two before alone; three of these are held
    for all pairs."""
    n, m = a.shape[1], b.shape[1]
    before = np.full((len(a), n + 1), np.inf)
    last = before.copy()
    before[:, 0] = 0.0  # cell (0, 0)
    for d in range(2, n + m + 1):
        i = np.arange(max(1, d - m), min(n, d - 1) + 1)
        now = np.full((len(a), n + 1), np.inf)
        steps = np.stack([last[:, i - 1], last[:, i], before[:, i - 1]])
        least = steps.min(axis=0)
        soft = least - gamma * np.log(np.exp(-(steps - least) / gamma).sum(axis=0)) if gamma > 0 else least
        now[:, i] = (a[:, i - 1] - b[:, d - i - 1]) ** 2 + soft
        before, last = last, now
    return last[:, n]


def soft_dtw(pairs: DataFrame, gamma: float = 1.0, together: int = 512) -> DataFrame:
    """i, j, distance of ``pairs`` (i, j, a, b); pairs of equal lengths are aligned together, ``together`` at most."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = np.full(len(batch), np.nan)
            sizes = pd.DataFrame({"a": batch["a"].map(len), "b": batch["b"].map(len)}).reset_index(drop=True)
            for (n, m), at in sizes.groupby(["a", "b"]).groups.items():
                for low in range(0, len(at) if n and m else 0, together):
                    part = np.asarray(at[low : low + together])
                    x, y = (np.nan_to_num(np.array([np.asarray(v, "float64") for v in batch[c].iloc[part]])) for c in ("a", "b"))
                    out[part] = soft_alignment(x, y, gamma)
            yield batch[["i", "j"]].assign(distance=[None if np.isnan(x) else float(x) for x in out])

    kinds = {c: pairs.schema[c].dataType.simpleString() for c in ("i", "j")}
    known = pairs.where(F.col("a").isNotNull() & F.col("b").isNotNull()).select("i", "j", "a", "b")
    return known.mapInPandas(run, f"i {kinds['i']}, j {kinds['j']}, distance double")


def soft_dtw_loss(pairs: DataFrame, gamma: float = 1.0) -> DataFrame:
    """i, j, loss: the distance less the mean of both sequences' distances to themselves, which is 0 for equal ones."""
    own = [soft_dtw(pairs.select("i", "j", F.col(c).alias("a"), F.col(c).alias("b")), gamma).withColumnRenamed("distance", c) for c in ("a", "b")]
    both = soft_dtw(pairs, gamma).join(own[0], ["i", "j"]).join(own[1], ["i", "j"])
    return both.select("i", "j", (F.col("distance") - (F.col("a") + F.col("b")) / 2).alias("loss"))


def shapelets(panel: DataFrame, n: int = 8, width: int | None = None, seed: int = 3) -> list[tuple[object, int, list[float]]]:
    """(sample_id, start, values): ``n`` subsequences as candidates, from the samples of least hash (each once, as long
    as there are enough), each at a start that its hash gives. ``width``: a quarter of the longest sample."""
    known = panel.where(F.col("values").isNotNull() & (F.size("values") > 0)).select("sample_id", "values", F.xxhash64(F.lit(seed), "sample_id").alias("h"))
    size = width or max(1, int(known.agg(F.max(F.size("values"))).first()[0] or 0) // 4)
    found = known.where(F.size("values") >= size).orderBy("h", "sample_id").limit(n).collect()
    out = []
    for k in range(n if found else 0):
        row = found[k % len(found)]
        start = (row["h"] // 7 + 7919 * (k // len(found))) % (len(row["values"]) - size + 1)
        out.append((row["sample_id"], int(start), [float(x or 0.0) for x in row["values"][start : start + size]]))
    return out


def shapelet_distances(panel: DataFrame, candidates: list[list[float]]) -> DataFrame:
    """sample_id, shapelet, distance: the least root mean squared difference between a candidate and any stretch of the
    sample of its length; null where the sample is shorter. Built-in functions alone."""
    names = F.array(*[F.struct(F.lit(k).alias("shapelet"), F.array(*map(F.lit, c)).alias("c")) for k, c in enumerate(candidates)])
    rows = panel.where(F.col("values").isNotNull()).select("sample_id", F.transform("values", lambda x: F.coalesce(x.cast("double"), F.lit(0.0))).alias("v"), F.inline(names))
    apart = lambda at: F.aggregate(F.zip_with(F.slice("v", at + 1, F.size("c")), "c", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    places = F.size("v") - F.size("c")
    least = F.array_min(F.transform(F.sequence(F.lit(0), places), apart))
    return rows.select("sample_id", "shapelet", F.when(places >= 0, F.sqrt(least / F.size("c"))).alias("distance"))


def random_projection(panel: DataFrame, width: int, n: int = 16, seed: int = 42) -> DataFrame:
    """sample_id, k, value: tanh of ``n`` random Gaussian directions of vectors of ``width`` components (longer ones are
    cut to that, shorter ones padded with zeros)."""
    directions = np.random.default_rng(seed).normal(scale=1 / np.sqrt(max(1, width)), size=(width, n))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.zeros((len(batch), width))
            for i, v in enumerate(batch["values"]):
                x[i, : min(width, len(v))] = v[:width]
            y = np.tanh(np.nan_to_num(x) @ directions)
            yield pd.DataFrame({"sample_id": batch["sample_id"].repeat(n), "k": np.tile(np.arange(n), len(batch)), "value": y.ravel()})

    kind = panel.schema["sample_id"].dataType.simpleString()
    return panel.where(F.col("values").isNotNull()).select("sample_id", "values").mapInPandas(run, f"sample_id {kind}, k long, value double")
