"""Parametric spectra, from lagged products that Spark sums: Yule-Walker, Burg and ARMA models of each series.

A series' values are taken about its mean. What is solved is as large as the model's order. Nulls count as no
value: products that hold one are left out. A constant or empty series has noise 0 and coefficients 0; a series
that isn't longer than an order has coefficients 0 from there on."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolake.operators.layouts import by_series, whole_series

#: Below this share of a series' variance nothing is left to explain.
NOTHING = 1e-12


def _about_mean(long: DataFrame) -> DataFrame:
    return long.select("series_id", "t", (F.col("value") - F.avg("value").over(whole_series())).alias("e"))


def autocovariances(long: DataFrame, most: int) -> DataFrame:
    """series_id, n, c: the biased autocovariances of lags 0 to ``most``, in one sorted pass."""
    products = [(F.col("e") * F.lag("e", k).over(by_series()) if k else F.col("e") * F.col("e")).alias(f"p{k}") for k in range(most + 1)]
    rows = _about_mean(long).select("series_id", "e", *products)
    sums = rows.groupBy("series_id").agg(F.count("e").alias("n"), *[F.coalesce(F.sum(f"p{k}"), F.lit(0.0)).alias(f"s{k}") for k in range(most + 1)])
    return sums.select("series_id", "n", F.array(*[F.coalesce(F.try_divide(F.col(f"s{k}"), F.col("n")), F.lit(0.0)) for k in range(most + 1)]).alias("c"))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda x, y: x + y)


def yule_walker(long: DataFrame, order: int = 5) -> DataFrame:
    """series_id, n, noise, a: x[t] = sum of a[i] * x[t - i] + noise, by Levinson's recursion over an array."""
    c = autocovariances(long, order)

    def longer(state: Column, m: Column) -> Column:
        a, e = state["a"], state["e"]
        ahead = F.reverse(F.slice("c", 2, m - 1))  # c[m - 1], ..., c[1]
        share = F.try_divide(F.get("c", m) - _dot(a, ahead), e)
        k = F.when((e > NOTHING * F.get("c", F.lit(0))) & (m < F.col("n")), share).otherwise(0.0)
        grown = F.concat(F.zip_with(a, F.reverse(a), lambda x, y: x - k * y), F.array(k))
        return F.struct(grown.alias("a"), (e * (1 - k * k)).alias("e"))

    start = F.struct(F.array().cast("array<double>").alias("a"), F.get("c", F.lit(0)).alias("e"))
    model = F.aggregate(F.sequence(F.lit(1), F.lit(order)), start, longer)
    return c.select("series_id", "n", model.alias("m")).select("series_id", "n", F.col("m.e").alias("noise"), F.col("m.a").alias("a"))


def burg(long: DataFrame, order: int = 5) -> DataFrame:
    """series_id, n, noise, a as ``yule_walker``'s, by Burg's recursion: its sums of forward times backward errors are
    forms in the sums of products of the last ``order`` + 1 values, which one pass gives, and in the first values."""
    p, pairs = order, [(i, j) for i in range(order + 1) for j in range(i, order + 1)]
    lags = [(F.lag("e", k).over(by_series()) if k else F.col("e")).alias(f"x{k}") for k in range(p + 1)]
    rows = _about_mean(long).where(F.col("e").isNotNull()).select("series_id", "t", *lags)
    place = F.row_number().over(by_series()) - 1
    rows = rows.withColumn("place", place)
    late = F.col("place") >= p
    sums = [F.coalesce(F.sum(F.when(late, F.col(f"x{i}") * F.col(f"x{j}"))), F.lit(0.0)).alias(f"s{i}_{j}") for i, j in pairs]
    head = F.sort_array(F.collect_list(F.when(F.col("place") < p, F.struct("place", "x0"))))
    thin = rows.groupBy("series_id").agg(F.count("*").alias("n"), F.sum(F.col("x0") * F.col("x0")).alias("all"), head.alias("head"), *sums)
    thin = thin.select("series_id", "n", "all", F.transform("head", lambda h: h["x0"]).alias("head"), F.array(*[f"s{i}_{j}" for i, j in pairs]).alias("s"))

    def solved(n: int, whole: float, head: np.ndarray, s: np.ndarray) -> tuple[float, np.ndarray]:
        late = np.zeros((p + 1, p + 1))
        for (i, j), x in zip(pairs, s, strict=True):
            late[i, j] = late[j, i] = x
        a, e = np.ones(1), whole / n
        for m in range(1, p + 1):
            k = 0.0
            if n > m and e > NOTHING * whole / n:
                c = late.copy()
                for t in range(m, min(p, n)):
                    c[: m + 1, : m + 1] += np.outer(head[t - m : t + 1][::-1], head[t - m : t + 1][::-1])
                ahead, behind = np.r_[a, 0.0], np.r_[0.0, a[::-1]]
                c = c[: m + 1, : m + 1]
                down = ahead @ c @ ahead + behind @ c @ behind
                k = -2 * (ahead @ c @ behind) / down if down > 0 else 0.0
            a, e = np.r_[a, 0.0] + k * np.r_[0.0, a[::-1]], e * (1 - k * k)
        return e, -a[1:]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [solved(n, w, np.asarray(h, "float64"), np.asarray(s)) for n, w, h, s in zip(batch["n"], batch["all"], batch["head"], batch["s"], strict=True)]
            yield batch[["series_id", "n"]].assign(noise=[e for e, _ in found], a=[a for _, a in found])

    kind = long.schema["series_id"].dataType.simpleString()
    return thin.mapInPandas(run, f"series_id {kind}, n long, noise double, a array<double>")


def arma(long: DataFrame, p: int = 2, q: int = 1, reach: int = 8) -> DataFrame:
    """series_id, n, noise, a, b: x[t] = sum of a[i] * x[t - i] + noise[t] + sum of b[j] * noise[t - j]. The first part by
    least squares on the autocovariances of lags q + 1 to q + ``reach``; the second by Durbin's long model (of
    ``reach`` lags) of what it leaves, whose autocovariances follow from the series'."""
    c = autocovariances(long, q + reach + p)

    def levinson(r: np.ndarray, order: int) -> tuple[np.ndarray, float]:
        a, e = np.empty(0), float(r[0])
        for m in range(1, order + 1):
            k = (r[m] - a @ r[m - 1 : 0 : -1]) / e if e > NOTHING * r[0] else 0.0
            a, e = np.r_[a - k * a[::-1], k], e * (1 - k * k)
        return a, e

    def solved(n: int, r: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        if n <= q + reach + p or r[0] <= 0:
            return max(float(r[0]), 0.0), np.zeros(p), np.zeros(q)
        lags = q + 1 + np.arange(reach)
        a = np.linalg.lstsq(r[np.abs(lags[:, None] - 1 - np.arange(p)[None, :])], r[lags], rcond=None)[0]
        whole = np.r_[1.0, -a]
        shift = np.arange(p + 1)[:, None] - np.arange(p + 1)[None, :]
        rest = np.array([whole @ r[np.abs(k + shift)] @ whole for k in range(reach + 1)])
        far, noise = levinson(rest, reach) if rest[0] > 0 else (np.zeros(reach), 0.0)
        row = np.r_[1.0, -far]
        of_row = np.array([row[: len(row) - k] @ row[k:] for k in range(q + 1)])
        return noise, a, -levinson(of_row, q)[0]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [solved(n, np.asarray(r)) for n, r in zip(batch["n"], batch["c"], strict=True)]
            yield batch[["series_id", "n"]].assign(noise=[x[0] for x in found], a=[x[1] for x in found], b=[x[2] for x in found])

    kind = long.schema["series_id"].dataType.simpleString()
    return c.mapInPandas(run, f"series_id {kind}, n long, noise double, a array<double>, b array<double>")


def _response(coefficients: str, w: Column, sign: float) -> Column:
    """|1 + sign * sum of c[i] * exp(-iwi)| squared."""

    def total(turn) -> Column:
        return F.aggregate(F.transform(coefficients, lambda x, i: x * turn(w * (i + 1))), F.lit(0.0), lambda x, y: x + y)

    real, imaginary = 1 + sign * total(F.cos), total(F.sin)
    return real * real + imaginary * imaginary


def model_power(models: DataFrame, bins: int = 16) -> DataFrame:
    """series_id, bin, frequency (turns a step, below a half), power of ``models``."""
    rows = models.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long")))).withColumn("frequency", F.col("bin") / (2.0 * bins))
    w = F.col("frequency") * (2 * np.pi)
    top = _response("b", w, 1.0) if "b" in models.columns else F.lit(1.0)
    return rows.select("series_id", "bin", "frequency", (F.col("noise") * top / F.greatest(_response("a", w, -1.0), F.lit(1e-300))).alias("power"))


def power_summary(power: DataFrame) -> DataFrame:
    """series_id, mean, variance, rms, peak, peak_frequency, energy, crest of a spectrum; crest is 0 without power."""
    top = F.max_by("frequency", F.struct("power", -F.col("frequency")))
    rms = F.sqrt(F.avg(F.col("power") * F.col("power")))
    crest = F.coalesce(F.try_divide(F.max("power"), rms), F.lit(0.0))
    return power.groupBy("series_id").agg(
        F.avg("power").alias("mean"), F.var_pop("power").alias("variance"), rms.alias("rms"), F.max("power").alias("peak"), top.alias("peak_frequency"), F.sum("power").alias("energy"), crest.alias("crest")
    )


def leading_power(power: DataFrame, share: float = 0.9, inside: bool = True) -> DataFrame:
    """``power`` with 0 for the bins below the quantile ``share`` of their series (``inside`` false: for the others)."""
    q = power.groupBy("series_id").agg(F.percentile("power", F.lit(share)).alias("q"))
    high = F.col("power") >= F.col("q")
    return power.join(q, "series_id").withColumn("power", F.when(high if inside else ~high, F.col("power")).otherwise(0.0)).drop("q")
