"""Detection: scores of windows and points, thresholds, regimes, events, and the risk frame."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolake.operators.layouts import by_series, whole_series
from chronolake.operators.windows import points_of, sliding, window_statistics


def z_distance(windows: DataFrame, columns: list[str]) -> DataFrame:
    """``windows`` with score: the root mean square of the columns' z-scores within their series."""
    w = whole_series()
    z = [(F.col(c) - F.avg(c).over(w)) / F.greatest(F.stddev_pop(c).over(w), F.lit(1e-8)) for c in columns]
    scored = windows.select("*", *[x.alias(f"z{i}") for i, x in enumerate(z)])
    total = sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(1, len(z))), F.col("z0") * F.col("z0"))
    return scored.withColumn("score", F.sqrt(total / len(z))).drop(*[f"z{i}" for i in range(len(z))])


def threshold(points: DataFrame, method: str) -> DataFrame:
    """series_id, threshold of the scores: ``mad`` (median + 3 MAD; the deviation where the MAD vanishes),
    ``quantile`` (0.99) or ``domain_calibrated`` (mean + 2.5 deviations)."""
    if method == "quantile":
        return points.groupBy("series_id").agg(F.percentile("score", F.lit(0.99)).alias("threshold"))
    if method == "domain_calibrated":
        return points.groupBy("series_id").agg((F.avg("score") + 2.5 * F.stddev_pop("score")).alias("threshold"))
    if method != "mad":
        raise ValueError(f"unknown method {method}")
    middle = points.groupBy("series_id").agg(F.percentile("score", F.lit(0.5)).alias("m"))
    both = points.select("series_id", "score").join(middle, "series_id").groupBy("series_id", "m").agg(F.percentile(F.abs(F.col("score") - F.col("m")), F.lit(0.5)).alias("d"), F.stddev_pop("score").alias("s"))
    return both.select("series_id", (F.col("m") + 3 * F.when(F.col("d") <= 1e-8, F.col("s")).otherwise(F.col("d"))).alias("threshold"))


def right_aligned(long: DataFrame, scores: DataFrame, limit: float) -> DataFrame:
    """series_id, t, score, label of every point: a window's score (series_id, end, score) is that of its last point, points
    before the first window's end have 0; label: 1 where the score's size is over ``limit``."""
    own = scores.select("series_id", (F.col("end") - 1).alias("t"), "score")
    rows = long.select("series_id", "t").join(own, ["series_id", "t"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    return rows.withColumn("label", (F.abs("score") > limit).cast("long"))


def quantiles(rows: DataFrame, of: dict[str, tuple[str, float]]) -> DataFrame:
    """series_id, and for each name in ``of`` (name -> column, share) that quantile of the column in its series, nulls left
    out; null where nothing is left. Between two values it is a product and a sum with one rounding, as DuckDB has it:
    Spark's percentile rounds twice, which sets values apart that are equal to the quantile but for the last bit. Ranks
    come from windows, so that a series is sorted and never held."""
    columns = sorted({c for c, _ in of.values()})
    order = {c: Window.partitionBy("series_id").orderBy(F.col(c).asc_nulls_last()) for c in columns}
    ranked = rows.select("series_id", *columns, *[F.row_number().over(order[c]).alias(f"rank_{c}") for c in columns], *[F.count(c).over(whole_series()).alias(f"n_{c}") for c in columns])
    at = {k: (F.col(f"n_{c}") - 1) * q for k, (c, q) in of.items()}
    ends = {k: [F.max(F.when(F.col(f"rank_{of[k][0]}") == f(x) + 1, F.col(of[k][0]))).alias(f"{k}_{i}") for i, f in enumerate((F.floor, F.ceil))] for k, x in at.items()}
    found = ranked.groupBy("series_id").agg(*[e for pair in ends.values() for e in pair], *[F.first(x - F.floor(x)).alias(f"{k}_d") for k, x in at.items()])

    def between(low: Column, high: Column, d: Column) -> Column:
        parts = [F.coalesce(x, F.lit(0.0)) for x in (low, 1 - d, high * d)]
        return F.when(low.isNull() | (d == 0), low).otherwise(F.java_method(F.lit("java.lang.Math"), F.lit("fma"), *parts).cast("double"))

    return found.select("series_id", *[between(F.col(f"{k}_0"), F.col(f"{k}_1"), F.col(f"{k}_d")).alias(k) for k in of])


def regimes(long: DataFrame, reference: float = 1.0) -> DataFrame:
    """series_id, t, value, step, regime: ``transition`` where the absolute step reaches its quantile 0.85, else
    ``high_load`` or ``low_load`` beyond the value's quartiles, else ``stable``. Quantiles are taken over the
    first ``reference`` of each series."""
    w = whole_series()
    step = F.coalesce(F.col("value") - F.lag("value").over(by_series()), F.lit(0.0))
    rows = long.select("series_id", "t", "value", step.alias("step"), F.count("*").over(w).alias("n"))
    known = F.col("t") < F.greatest(F.lit(1), F.floor(F.col("n") * reference))
    q = quantiles(rows.where(known).withColumn("size", F.abs("step")), {"q85": ("size", 0.85), "q75": ("value", 0.75), "q25": ("value", 0.25)})
    label = F.when(F.abs("step") >= F.col("q85"), "transition").when(F.col("value") >= F.col("q75"), "high_load").when(F.col("value") <= F.col("q25"), "low_load").otherwise("stable")
    return rows.join(q, "series_id").select("series_id", "t", "value", "step", label.alias("regime"))


def segments(labelled: DataFrame, width: int = 5) -> DataFrame:
    """series_id, start, end, regime, level, volatility (mean rolling sample deviation), slope of the runs of a regime."""
    w = by_series()
    change = F.when(F.lag("regime").over(w) == F.col("regime"), 0).otherwise(1)
    rolling = F.coalesce(F.stddev_samp("value").over(w.rowsBetween(1 - width, 0)), F.lit(0.0))
    rows = labelled.select("*", change.alias("change"), rolling.alias("rolling"))
    rows = rows.withColumn("run", F.sum("change").over(w))
    return (
        rows.groupBy("series_id", "run")
        .agg(
            F.min("t").alias("start"),
            F.max("t").alias("end"),
            F.first("regime").alias("regime"),
            F.avg("value").alias("level"),
            F.avg("rolling").alias("volatility"),
            F.avg("step").alias("slope"),
        )
        .drop("run")
    )


def regime_threshold(points: DataFrame, labelled: DataFrame) -> DataFrame:
    """The ``quantile`` threshold of the points outside transitions."""
    calm = labelled.where("regime <> 'transition'").select("series_id", "t")
    return threshold(points.join(calm, ["series_id", "t"]), "quantile")


def events(points: DataFrame, limits: DataFrame, least: int = 1) -> DataFrame:
    """series_id, start, end, peak_t (first highest), peak, mean of the runs of scores at or above the limit."""
    hit = points.join(limits, "series_id").where(F.col("score") >= F.col("threshold"))
    hit = hit.withColumn("island", F.col("t") - F.row_number().over(by_series()))
    found = hit.groupBy("series_id", "island").agg(
        F.min("t").alias("start"),
        F.max("t").alias("end"),
        F.count("*").alias("length"),
        F.max_by(F.col("t"), F.struct("score", -F.col("t"))).alias("peak_t"),
        F.max("score").alias("peak"),
        F.avg("score").alias("mean"),
    )
    return found.where(F.col("length") >= least).drop("island")


def risk_frame(found: DataFrame, parts: DataFrame) -> DataFrame:
    """Events with the regime of the segment that holds their peak.

    Segments tile a series, so the interval join is an equality: each segment explodes into its points."""
    at = parts.select("series_id", F.explode(F.sequence("start", "end")).alias("peak_t"), "regime", "level")
    return found.join(at, ["series_id", "peak_t"], "left")


def probabilities(points: DataFrame, limits: DataFrame) -> DataFrame:
    """Sigmoid of the distance to the threshold in deviations of the scores."""
    s = F.stddev_pop("score").over(whole_series())
    scale: Column = F.when(s <= 1e-8, F.greatest(F.col("threshold"), F.lit(1.0))).otherwise(s)
    return points.join(limits, "series_id").select("series_id", "t", (1 / (1 + F.exp(-(F.col("score") - F.col("threshold")) / scale))).alias("probability"))


def _moments(rows: DataFrame, columns: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Means and sample covariances of columns: one row of sums."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    r = rows.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)], *[F.covar_samp(columns[i], columns[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    cov = np.zeros((len(columns), len(columns)))
    for i, j in pairs:
        cov[i, j] = cov[j, i] = r[f"c{i}_{j}"]
    return np.array([r[f"m{i}"] for i in range(len(columns))]), cov


def align(source: DataFrame, target: DataFrame, columns: list[str], epsilon: float = 1e-6) -> DataFrame:
    """``source`` with its columns transformed to the means and covariances of ``target``'s: whitened by its own
    covariance, coloured by the other. Columns squared come to the driver, no rows."""
    (m, a), (n, b) = _moments(source, columns), _moments(target, columns)

    def power(cov: np.ndarray, p: float) -> np.ndarray:
        values, vectors = np.linalg.eigh(cov + epsilon * np.eye(len(columns)))
        return (vectors * np.maximum(values, epsilon) ** p) @ vectors.T

    w = power(a, -0.5) @ power(b, 0.5)
    new = {c: sum(((F.col(x) - float(m[i])) * float(w[i, k]) for i, x in enumerate(columns)), F.lit(float(n[k]))) for k, c in enumerate(columns)}
    return source.withColumns(new)


def transfer_report(rows: DataFrame, domain: str, source: str, target: str, columns: list[str]) -> DataFrame:
    """column, n_source, n_target, source_mean, target_mean, mean_shift, source_std, target_std of two domains."""
    sides = {"source": F.col(domain) == source, "target": F.col(domain) == target}
    parts = []
    for c in columns:
        of = {k: F.when(v, F.col(c)) for k, v in sides.items()}
        parts.append(F.struct(F.lit(c).alias("column"), *[F.count_if(v).alias(f"n_{k}") for k, v in sides.items()], *[F.avg(x).alias(f"{k}_mean") for k, x in of.items()], *[F.stddev_pop(x).alias(f"{k}_std") for k, x in of.items()]))
    out = rows.agg(F.array(*parts).alias("p")).select(F.explode("p").alias("p")).select("p.*")
    return out.withColumn("mean_shift", F.col("target_mean") - F.col("source_mean"))


def detect(long: DataFrame, width: int = 8, stride: int = 2) -> DataFrame:
    """The whole chain: windows, statistics, scores, points, MAD threshold, events, regimes."""
    windows = window_statistics(sliding(long, width, stride))
    points = points_of(z_distance(windows, ["mean", "std", "min", "max", "trend"]), long, "score")
    found = events(points, threshold(points, "mad"))
    return risk_frame(found, segments(regimes(long)))
