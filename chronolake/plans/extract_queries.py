"""Queries over feature tables by name, their reduction, normalisers, metrics by name, and greedy ensembles."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronolake.operators import detect, extract, features, learn, windows
from chronolake.plans.inputs import LABELLED, LONG, labelled, long, panel, query
from chronolake.plans.model_queries import _scores
from chronolake.plans.series_queries import BASIC_SQL


def swing(rows):
    """A generator of the caller's own: the mean absolute step and the sum of each series."""
    step = features.by_series()
    moved = rows.withColumn("d", F.abs(F.col("value") - F.lag("value").over(step)))
    return moved.groupBy("series_id").agg(F.avg("d").alias("step"), F.sum("value").alias("total"))


query(
    "extract_custom",
    lambda s, d: extract.feature_table(long(s, d), ["basic", swing]),
    f"{LONG}, SW AS (SELECT series_id, value, abs(value - lag(value) OVER (PARTITION BY series_id ORDER BY t)) AS d FROM L), SB AS (SELECT series_id, {BASIC_SQL} FROM L GROUP BY 1) "
    f"||| SELECT series_id, {', '.join(f'{c} AS basic_{c}' for c in features.BASIC)}, coalesce(st, 0) AS swing_step, tt AS swing_total FROM SB JOIN (SELECT series_id, avg(d) AS st, sum(value) AS tt FROM SW GROUP BY 1) USING (series_id)",
    " ".join([*(f"basic_{c}" for c in features.BASIC), "swing_step", "swing_total"]),
)


def _table(s, d):
    return extract.feature_table(long(s, d), ["basic", "moments", "sequence"])


def _reduced(s, d):
    table = _table(s, d)
    model = extract.reduction(table, "series_id")
    cells = F.array(*[F.struct(F.lit(i).alias("component"), F.col(f"c{i}").alias("score")) for i in range(model.vectors.shape[1])])
    return model.transform(table).select("series_id", F.inline(cells))


query("tabular_reduced", _reduced, doubles="score")


def _choice(s, d):
    name, found = extract.best_table({n: extract.feature_table(long(s, d), [n]) for n in ("basic", "moments", "sequence")}, "series_id")
    rows = [(n, len(m.ratios), float(m.ratios.sum()), n == name) for n, m in found.items()]
    return s.createDataFrame(rows, "name string, components long, explained double, best boolean")


query("variance_choice", _choice, doubles="explained")


def _discriminative(s, d):
    table = extract.feature_table(long(s, d), ["basic"])
    return extract.discriminative(table, extract.reduction(table, "series_id", 1.0, 0.05))


query("discriminative_columns", _discriminative, doubles="correlation")


def over_ten(y, p):
    """A metric of the caller's own: the share of errors over ten."""
    return F.avg((F.abs(y - p) > 10).cast("double"))


query(
    "metric_custom",
    lambda s, d: extract.evaluated(labelled(s, d).withColumn("y", F.col("score")).withColumn("p", F.col("prob") * 100), "y", "p", ["mae", "rmse", "bias", over_ten], ["lang"]),
    f"{LABELLED} ||| SELECT lang, avg(abs(score - prob * 100)) AS mae, sqrt(avg(power(score - prob * 100, 2))) AS rmse, avg(prob * 100 - score) AS bias, avg(CASE WHEN abs(score - prob * 100) > 10 THEN 1.0 ELSE 0.0 END) AS over_ten FROM M GROUP BY 1",
    "mae rmse bias over_ten",
)


def _modalities(s, d):
    stats = features.basic(long(s, d))
    fitted = extract.normaliser(stats.where("series_id % 5 <> 0"), {"level": (["mean", "median"], ["standard"]), "spread": (["std", "max"], ["log1p", "min_max"])})
    return fitted.transform(stats).select("series_id", "mean", "median", "std", "max")


query(
    "normalised_modalities",
    _modalities,
    f"{LONG}, SB AS (SELECT series_id, {BASIC_SQL} FROM L GROUP BY 1), LG AS (SELECT series_id, mean, median, ln(1 + greatest(std, 0)) AS std, ln(1 + greatest(max, 0)) AS max FROM SB), "
    "TN AS (SELECT avg(mean) AS m1, stddev_pop(mean) AS s1, avg(median) AS m2, stddev_pop(median) AS s2, min(std) AS a3, max(std) AS b3, min(max) AS a4, max(max) AS b4 FROM LG WHERE series_id % 5 <> 0) "
    "||| SELECT series_id, (mean - m1) / greatest(s1, 1e-6) AS mean, (median - m2) / greatest(s2, 1e-6) AS median, (std - a3) / greatest(b3 - a3, 1e-6) AS std, (max - a4) / greatest(b4 - a4, 1e-6) AS max FROM LG, TN",
    "mean median std max",
)
query(
    "lagged_detector",
    lambda s, d: detect.right_aligned(long(s, d), windows.window_statistics(windows.sliding(long(s, d), 8, 1)).select("series_id", "end", F.col("std").alias("score")), 130.0),
    f"{LONG}, LW AS (SELECT series_id, t, stddev_pop(value) OVER w AS s, count(*) OVER w AS k FROM L WINDOW w AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)) "
    "||| SELECT series_id, t, CASE WHEN k = 8 THEN s ELSE 0 END AS score, CAST(k = 8 AND s > 130 AS BIGINT) AS label FROM LW",
    "score",
)
query("greedy_ensemble", lambda s, d: learn.greedy_ensemble(_scores(s, d), panel(s, d).select("sample_id", (F.col("target") % 3).alias("target"))).withColumn("models", F.array_join("models", ",")), doubles="accuracy")
