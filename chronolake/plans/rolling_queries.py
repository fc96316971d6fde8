"""Queries over rolling origins, intervals, hybrid weights, recurrence measures, kernels and pairwise learning."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronolake.operators import detect, features, forecast, kernels, learn, matrix, metrics, rolling
from chronolake.plans.inputs import LABELLED, LONG, PANEL, labelled, long, panel, query, read
from chronolake.plans.record_queries import CLASSES, CONFUSION, RECUR, TRUTH, _predicted, _train
from chronolake.plans.series_queries import BASIC_SQL

# origins 5 apart from 5 values on; the drift of the values before, fitted at every second origin
ROLLING = (
    f"{LONG}, RN0 AS (SELECT series_id, count(*) AS n FROM L GROUP BY 1 HAVING count(*) > 5), RO AS (SELECT series_id, n, i AS step, 5 + 5 * i AS train_end FROM (SELECT series_id, n, unnest(range(0, (n - 6) // 5 + 1)) AS i FROM RN0)), "
    "RF AS (SELECT series_id, t + 1 AS at, value AS level, CASE WHEN t > 0 THEN (value - first_value(value) OVER (PARTITION BY series_id ORDER BY t)) / t ELSE 0 END AS slope FROM L), "
    "RH AS (SELECT RO.*, 5 + 5 * (step - step % 2) AS at, unnest(range(1, least(5, n - train_end) + 1)) AS h FROM RO), "
    "RR0 AS (SELECT RH.series_id, RH.step, RH.train_end, RH.at = RH.train_end AS refit, RH.h, L.value AS y_true, RF.level + RF.slope * RH.h AS y_pred FROM RH JOIN RF ON RH.series_id = RF.series_id AND RH.at = RF.at JOIN L ON RH.series_id = L.series_id AND L.t = RH.train_end + RH.h - 1)"
)


def _rolled(s, d):
    return rolling.rolling_forecasts(long(s, d), 5, "drift", 5, refit="periodic", every=2)


query("rolling_forecasts", _rolled, f"{ROLLING} ||| SELECT * FROM RR0", "y_true y_pred", 9)
STEP = "RE AS (SELECT series_id, step, train_end, avg(abs(y_true - y_pred)) AS mae, sqrt(avg((y_true - y_pred) * (y_true - y_pred))) AS rmse FROM RR0 GROUP BY 1, 2, 3)"
query("rolling_step_errors", lambda s, d: rolling.step_errors(_rolled(s, d)), f"{ROLLING}, {STEP} ||| SELECT * FROM RE", "mae rmse")
query("rolling_summary", lambda s, d: rolling.summary(_rolled(s, d)), f"{ROLLING}, {STEP} ||| SELECT series_id, count(*) AS steps, avg(mae) AS mae, avg(rmse) AS rmse FROM RE GROUP BY 1", "mae rmse")
query("rolling_drift_refit", lambda s, d: rolling.step_errors(rolling.rolling_forecasts(long(s, d), 5, "mean", 5, 20, "drift", drift=60.0)))
INTERVALS = (
    f"{ROLLING}, RS0 AS (SELECT series_id, step, count(*) AS n, sum(y_true - y_pred) AS s, sum((y_true - y_pred) * (y_true - y_pred)) AS q FROM RR0 GROUP BY 1, 2), "
    "RP0 AS (SELECT series_id, step, coalesce(sum(n) OVER w, 0) AS n, sum(s) OVER w AS s, sum(q) OVER w AS q FROM RS0 WINDOW w AS (PARTITION BY series_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), "
    "RI AS (SELECT series_id, step, n >= 10 AS enough, 1.6448536269514715 * greatest(coalesce(sqrt(greatest(q / n - (s / n) * (s / n), 0)), 0), 1e-6) AS r FROM RP0), "
    "IV AS (SELECT series_id, step, h, y_true, y_pred, y_pred - r AS low, y_pred + r AS high, enough FROM RR0 JOIN RI USING (series_id, step))"
)
query("forecast_intervals", lambda s, d: rolling.intervals(_rolled(s, d)), f"{INTERVALS} ||| SELECT * FROM IV", "y_true y_pred low high", 9)
query("interval_coverage", lambda s, d: rolling.coverage(rolling.intervals(_rolled(s, d))), f"{INTERVALS} ||| SELECT series_id, avg(CASE WHEN y_true BETWEEN low AND high THEN 1.0 ELSE 0.0 END) AS coverage, avg(high - low) AS width FROM IV WHERE enough GROUP BY 1", "coverage width")
query(
    "conformal_intervals",
    lambda s, d: learn.split_conformal(_rolled(s, d).select("series_id", (F.col("y_true") - F.col("y_pred")).alias("e")), forecast.naive(long(s, d), 3, "drift")),
    f"{ROLLING}, CQ AS (SELECT series_id, quantile_cont(abs(y_true - y_pred), 0.9) AS q FROM RR0 GROUP BY 1), CD AS (SELECT series_id, arg_max(value, t) AS l, (arg_max(value, t) - arg_min(value, t)) / (count(*) - 1) AS s FROM L GROUP BY 1) "
    "||| SELECT series_id, h, l + s * h AS y, l + s * h - q AS low, l + s * h + q AS high FROM CQ JOIN CD USING (series_id), (SELECT unnest(range(1, 4)) AS h)",
    "y low high",
)
query(
    "metric_pointwise",
    lambda s, d: metrics.pointwise(_train(s, d), _predicted(s, d), forecast.naive(_train(s, d), 5, "mean"), 2),
    f"{TRUTH}, SL AS (SELECT series_id, CASE WHEN coalesce(avg(d), 0) <= 1e-8 THEN 1 ELSE avg(d) END AS sc FROM (SELECT series_id, abs(value - lag(value, 2) OVER (PARTITION BY series_id ORDER BY t)) AS d FROM TR) GROUP BY 1), "
    "PW AS (SELECT series_id, h, abs(y_true - y_pred) AS e, abs(y_true - base) AS e0, 200 * abs(y_true - y_pred) / greatest(1e-8, abs(y_true) + abs(y_pred)) AS s1, 200 * abs(y_true - base) / greatest(1e-8, abs(y_true) + abs(base)) AS s0, sc FROM PR JOIN SL USING (series_id)) "
    "||| SELECT series_id, h, e AS pw_mae, e AS pw_rmse, s1 AS pw_smape, e / sc AS pw_mase, 0.5 * (s1 / greatest(s0, 1e-8) + (e / sc) / greatest(e0 / sc, 1e-8)) AS pw_owa FROM PW",
    "pw_mae pw_rmse pw_smape pw_mase pw_owa",
    5,
)
query(
    "metric_averaged",
    lambda s, d: metrics.averaged(labelled(s, d)),
    f"{LABELLED}, {CONFUSION}, {CLASSES} ||| SELECT sum(recall * support) / sum(support) AS micro, CASE WHEN count(*) = 2 THEN arg_min(precision, (support, label)) ELSE avg(precision) END AS precision_auto, CASE WHEN count(*) = 2 THEN arg_min(recall, (support, label)) ELSE avg(recall) END AS recall_auto, "
    "CASE WHEN count(*) = 2 THEN arg_min(f1, (support, label)) ELSE sum(f1 * support) / sum(support) END AS f1_auto FROM PC",
    "micro precision_auto recall_auto f1_auto",
)


def _class_scores(s, d):
    """Each sample's label with a score for every class, from its vector."""
    classes = panel(s, d).select(F.col("target").alias("class")).distinct()
    rows = panel(s, d).select("sample_id", F.col("target").alias("y_true"), "values")
    score = F.abs(F.get("values", F.pmod(F.col("class"), F.size("values")))) + 0.01
    return rows.join(F.broadcast(classes)).select("sample_id", "y_true", "class", score.alias("score"))


CLASS_SCORES = f"{PANEL}, CL AS (SELECT DISTINCT target AS c FROM P), KS AS (SELECT sample_id, target AS y_true, c, abs(v[c % len(v) + 1]) + 0.01 AS s FROM P, CL)"
query(
    "metric_multiclass_logloss",
    lambda s, d: metrics.multiclass_log_loss(_class_scores(s, d).withColumnRenamed("score", "prob")),
    f"{CLASS_SCORES}, KP AS (SELECT *, s / sum(s) OVER (PARTITION BY sample_id) AS p FROM KS) ||| SELECT -avg(ln(p)) AS log_loss FROM KP WHERE y_true = c",
    "log_loss",
)
query(
    "metric_ovr_auc",
    lambda s, d: metrics.one_against_rest_auc(_class_scores(s, d)),
    f"{CLASS_SCORES}, KR AS (SELECT c, y_true = c AS own, rank() OVER (PARTITION BY c ORDER BY s) + (count(*) OVER (PARTITION BY c, s) - 1) / 2 AS r FROM KS), "
    "KA AS (SELECT c, (sum(r) FILTER (own) - count(*) FILTER (own) * (count(*) FILTER (own) + 1) / 2) / (count(*) FILTER (own) * count(*) FILTER (NOT own)) AS a FROM KR GROUP BY 1) ||| SELECT avg(a) AS roc_auc FROM KA",
    "roc_auc",
)
query(
    "hybrid_weights",
    lambda s, d: forecast.hybrid(
        forecast.naive(_train(s, d), 5, "last").withColumn("model", F.lit("last")).unionByName(forecast.naive(_train(s, d), 5, "mean").withColumn("model", F.lit("mean"))),
        _predicted(s, d).select("series_id", "h", F.col("y_true").alias("value")),
    ),
    # two constant forecasts are parallel: the pseudo-inverse's weights are their values, scaled alike
    f"{TRUTH}, HW AS (SELECT series_id, any_value(lst) AS a, any_value(m) AS b, avg(y_true) AS y FROM TE JOIN DR USING (series_id) GROUP BY 1), HC AS (SELECT series_id, greatest(a * y, 0) AS x, greatest(b * y, 0) AS z FROM HW) "
    "||| SELECT series_id, 'last' AS model, CASE WHEN x + z > 0 THEN x / (x + z) ELSE 0.5 END AS weight FROM HC UNION ALL SELECT series_id, 'mean', CASE WHEN x + z > 0 THEN z / (x + z) ELSE 0.5 END FROM HC",
    "weight",
)

# ---- recurrence measures: line lengths from all pairs of points
LINES = (
    f"{RECUR}, RA AS (SELECT * FROM RP UNION ALL SELECT series_id, t, t FROM L), AP AS (SELECT a.series_id, a.t AS i, b.t AS j FROM L a JOIN L b ON a.series_id = b.series_id), RW AS (SELECT * FROM AP EXCEPT SELECT * FROM RA), "
    "LD AS (SELECT series_id, count(*) AS len FROM (SELECT series_id, j - i AS d, i - row_number() OVER (PARTITION BY series_id, j - i ORDER BY i) AS r FROM RP WHERE j > i) GROUP BY series_id, d, r), "
    "LV AS (SELECT series_id, count(*) AS len FROM (SELECT series_id, i, j - row_number() OVER (PARTITION BY series_id, i ORDER BY j) AS r FROM RA) GROUP BY series_id, i, r), "
    "LW AS (SELECT series_id, count(*) AS len FROM (SELECT series_id, i, j - row_number() OVER (PARTITION BY series_id, i ORDER BY j) AS r FROM RW) GROUP BY series_id, i, r), "
    "LL AS (SELECT series_id, 'diagonal' AS kind, len AS length, count(*) AS n FROM LD GROUP BY ALL UNION ALL SELECT series_id, 'vertical', len, count(*) FROM LV GROUP BY ALL UNION ALL SELECT series_id, 'white', len, count(*) FROM LW GROUP BY ALL)"
)
query("recurrence_lines", lambda s, d: matrix.line_lengths(long(s, d)), f"{LINES} ||| SELECT * FROM LL")


def _of(kind: str, value: str, least: int = 1) -> str:
    return f"coalesce(sum({value}) FILTER (kind = '{kind}' AND length >= {least}), 0)"


def _entropy(kind: str, least: int) -> str:
    total = _of(kind, "n", least)
    return f"CASE WHEN {total} > 0 THEN ln({total}) - {_of(kind, 'n * ln(n)', least)} / {total} ELSE 0.0 END"


query(
    "recurrence_measures",
    lambda s, d: matrix.recurrence_measures(long(s, d)),
    f"{LINES}, SZ AS (SELECT series_id, count(*) AS size FROM L GROUP BY 1), MS AS (SELECT series_id, {_of('vertical', 'n * length')} / (any_value(size) * any_value(size)) AS rr, {_of('diagonal', 'n * length', 3)} / nullif({_of('diagonal', 'n * length')}, 0) AS det, "
    f"(2 * {_of('diagonal', 'n * length', 3)} + CASE WHEN any_value(size) >= 3 THEN any_value(size) ELSE 0 END) / nullif(2 * {_of('diagonal', 'n', 3)} + CASE WHEN any_value(size) >= 3 THEN 1 ELSE 0 END, 0) AS adll, any_value(size) AS ldll, 1 / any_value(size) AS div, {_entropy('diagonal', 3)} AS edl, "
    f"{_of('vertical', 'n * length', 3)} / nullif({_of('vertical', 'n * length')}, 0) AS lam, {_of('vertical', 'n * length', 3)} / nullif({_of('vertical', 'n', 3)}, 0) AS avll, coalesce(max(length) FILTER (kind = 'vertical'), 1) AS lvll, {_entropy('vertical', 3)} AS evl, "
    f"{_of('white', 'n * length', 2)} / nullif({_of('white', 'n', 2)}, 0) AS awll, coalesce(max(length) FILTER (kind = 'white'), 1) AS lwll, {_entropy('white', 2)} AS ewll FROM LL JOIN SZ USING (series_id) GROUP BY 1) "
    "||| SELECT *, det / nullif(rr, 0) AS rdrr, lam / nullif(det, 0) AS rld FROM MS",
    "rr det adll div edl lam avll evl awll ewll rdrr rld",
)

# ---- kernels of all samples with landmarks, the sixteen of least id
KERNEL = (
    f"{PANEL}, A0 AS (SELECT * FROM P ORDER BY sample_id LIMIT 16), KM AS (SELECT a.sample_id AS i, b.sample_id AS j, a.target AS c, exp(-0.5 * power(list_distance(a.v, b.v), 2)) AS k FROM P a, A0 b), "
    "KZ AS (SELECT i, j, k - avg(k) OVER (PARTITION BY j) AS z FROM KM), KY AS (SELECT sample_id AS i, c, CAST(target = c AS INT) - avg(CAST(target = c AS INT)) OVER (PARTITION BY c) AS y FROM P, (SELECT DISTINCT target AS c FROM P)), "
    "KK AS (SELECT sum(s * s) AS kk FROM (SELECT sum(a.z * b.z) AS s FROM KZ a JOIN KZ b ON a.i = b.i GROUP BY a.j, b.j)), KI AS (SELECT sum(s * s) AS ky FROM (SELECT sum(z * y) AS s FROM KZ JOIN KY USING (i) GROUP BY j, c)), "
    "YY AS (SELECT sum(s * s) AS yy FROM (SELECT sum(a.y * b.y) AS s FROM KY a JOIN KY b ON a.i = b.i GROUP BY a.c, b.c))"
)


def _landmark_kernel(s, d):
    return kernels.landmark_kernel(panel(s, d), *kernels.first_landmarks(panel(s, d), 16), "rbf", 0.5)


def _alignment(s, d):
    products = kernels.kernel_products(panel(s, d), {"rbf": ("rbf", 0.5)}, kernels.first_landmarks(panel(s, d), 16)[1], whole=False)
    return s.createDataFrame([(products.n, products.likeness(0, 1))], "n long, alignment double")


query("kernel_centred", lambda s, d: kernels.centred_landmarks(_landmark_kernel(s, d)), f"{KERNEL} ||| SELECT i, j, k - avg(k) OVER (PARTITION BY i) - avg(k) OVER (PARTITION BY j) + avg(k) OVER () AS k FROM KM", "k")
query("kernel_alignment", _alignment, f"{KERNEL} ||| SELECT (SELECT count(*) FROM P WHERE target IS NOT NULL) AS n, ky / sqrt(kk * yy) AS alignment FROM KK, KI, YY", "alignment")


# ---- channels: the four quarters of a vector
def _channels(s, d):
    quarter = F.floor(F.size("values") / 4).cast("int")
    channel = F.explode(F.sequence(F.lit(0), F.lit(3))).alias("channel")
    rows = panel(s, d).select("sample_id", "target", "values", quarter.alias("q"), channel)
    return rows.select("sample_id", "target", "channel", F.slice("values", F.col("channel") * F.col("q") + 1, F.col("q")).alias("values"))


query(
    "channel_covariances",
    lambda s, d: matrix.covariances(_channels(s, d).drop("target")),
    f"{PANEL}, CH AS (SELECT sample_id, c, list_slice(v, c * (len(v) // 4) + 1, (c + 1) * (len(v) // 4)) AS x FROM P, (SELECT CAST(unnest(range(0, 4)) AS INT) AS c)) "
    "||| SELECT a.sample_id, a.c, b.c AS d, list_avg(list_transform(list_zip(a.x, b.x), lambda p: (p[1] - list_avg(a.x)) * (p[2] - list_avg(b.x)))) AS cov FROM CH a JOIN CH b ON a.sample_id = b.sample_id AND a.c <= b.c",
    "cov",
)
query("tangent_features", lambda s, d: matrix.tangent_features(matrix.log_covariances(_channels(s, d).drop("target")), panel(s, d).select("sample_id", "target")))


# ---- pairwise learning and domains
def _split(s, d):
    rows = panel(s, d)
    return rows.where(~learn.held_out("sample_id")), rows.where(learn.held_out("sample_id"))


query("pairwise_classes", lambda s, d: learn.pairwise_classes(_split(s, d)[0], _split(s, d)[1].select("sample_id", "values"), 2, "diff_only", 10))


def _valued(s, d):
    train, rows = (x.withColumn("target", F.get("values", F.lit(0))) for x in _split(s, d))
    return train, rows.select("sample_id", "values"), train.where("sample_id % 50 = 1")


query("pairwise_values", lambda s, d: learn.pairwise_values(*_valued(s, d), "diff_only", 10))
query("calibrated_scores", lambda s, d: learn.calibrated(read(s, d, "labels").where("quality IS NOT NULL").join(read(s, d, "documents"), "doc_id").select("doc_id", F.col("quality").alias("y_true"), (F.col("n_chars") % 97).cast("double").alias("score")), "doc_id"))


def _domains(s, d):
    table = features.basic(long(s, d)).select("series_id", "mean", "std")
    return table.withColumn("domain", F.when(F.col("series_id") % 2 == 0, "even").otherwise("odd"))


query(
    "transfer_report",
    lambda s, d: detect.transfer_report(_domains(s, d), "domain", "even", "odd", ["mean", "std"]),
    f"{LONG}, B AS (SELECT series_id, {BASIC_SQL} FROM L GROUP BY 1), BC AS (SELECT series_id, 'mean' AS c, mean AS x FROM B UNION ALL SELECT series_id, 'std', std FROM B) "
    '||| SELECT c AS "column", count(*) FILTER (series_id % 2 = 0) AS n_source, count(*) FILTER (series_id % 2 <> 0) AS n_target, avg(x) FILTER (series_id % 2 = 0) AS source_mean, avg(x) FILTER (series_id % 2 <> 0) AS target_mean, '
    "stddev_pop(x) FILTER (series_id % 2 = 0) AS source_std, stddev_pop(x) FILTER (series_id % 2 <> 0) AS target_std, avg(x) FILTER (series_id % 2 <> 0) - avg(x) FILTER (series_id % 2 = 0) AS mean_shift FROM BC GROUP BY 1",
    "source_mean target_mean source_std target_std mean_shift",
)
query("aligned_domain", lambda s, d: detect.align(_domains(s, d).where("domain = 'even'"), _domains(s, d).where("domain = 'odd'"), ["mean", "std"]).drop("domain"))
