"""Queries over metrics, benchmark records, vectors, recurrence, kernels and images of series."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronolake.operators import forecast, leaderboard, matrix, metrics
from chronolake.plans.inputs import LABELLED, LONG, PANEL, RECORDS, labelled, long, panel, query, read, records

# ---- predictions: the last five values of each series against the drift forecast
TRUTH = (
    f"{LONG}, N0 AS (SELECT series_id, count(*) AS n FROM L GROUP BY 1), TR AS (SELECT L.* FROM L JOIN N0 USING (series_id) WHERE t < n - 5), TE AS (SELECT series_id, t - n + 6 AS h, value AS y_true FROM L JOIN N0 USING (series_id) WHERE t >= n - 5), "
    "DR AS (SELECT series_id, arg_max(value, t) AS lst, (arg_max(value, t) - arg_min(value, t)) / greatest(count(*) - 1, 1) AS step, avg(value) AS m FROM TR GROUP BY 1), "
    "PR AS (SELECT series_id, h, y_true, lst + step * h AS y_pred, m AS base FROM TE JOIN DR USING (series_id))"
)


def _train(s, d):
    return forecast.split_last(long(s, d), 5).where("split = 'train'").drop("split")


def _predicted(s, d):
    rows = forecast.split_last(long(s, d), 5)
    n = F.count("*").over(forecast.whole_series())
    test = rows.withColumn("h", F.col("t") - n + 6).where("split = 'test'").select("series_id", "h", F.col("value").alias("y_true"))
    return test.join(forecast.naive(_train(s, d), 5, "drift").withColumnRenamed("y", "y_pred"), ["series_id", "h"])


ERR = "abs(y_true - y_pred)"
SST = "(var_pop(y_true) * count(*))"
query(
    "metric_regression",
    lambda s, d: metrics.regression(_predicted(s, d), "series_id"),
    f"{TRUTH} ||| SELECT series_id, avg({ERR} * {ERR}) AS mse, sqrt(avg({ERR} * {ERR})) AS rmse, avg({ERR}) AS mae, CASE WHEN {SST} <= 1e-12 THEN 0 ELSE 1 - sum({ERR} * {ERR}) / {SST} END AS r2, "
    f"avg({ERR} / greatest(1e-8, abs(y_true))) AS mape, avg(200 * {ERR} / greatest(1e-8, abs(y_true) + abs(y_pred))) AS smape, median({ERR}) AS medae, max({ERR}) AS max_error, "
    "CASE WHEN var_pop(y_true) <= 1e-12 THEN 0 ELSE 1 - var_pop(y_true - y_pred) / var_pop(y_true) END AS explained_variance, avg(power(ln(1 + greatest(y_true, 0)) - ln(1 + greatest(y_pred, 0)), 2)) AS msle FROM PR GROUP BY 1",
    "mse rmse mae r2 mape smape medae max_error explained_variance msle",
    9,
)
query("metric_d2", lambda s, d: metrics.d2_absolute(_predicted(s, d), "series_id"), f"{TRUTH}, PM AS (SELECT *, median(y_true) OVER (PARTITION BY series_id) AS md FROM PR) ||| SELECT series_id, CASE WHEN avg(abs(y_true - md)) <= 1e-12 THEN 0 ELSE 1 - avg({ERR}) / avg(abs(y_true - md)) END AS d2 FROM PM GROUP BY 1", "d2")
query(
    "metric_forecast",
    lambda s, d: metrics.forecast(_train(s, d), _predicted(s, d), forecast.naive(_train(s, d), 5, "mean"), 2),
    f"{TRUTH}, SL AS (SELECT series_id, avg(d) AS sc FROM (SELECT series_id, abs(value - lag(value, 2) OVER (PARTITION BY series_id ORDER BY t)) AS d FROM TR) GROUP BY 1), "
    f"FM AS (SELECT series_id, avg(200 * {ERR} / greatest(1e-8, abs(y_true) + abs(y_pred))) AS smape, avg({ERR}) / any_value(CASE WHEN coalesce(sc, 0) <= 1e-8 THEN 1 ELSE sc END) AS mase, "
    "avg(200 * abs(y_true - base) / greatest(1e-8, abs(y_true) + abs(base))) AS s0, avg(abs(y_true - base)) / any_value(CASE WHEN coalesce(sc, 0) <= 1e-8 THEN 1 ELSE sc END) AS m0 FROM PR JOIN SL USING (series_id) GROUP BY 1) "
    "||| SELECT series_id, smape, mase, 0.5 * (smape / greatest(s0, 1e-8) + mase / greatest(m0, 1e-8)) AS owa FROM FM",
    "smape mase owa",
)
query("metric_by_horizon", lambda s, d: metrics.regression(_predicted(s, d), "h").select("h", "mae", "rmse"), f"{TRUTH} ||| SELECT h, avg({ERR}) AS mae, sqrt(avg({ERR} * {ERR})) AS rmse FROM PR GROUP BY 1", "mae rmse")

CONFUSION = "LB AS (SELECT DISTINCT y_true AS l FROM M UNION SELECT DISTINCT y_pred FROM M), CF AS (SELECT a.l AS y_true, b.l AS y_pred, (SELECT count(*) FROM M WHERE M.y_true = a.l AND M.y_pred = b.l) AS n FROM LB a, LB b)"
CLASSES = (
    "PC AS (SELECT label, CASE WHEN told = 0 THEN 0 ELSE hit / told END AS precision, CASE WHEN support = 0 THEN 0 ELSE hit / support END AS recall, CASE WHEN told + support = 0 THEN 0 ELSE 2 * hit / (told + support) END AS f1, support FROM "
    "(SELECT l AS label, (SELECT count(*) FROM M WHERE y_true = l AND y_pred = l) AS hit, (SELECT count(*) FROM M WHERE y_pred = l) AS told, (SELECT count(*) FROM M WHERE y_true = l) AS support FROM LB))"
)
query("metric_confusion", lambda s, d: metrics.confusion(labelled(s, d)), f"{LABELLED}, {CONFUSION} ||| SELECT * FROM CF")
query("metric_per_class", lambda s, d: metrics.per_class(labelled(s, d)).withColumn("support", F.col("support").cast("bigint")), f"{LABELLED}, {CONFUSION}, {CLASSES} ||| SELECT * FROM PC", "precision recall f1")
query(
    "metric_classification",
    lambda s, d: metrics.classification(labelled(s, d)),
    f"{LABELLED}, {CONFUSION}, {CLASSES} ||| SELECT sum(recall * support) / sum(support) AS accuracy, avg(recall) FILTER (support > 0) AS balanced_accuracy, avg(precision) AS precision_macro, avg(recall) AS recall_macro, avg(f1) AS f1_macro, "
    "sum(precision * support) / sum(support) AS precision_weighted, sum(recall * support) / sum(support) AS recall_weighted, sum(f1 * support) / sum(support) AS f1_weighted FROM PC",
    "accuracy balanced_accuracy precision_macro recall_macro f1_macro precision_weighted recall_weighted f1_weighted",
)
query(
    "metric_binary",
    lambda s, d: metrics.binary(labelled(s, d)),
    f"{LABELLED}, B AS (SELECT count(*) FILTER (y_true = 1 AND y_pred = 1) AS tp, count(*) FILTER (y_true = 0 AND y_pred = 1) AS fp, count(*) FILTER (y_true = 1 AND y_pred = 0) AS fn, count(*) FILTER (y_true = 0 AND y_pred = 0) AS tn FROM M) "
    "||| SELECT tp, fp, fn, tn, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1, 100 * fp / (fp + tn) AS far, 100 * fn / (fn + tp) AS mar FROM B",
    "precision recall f1 far mar",
)
query(
    "metric_roc_auc",
    lambda s, d: metrics.roc_auc(labelled(s, d), "lang"),
    f"{LABELLED}, RK AS (SELECT lang, y_true, rank() OVER (PARTITION BY lang ORDER BY score) + (count(*) OVER (PARTITION BY lang, score) - 1) / 2 AS r FROM M) "
    "||| SELECT lang, coalesce((sum(r) FILTER (y_true = 1) - count(*) FILTER (y_true = 1) * (count(*) FILTER (y_true = 1) + 1) / 2) / nullif(count(*) FILTER (y_true = 1) * count(*) FILTER (y_true = 0), 0), 0.0) AS roc_auc FROM RK GROUP BY 1",
    "roc_auc",
)
query("metric_logloss", lambda s, d: metrics.log_loss(labelled(s, d), "lang"), f"{LABELLED} ||| SELECT lang, -avg(ln(CASE WHEN y_true = 1 THEN prob ELSE 1 - prob END)) AS log_loss FROM M GROUP BY 1", "log_loss")
query(
    "metric_kl",
    lambda s, d: metrics.kl_divergence(records(s, d).select("dataset", F.col("value").alias("p"), F.length("model").cast("double").alias("q")), "dataset"),
    f"{RECORDS}, W AS (SELECT dataset, value / sum(value) OVER (PARTITION BY dataset) AS p, length(model) / sum(length(model)) OVER (PARTITION BY dataset) AS q FROM R) ||| SELECT dataset, sum(p * ln(p / q)) AS kl FROM W GROUP BY 1",
    "kl",
)
query(
    "pareto_front",
    lambda s, d: metrics.pareto(read(s, d, "part").select("p_partkey", "p_retailprice", F.col("p_size").cast("double").alias("size")), "p_partkey", ["p_retailprice", "size"]),
    "SELECT p_partkey, p_retailprice, CAST(p_size AS DOUBLE) AS size FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_retailprice <= a.p_retailprice AND b.p_size <= a.p_size AND (b.p_retailprice < a.p_retailprice OR b.p_size < a.p_size))",
)
CHANGES = f"{LONG}, TC AS (SELECT series_id, t FROM L WHERE t % 20 = 10), HT AS (SELECT series_id, t FROM L WHERE value > 150), JW AS (SELECT HT.series_id, HT.t, TC.t AS w FROM HT LEFT JOIN TC ON HT.series_id = TC.series_id AND HT.t BETWEEN TC.t AND TC.t + 6)"


def _changes(s, d):
    rows = long(s, d)
    return rows.where("t % 20 = 10").select("series_id", "t"), rows.where("value > 150").select("series_id", "t")


query(
    "average_delay",
    lambda s, d: metrics.detection_delay(*_changes(s, d), 6),
    f"{CHANGES}, FH AS (SELECT series_id, w, min(t) - w AS delay FROM JW WHERE w IS NOT NULL GROUP BY 1, 2), EA AS (SELECT TC.series_id, count(delay) AS found, count(*) FILTER (delay IS NULL) AS missed, avg(delay) AS mean_delay FROM TC LEFT JOIN FH ON TC.series_id = FH.series_id AND TC.t = FH.w GROUP BY 1), "
    "FA AS (SELECT series_id, count(*) FILTER (w IS NULL) AS fa FROM JW GROUP BY 1) ||| SELECT series_id, found, missed, coalesce(fa, 0) AS false_alarms, mean_delay FROM EA LEFT JOIN FA USING (series_id)",
    "mean_delay",
)
query(
    "nab_score",
    lambda s, d: metrics.nab_score(*_changes(s, d), 6),
    f"{CHANGES}, GN AS (SELECT series_id, w, CASE WHEN w IS NULL THEN -0.11 * count(*) ELSE 0.555 * (1 - tanh(pi() * (floor((min(t) - w) / 6 * 999) / 999) - pi() / 2) / tanh(pi() / 2)) - 0.11 END AS g FROM JW GROUP BY series_id, w), WN AS (SELECT series_id, sum(g) AS g, count(w) AS hit FROM GN GROUP BY 1), "
    "KK AS (SELECT series_id, count(*) AS k FROM TC GROUP BY 1) ||| SELECT series_id, 100 * (coalesce(g, 0) - (k - coalesce(hit, 0)) + k) / (2 * k) AS score FROM KK LEFT JOIN WN USING (series_id)",
    "score",
)

# ---- benchmark records
query("leaderboard_dense", lambda s, d: leaderboard.leaderboard(records(s, d), True), f"{RECORDS} ||| SELECT model, avg(value) AS mean, count(*) AS n, dense_rank() OVER (ORDER BY avg(value) DESC) AS place FROM R GROUP BY model", "mean")
RANKED = "RN AS (SELECT *, rank() OVER (PARTITION BY dataset ORDER BY value DESC) AS lo, (count(*) OVER (PARTITION BY dataset, value) - 1) / 2 AS half, count(*) OVER (PARTITION BY dataset) AS k FROM R)"
query("mean_rank", lambda s, d: leaderboard.mean_ranks(records(s, d), True), f"{RECORDS}, {RANKED} ||| SELECT model, avg(lo + half) AS mean_rank, count(*) AS n FROM RN GROUP BY 1", "mean_rank")
query("topk_summary", lambda s, d: leaderboard.top_k(records(s, d), True), f"{RECORDS}, {RANKED} ||| SELECT model, count(*) FILTER (lo <= 1) AS top1, count(*) FILTER (lo <= 3) AS top3, count(*) FILTER (lo <= 5) AS top5, count(*) FILTER (lo <= greatest(1, k // 2)) AS top_half FROM RN GROUP BY 1")
query("best_per_dataset", lambda s, d: leaderboard.best_by_dataset(records(s, d), True), f"{RECORDS} ||| SELECT dataset, arg_max(model, value) AS model, max(value) AS value FROM R GROUP BY 1", "value")
query(
    "dataset_delta",
    lambda s, d: leaderboard.delta(records(s, d), "BUILDING", True),
    f"{RECORDS}, A AS (SELECT dataset, avg(value) AS target FROM R WHERE model = 'BUILDING' GROUP BY 1), B AS (SELECT dataset, max(value) AS reference FROM R WHERE model <> 'BUILDING' GROUP BY 1) ||| SELECT dataset, target, reference, target - reference AS delta, 100 * (target - reference) / CASE WHEN reference = 0 THEN 1 ELSE abs(reference) END AS percent FROM A JOIN B USING (dataset)",
    "target reference delta percent",
)
query(
    "coverage",
    lambda s, d: leaderboard.coverage(read(s, d, "nation").select(F.col("n_name").alias("dataset")), read(s, d, "nation").where("n_nationkey % 3 <> 0").select(F.col("n_name").alias("dataset"))),
    "SELECT count(DISTINCT n_name) AS expected, count(DISTINCT n_name) FILTER (n_nationkey % 3 <> 0) AS observed, 100.0 * count(DISTINCT n_name) FILTER (n_nationkey % 3 <> 0) / count(DISTINCT n_name) AS percent, string_agg(n_name, ',' ORDER BY n_name) FILTER (n_nationkey % 3 = 0) AS missing FROM nation",
    "percent",
)
STATUS = "ST AS (SELECT o_orderpriority AS dataset, o_custkey % 7 AS model, CASE WHEN o_orderstatus = 'O' THEN 'success' ELSE 'failed' END AS status, o_totalprice AS value FROM orders)"


def _runs(s, d):
    o = read(s, d, "orders")
    status = F.when(F.col("o_orderstatus") == "O", "success").otherwise("failed")
    return o.select(F.col("o_orderpriority").alias("dataset"), (F.col("o_custkey") % 7).alias("model"), status.alias("status"), F.col("o_totalprice").alias("value"))


query("status_summary", lambda s, d: leaderboard.status_summary(_runs(s, d)), f"{STATUS} ||| SELECT status, count(*) AS n, count(DISTINCT dataset) AS datasets, count(DISTINCT model) AS models FROM ST GROUP BY 1")
query("successful_means", lambda s, d: leaderboard.successful(_runs(s, d)).groupBy("dataset", "model").agg(F.avg("value").alias("value")), f"{STATUS} ||| SELECT dataset, model, avg(value) AS value FROM ST WHERE status = 'success' GROUP BY 1, 2", "value")
query(
    "difficulty",
    lambda s, d: leaderboard.difficulty(_runs(s, d).withColumn("value", F.col("value") / 50000), False),
    f"{STATUS}, B AS (SELECT dataset, 1 / (1 + greatest(min(value / 50000), 0)) AS score FROM ST GROUP BY 1) ||| SELECT dataset, score, CASE WHEN score >= 0.9 THEN 'easy' WHEN score >= 0.75 THEN 'normal' WHEN score >= 0.5 THEN 'hard' ELSE 'extra_hard' END AS level FROM B",
    "score",
)
query("run_compare_pivot", lambda s, d: leaderboard.compare(records(s, d), ["BUILDING", "MACHINERY"]), f"{RECORDS} ||| SELECT dataset, avg(value) FILTER (model = 'BUILDING') AS \"BUILDING\", avg(value) FILTER (model = 'MACHINERY') AS \"MACHINERY\" FROM R GROUP BY 1", "BUILDING MACHINERY")
query(
    "melt_wide_results",
    lambda s, d: leaderboard.melt(leaderboard.compare(records(s, d), ["BUILDING", "MACHINERY"]).withColumns({c: F.regexp_replace(F.round(c, 2).cast("string"), r"\.", ",") for c in ("BUILDING", "MACHINERY")}), "dataset", ["BUILDING", "MACHINERY"]),
    f"{RECORDS} ||| SELECT dataset, model, round(value, 2) AS value FROM R WHERE model IN ('BUILDING', 'MACHINERY')",
    "value",
)

# ---- vectors
PAIRS = f"{PANEL}, PP AS (SELECT a.sample_id AS i, b.sample_id AS j, a.v AS x, b.v AS y, list_zip(a.v, b.v) AS z, a.target AS ti, b.target AS tj FROM P a JOIN P b ON a.sample_id <> b.sample_id WHERE a.sample_id % 50 = 0)"
query(
    "distances_all",
    lambda s, d: matrix.distances(panel(s, d), panel(s, d).where("sample_id % 50 = 0")),
    f"{PAIRS} ||| SELECT i, j, list_distance(x, y) AS euclidean, list_sum(list_transform(z, lambda p: abs(p[1] - p[2]))) AS cityblock, list_max(list_transform(z, lambda p: abs(p[1] - p[2]))) AS chebyshev, "
    "power(list_sum(list_transform(z, lambda p: power(abs(p[1] - p[2]), 3))), 1.0 / 3) AS minkowski, list_cosine_distance(x, y) AS cosine, "
    "1 - list_sum(list_transform(z, lambda p: (p[1] - list_avg(x)) * (p[2] - list_avg(y)))) / sqrt(list_sum(list_transform(x, lambda a: power(a - list_avg(x), 2))) * list_sum(list_transform(y, lambda a: power(a - list_avg(y), 2)))) AS correlation, "
    "list_sum(list_transform(z, lambda p: CASE WHEN abs(p[1]) + abs(p[2]) = 0 THEN 0 ELSE abs(p[1] - p[2]) / (abs(p[1]) + abs(p[2])) END)) AS canberra FROM PP",
    " ".join(matrix.METRICS),
)
query("kernel_rbf", lambda s, d: matrix.rbf_kernel(panel(s, d), panel(s, d).where("sample_id % 50 = 0"), 0.5), f"{PAIRS} ||| SELECT i, j, exp(-0.5 * power(list_distance(x, y), 2)) AS k FROM PP", "k")
query(
    "pdl_pairs",
    lambda s, d: matrix.pair_learning(panel(s, d), panel(s, d).where("sample_id % 50 = 0")).select("i", "j", "differs", F.aggregate("diff", F.lit(0.0), lambda a, x: a + x).alias("total"), "target_delta"),
    f"{PAIRS} ||| SELECT i, j, CAST(ti <> tj AS BIGINT) AS differs, list_sum(list_transform(z, lambda p: abs(p[1] - p[2]))) AS total, CAST(tj - ti AS DOUBLE) AS target_delta FROM PP",
    "total",
)
query(
    "nearest_centroid",
    lambda s, d: matrix.nearest_centroid(panel(s, d)),
    f"{PANEL}, CE AS (SELECT sample_id, target, unnest(range(1, len(v) + 1)) AS d, unnest(v) AS x FROM P), CN AS (SELECT target AS label, d, avg(x) AS c FROM CE GROUP BY 1, 2), FA AS (SELECT sample_id, label, round(sum(power(x - c, 2)), 9) AS f FROM CE JOIN CN USING (d) GROUP BY 1, 2) ||| SELECT sample_id, arg_min(label, (f, label)) AS label FROM FA GROUP BY 1",
)
query("majority_class", lambda s, d: matrix.majority_class(panel(s, d)), f"{PANEL}, N AS (SELECT target, count(*) AS n FROM P GROUP BY 1) ||| SELECT arg_max(target, (n, -target)) AS label, max(n) / sum(n) AS share FROM N", "share")

# ---- recurrence and images
RECUR = f"{LONG}, RM AS (SELECT series_id, t, value, max(value) OVER w - min(value) OVER w AS sp FROM L WINDOW w AS (PARTITION BY series_id)), RP AS (SELECT a.series_id, a.t AS i, b.t AS j FROM RM a JOIN RM b ON a.series_id = b.series_id AND a.t <> b.t WHERE round(1 - abs(a.value - b.value) / greatest(a.sp, 1e-12), 9) >= 0.7)"
query("recurrence_rate", lambda s, d: matrix.recurrence_rate(long(s, d)), f"{RECUR}, NN AS (SELECT series_id, count(*) AS n FROM L GROUP BY 1), KK AS (SELECT series_id, count(*) AS k FROM RP GROUP BY 1) ||| SELECT series_id, coalesce(k, 0) / greatest(n * (n - 1), 1) AS rate FROM NN LEFT JOIN KK USING (series_id)", "rate")
query(
    "rqa_lines",
    lambda s, d: matrix.diagonal_lines(long(s, d)),
    f"{RECUR}, DL AS (SELECT series_id, j - i AS d, i - row_number() OVER (PARTITION BY series_id, j - i ORDER BY i) AS r FROM RP WHERE j > i), LN AS (SELECT series_id, count(*) AS n FROM DL GROUP BY series_id, d, r) "
    "||| SELECT series_id, coalesce(sum(n) FILTER (n >= 2), 0) / sum(n) AS determinism, coalesce(avg(n) FILTER (n >= 2), 0) AS mean_line, max(n) AS longest FROM LN GROUP BY 1",
    "determinism mean_line",
)
query(
    "mtf",
    lambda s, d: matrix.transition_field(long(s, d)),
    f"{LONG}, MQ AS (SELECT series_id, quantile_cont(value, 0.25) AS a1, quantile_cont(value, 0.5) AS a2, quantile_cont(value, 0.75) AS a3 FROM L GROUP BY 1), MB AS (SELECT series_id, t, CAST(CAST(value > a1 AS INT) + CAST(value > a2 AS INT) + CAST(value > a3 AS INT) AS BIGINT) AS a FROM L JOIN MQ USING (series_id)), "
    "MN AS (SELECT series_id, a, lead(a) OVER (PARTITION BY series_id ORDER BY t) AS b FROM MB) ||| SELECT series_id, a, b, count(*) / sum(count(*)) OVER (PARTITION BY series_id, a) AS p FROM MN WHERE b IS NOT NULL GROUP BY series_id, a, b",
    "p",
)
for name, summed, value in (("gaf_sum", True, "x.x * y.x - x.y * y.y"), ("gaf_difference", False, "x.y * y.x - x.x * y.y")):
    query(
        name,
        lambda s, d, summed=summed: matrix.angular_field(long(s, d), 6, summed),
        f"{LONG}, X0 AS (SELECT *, count(*) OVER (PARTITION BY series_id) AS n FROM L), PA AS (SELECT series_id, CAST(t * 6 // n AS BIGINT) AS p, avg(value) AS v FROM X0 GROUP BY 1, 2), "
        "XS AS (SELECT series_id, p, CASE WHEN max(v) OVER w - min(v) OVER w < 1e-12 THEN 0 ELSE 2 * (v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w) - 1 END AS x FROM PA WINDOW w AS (PARTITION BY series_id)), "
        f"XY AS (SELECT *, sqrt(greatest(1 - x * x, 0)) AS y FROM XS) ||| SELECT x.series_id, x.p AS i, y.p AS j, {value} AS value FROM XY x JOIN XY y ON x.series_id = y.series_id",
        "value",
    )
query(
    "park_transform",
    lambda s, d: matrix.phase_amplitudes(read(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax"), "l_quantity", "l_discount", "l_tax").select("l_orderkey", "l_linenumber", "alpha", "beta", "amplitude", "phase"),
    "SELECT l_orderkey, l_linenumber, a AS alpha, b AS beta, sqrt(a * a + b * b) AS amplitude, atan2(b, a) AS phase FROM (SELECT l_orderkey, l_linenumber, (2 * l_quantity - l_discount - l_tax) / 3 AS a, (l_discount - l_tax) / sqrt(3) AS b FROM lineitem)",
    "alpha beta amplitude phase",
)
