"""Queries over feature tables, channels, distributions, labelled intervals and metadata."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronolake.operators import features, matrix, spectral, tables
from chronolake.plans.inputs import HOLED, LONG, PANEL, RECORDS, holed, long, panel, query, read, records
from chronolake.plans.record_queries import PAIRS
from chronolake.plans.series_queries import BASIC_SQL, MOMENTS

query(
    "mean_impute",
    lambda s, d: tables.impute_means(holed(s, d).select("series_id", "t", "value"), ["value"]),
    f"{HOLED} ||| SELECT series_id, t, coalesce(value, (SELECT avg(value) FROM H)) AS value FROM H",
    "value",
)
query(
    "standardise_features",
    lambda s, d: tables.standardise(features.basic(long(s, d)).select("series_id", "mean", "std"), ["mean", "std"]),
    f"{LONG}, B AS (SELECT series_id, {BASIC_SQL} FROM L GROUP BY 1) ||| SELECT series_id, (mean - avg(mean) OVER ()) / stddev_pop(mean) OVER () AS mean, (std - avg(std) OVER ()) / stddev_pop(std) OVER () AS std FROM B",
    "mean std",
)
query("log_values", lambda s, d: long(s, d).select("series_id", "t", F.log1p(F.greatest("value", F.lit(0.0))).alias("value")), f"{LONG} ||| SELECT series_id, t, ln(1 + greatest(value, 0)) AS value FROM L", "value")
query(
    "gaussian_filter",
    lambda s, d: tables.weighted_filter(long(s, d), [0.25, 1.0, 0.25]),
    f"{LONG}, X AS (SELECT series_id, t, value, lag(value) OVER w AS a, lead(value) OVER w AS b FROM L WINDOW w AS (PARTITION BY series_id ORDER BY t)) ||| SELECT series_id, t, (value + coalesce(0.25 * a, 0) + coalesce(0.25 * b, 0)) / (1 + CASE WHEN a IS NULL THEN 0 ELSE 0.25 END + CASE WHEN b IS NULL THEN 0 ELSE 0.25 END) AS smooth FROM X",
    "smooth",
)
query(
    "correlation_filter",
    lambda s, d: tables.correlated_pairs(features.basic(long(s, d)), ["mean", "median", "std", "max"], 0.3),
    f"{LONG}, B AS (SELECT series_id, {BASIC_SQL} FROM L GROUP BY 1) ||| SELECT * FROM ("
    + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM B" for a, b in (("mean", "median"), ("mean", "std"), ("mean", "max"), ("median", "std"), ("median", "max"), ("std", "max")))
    + ") WHERE abs(r) > 0.3",
    "r",
)
query(
    "branch_merge",
    lambda s, d: tables.merge_branches([features.basic(long(s, d)).select("series_id", "mean"), features.moments(long(s, d)).select("series_id", "ptp")], "series_id"),
    f"{LONG}, {MOMENTS}, B AS (SELECT series_id, {BASIC_SQL} FROM L GROUP BY 1) ||| SELECT series_id, mean AS b0_mean, ptp AS b1_ptp FROM B JOIN MO USING (series_id)",
    "b0_mean b1_ptp",
)
query(
    "bag_columns",
    lambda s, d: tables.bag_columns(features.basic(long(s, d)), "series_id", ["q5", "q25", "q75", "q95"]),
    f"{LONG}, B AS (SELECT series_id, {BASIC_SQL} FROM L GROUP BY 1) ||| SELECT series_id, (q5 + q25 + q75 + q95) / 4 AS mean, list_median([q5, q25, q75, q95]) AS median, q95 AS max, q5 AS min FROM B",
    "mean median max min",
)
query(
    "explain_distances",
    lambda s, d: tables.distribution_distances(records(s, d).select("dataset", F.col("value").alias("p"), F.length("model").cast("double").alias("q")), "dataset"),
    f"{RECORDS}, W AS (SELECT dataset, value / sum(value) OVER (PARTITION BY dataset) AS p, length(model) / sum(length(model)) OVER (PARTITION BY dataset) AS q FROM R), V AS (SELECT *, (p + q) / 2 AS m FROM W) "
    "||| SELECT dataset, sum(p * ln(p / q)) AS kl, sum(p * ln(p / m)) / 2 + sum(q * ln(q / m)) / 2 AS js, sum(abs(p - q)) / 2 AS total_variation, sqrt(sum(power(sqrt(p) - sqrt(q), 2))) / sqrt(2) AS hellinger FROM V GROUP BY 1",
    "kl js total_variation hellinger",
)
query(
    "kernel_family",
    lambda s, d: matrix.kernel_family(panel(s, d), panel(s, d).where("sample_id % 50 = 0")),
    f"{PAIRS} ||| SELECT i, j, list_inner_product(x, y) AS linear, power(list_inner_product(x, y) + 1, 3) AS polynomial, exp(-0.1 * list_sum(list_transform(z, lambda p: abs(p[1] - p[2])))) AS laplacian FROM PP",
    "linear polynomial laplacian",
)
for side, a, b in (("left", -12, 0), ("right", 0, 12), ("center", -6, 6)):
    query(
        f"boundaries_{side}",
        lambda s, d, side=side: tables.boundaries(long(s, d).where("t % 9 = 4"), 12, side),
        f"{LONG}, B AS (SELECT series_id, t, t + {a} AS w_start, t + {b} AS w_end FROM L WHERE t % 9 = 4), N AS (SELECT *, lead(w_start) OVER (PARTITION BY series_id ORDER BY t) AS n FROM B) ||| SELECT series_id, t, w_start, CASE WHEN n <= w_end THEN n - 1 ELSE w_end END AS w_end FROM N",
    )
query(
    "changepoint_confusion",
    lambda s, d: tables.changepoint_confusion(tables.boundaries(long(s, d).where("t % 20 = 10"), 6, "center"), long(s, d).where("value > 150")),
    f"{LONG}, B AS (SELECT series_id, t AS w FROM L WHERE t % 20 = 10), H AS (SELECT series_id, t FROM L WHERE value > 150), J AS (SELECT H.series_id, H.t, B.w FROM H LEFT JOIN B ON H.series_id = B.series_id AND H.t BETWEEN w - 3 AND w + 3), "
    "C AS (SELECT series_id, count(DISTINCT w) AS tp, count(*) FILTER (w IS NULL) AS fp FROM J GROUP BY 1), N AS (SELECT series_id, count(*) AS n FROM B GROUP BY 1) ||| SELECT series_id, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, n - coalesce(tp, 0) AS fn FROM N LEFT JOIN C USING (series_id)",
)


def _intervals(s, d):
    o = read(s, d, "orders")
    start = (F.col("o_orderkey") * 50).cast("long")
    return o.select(F.col("o_orderpriority").alias("class"), start.alias("start"), (start + F.col("o_custkey") % 4 * 5 + 5).alias("end"))


query(
    "interval_splitter",
    lambda s, d: tables.modal_intervals(_intervals(s, d)),
    'I AS (SELECT o_orderpriority AS class, o_orderkey * 50 AS a, o_orderkey * 50 + o_custkey % 4 * 5 + 5 AS b FROM orders), M AS (SELECT arg_max(n, (k, n)) AS m FROM (SELECT b - a AS n, count(*) AS k FROM I GROUP BY 1)), '
    'P AS (SELECT class, a, m, unnest(range(0, greatest(1, (b - a) // m))) AS i FROM I, M) ||| SELECT class, a + i * m AS "start", a + i * m + m AS "end" FROM P',
)
query("split_temporal", lambda s, d: tables.temporal_split(long(s, d), 0.5, 0.25), f"{LONG}, N AS (SELECT *, count(*) OVER (PARTITION BY series_id) AS n FROM L) ||| SELECT series_id, t, CASE WHEN t / n < 0.5 THEN 'train' WHEN t / n < 0.75 THEN 'calibration' ELSE 'test' END AS part FROM N")
query(
    "leave_one_domain_out",
    lambda s, d: tables.leave_one_out(read(s, d, "events"), "event_type"),
    "C AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1) ||| SELECT event_type AS held_out, 'test' AS part, n FROM C UNION ALL SELECT event_type, 'train', CAST((SELECT sum(n) FROM C) AS BIGINT) - n FROM C",
)
query(
    "tune_width",
    lambda s, d: tables.best_width(long(s, d), [2, 4, 8]),
    f"{LONG}, E AS (SELECT series_id, t, "
    + ", ".join(f"abs(value - avg(value) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)) AS e{k}" for k in (2, 4, 8))
    + " FROM L), U AS ("
    + " UNION ALL ".join(f"SELECT series_id, {k} AS width, avg(e{k}) AS mae FROM E WHERE t >= 8 GROUP BY 1" for k in (2, 4, 8))
    + ") ||| SELECT series_id, CAST(arg_min(width, (round(mae, 9), width)) AS BIGINT) AS width, min(mae) AS mae FROM U GROUP BY 1",
    "mae",
)
query(
    "channel_select",
    lambda s, d: tables.class_channels(panel(s, d), 10).withColumn("channel", F.col("channel").cast("bigint")),
    f"{PANEL}, C AS (SELECT target, unnest(range(0, len(v))) AS channel, unnest(v) AS x FROM P), M AS (SELECT target, channel, avg(x) AS m FROM C GROUP BY 1, 2) ||| SELECT a.channel, sum(abs(a.m - b.m)) AS spread FROM M a JOIN M b ON a.channel = b.channel AND a.target < b.target GROUP BY 1 ORDER BY round(spread, 9) DESC, channel LIMIT 10",
    "spread",
)
ACF = "EC AS (SELECT series_id, t, value - avg(value) OVER (PARTITION BY series_id) AS e FROM L), AC AS (SELECT a.series_id, b.t - a.t AS lag, sum(a.e * b.e) AS p FROM EC a JOIN EC b ON a.series_id = b.series_id AND b.t - a.t BETWEEN 1 AND 12 GROUP BY 1, 2), AR AS (SELECT series_id, lag, p / s AS r FROM AC JOIN (SELECT series_id, sum(e * e) AS s FROM EC GROUP BY 1) USING (series_id))"
query("autocorrelations", lambda s, d: tables.autocorrelations(long(s, d), 12).where("r IS NOT NULL"), f"{LONG}, {ACF} ||| SELECT * FROM AR WHERE r IS NOT NULL", "r")
query(
    "window_by_acf",
    lambda s, d: tables.window_by_autocorrelation(long(s, d), 12),
    f"{LONG}, {ACF}, PK AS (SELECT *, lag(r) OVER w AS l, lead(r) OVER w AS n FROM AR WINDOW w AS (PARTITION BY series_id ORDER BY lag)) ||| SELECT series_id, coalesce(arg_max(lag, (round(r, 9), -lag)) FILTER (r > l AND r > n), 12) AS width FROM PK GROUP BY 1",
)
query("flatten_json", lambda s, d: tables.flatten_json(read(s, d, "events"), "event_id", "props", {"k": "bigint"}), "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
query(
    "regime_routing",
    lambda s, d: tables.route(spectral.change_rates(long(s, d)).join(features.moments(long(s, d)).select("series_id", "slope"), "series_id")),
    f"{LONG}, {MOMENTS}, S1 AS (SELECT series_id, t, sign(value - lag(value) OVER (PARTITION BY series_id ORDER BY t)) AS s FROM L), S2 AS (SELECT *, lag(s) OVER (PARTITION BY series_id ORDER BY t) AS p FROM S1), SW AS (SELECT series_id, count(*) FILTER (s <> p) / greatest(count(p), 1) AS sw FROM S2 GROUP BY 1) "
    "||| SELECT series_id, CASE WHEN sw > 0.7 THEN 'smoothing' WHEN abs(slope) > 0.3 THEN 'trend' ELSE 'lagged' END AS family FROM SW JOIN MO USING (series_id)",
)
query(
    "family_summary",
    lambda s, d: tables.route(spectral.change_rates(long(s, d)).join(features.moments(long(s, d)).select("series_id", "slope"), "series_id")).groupBy("family").agg(F.count("*").alias("n")),
    f"{LONG}, {MOMENTS}, S1 AS (SELECT series_id, t, sign(value - lag(value) OVER (PARTITION BY series_id ORDER BY t)) AS s FROM L), S2 AS (SELECT *, lag(s) OVER (PARTITION BY series_id ORDER BY t) AS p FROM S1), SW AS (SELECT series_id, count(*) FILTER (s <> p) / greatest(count(p), 1) AS sw FROM S2 GROUP BY 1) "
    "||| SELECT CASE WHEN sw > 0.7 THEN 'smoothing' WHEN abs(slope) > 0.3 THEN 'trend' ELSE 'lagged' END AS family, count(*) AS n FROM SW JOIN MO USING (series_id) GROUP BY 1",
)
