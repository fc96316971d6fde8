"""Queries over layouts, cleaning, features, windows, detection and forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronolake.operators import detect, features, forecast, layouts, quality, windows
from chronolake.plans.inputs import HOLED, LONG, holed, long, query, read

BUCKETED = "E AS (SELECT user_id AS series_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS ts, event_id, value FROM events)"


def _bucketed(spark, d):
    e = read(spark, d, "events")
    return e.select(F.col("user_id").alias("series_id"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("ts"), "event_id", "value")


query("series_long", long, f"{LONG} ||| SELECT series_id, t, ts, value FROM L")
query(
    "nan_to_zero",
    lambda s, d: holed(s, d).select("series_id", "t", layouts.finite_or_zero(F.col("value")).alias("value")),
    f"{HOLED} ||| SELECT series_id, t, coalesce(value, 0.0) AS value FROM H",
)
query("slice_elements", lambda s, d: layouts.cut(long(s, d), 5, 20).select("series_id", "t", "value"), f"{LONG} ||| SELECT series_id, t - 5 AS t, value FROM L WHERE t >= 5 AND t < 20")
query(
    "panel_round_trip",
    lambda s, d: layouts.from_panel(layouts.to_panel(long(s, d))),
    f"{LONG} ||| SELECT series_id, t, value FROM L",
)
query(
    "time_seconds",
    lambda s, d: read(s, d, "events").select("event_id", quality.seconds(F.col("ts")).alias("sec"), quality.seconds(F.col("event_id")).alias("num")),
    "SELECT event_id, epoch_us(ts) / 1e6 AS sec, CAST(event_id AS DOUBLE) AS num FROM events",
    "sec num",
)
query(
    "ts_dedup_keep_last",
    lambda s, d: quality.dedup_times(_bucketed(s, d), ["series_id", "ts"], F.col("event_id"), "value", "keep_last"),
    f"{BUCKETED} ||| SELECT series_id, ts, arg_max(value, event_id) AS value FROM E GROUP BY ALL",
)
query("ts_dedup_mean", lambda s, d: quality.dedup_times(_bucketed(s, d), ["series_id", "ts"], F.col("event_id"), "value", "mean"), f"{BUCKETED} ||| SELECT series_id, ts, avg(value) AS value FROM E GROUP BY series_id, ts", "value")
query(
    "ts_dedup_drop",
    lambda s, d: quality.dedup_times(_bucketed(s, d), ["series_id", "ts"], F.col("event_id"), "value", "drop"),
    f"{BUCKETED} ||| SELECT series_id, ts, any_value(value) AS value FROM E GROUP BY series_id, ts HAVING count(*) = 1",
)
query(
    "gap_stats",
    lambda s, d: quality.gap_statistics(long(s, d)),
    f"{LONG}, D AS (SELECT series_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY series_id ORDER BY t))) / 1e6 AS d FROM L), "
    "N AS (SELECT series_id, median(d) AS dt FROM D WHERE d > 0 GROUP BY 1) ||| SELECT series_id, any_value(dt) AS nominal_dt, count(*) FILTER (d / dt > 1.5) AS n_gaps, "
    "coalesce(sum(d - dt) FILTER (d / dt > 1.5), 0.0) AS gap_seconds FROM D JOIN N USING (series_id) WHERE d > 0 GROUP BY series_id",
    "nominal_dt gap_seconds",
    4,
)
GRID = (
    f"{LONG}, GM AS (SELECT series_id, t, epoch_us(ts) AS m, value, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY series_id ORDER BY t) AS d FROM L), "
    "GS AS (SELECT series_id, min(m) AS a, max(m) AS b, coalesce(median(CASE WHEN d > 0 THEN d END), 1000000) AS dt FROM GM GROUP BY 1), "
    "GN AS (SELECT *, CAST(ceil((b - a) / dt + 0.5) AS BIGINT) AS n FROM GS), "
    "GH AS (SELECT series_id, least(CAST(round_even((m - a) / dt, 0) AS BIGINT), n - 1) AS slot, arg_max(value, (m, t)) AS value FROM GM JOIN GN USING (series_id) GROUP BY 1, 2), "
    "GE AS (SELECT series_id, a, dt, unnest(range(0, n)) AS slot FROM GN), "
    "G AS (SELECT GE.series_id, GE.slot, (a + GE.slot * dt) / 1e6 AS second, GH.value, GH.series_id IS NULL AS is_gap FROM GE LEFT JOIN GH ON GE.series_id = GH.series_id AND GE.slot = GH.slot), "
    "W AS (SELECT *, last_value(value IGNORE NULLS) OVER w AS p, last_value(CASE WHEN value IS NOT NULL THEN slot END IGNORE NULLS) OVER w AS ps, "
    "first_value(value IGNORE NULLS) OVER v AS n, first_value(CASE WHEN value IS NOT NULL THEN slot END IGNORE NULLS) OVER v AS ns FROM G "
    "WINDOW w AS (PARTITION BY series_id ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), v AS (PARTITION BY series_id ORDER BY slot ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"
)
for policy, value in (("mark_only", "value"), ("forward_fill", "coalesce(p, n)"), ("interpolate_linear", "coalesce(value, p + (n - p) * (slot - ps) / (ns - ps), p, n)")):
    query(
        {"mark_only": "resample_grid_mark", "forward_fill": "resample_grid_ffill", "interpolate_linear": "resample_grid_linear"}[policy],
        lambda s, d, policy=policy: quality.regular_grid(long(s, d), policy),
        f"{GRID} ||| SELECT series_id, slot, second, {value} AS value, is_gap FROM W",
        "value second",
        3,
    )
query("carry_index", lambda s, d: quality.carried_index(holed(s, d)), f"{HOLED} ||| SELECT series_id, t, max(CASE WHEN value IS NOT NULL THEN t END) OVER (PARTITION BY series_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS carried FROM H")
query(
    "robust_scale",
    lambda s, d: quality.robust_scale(long(s, d)),
    f"{LONG}, A AS (SELECT series_id, median(value) AS m FROM L GROUP BY 1), B AS (SELECT series_id, any_value(m) AS m, median(abs(value - m)) AS d FROM L JOIN A USING (series_id) GROUP BY 1) "
    "||| SELECT series_id, t, (value - m) / CASE WHEN d < 1e-8 THEN 1 ELSE d END AS z FROM L JOIN B USING (series_id)",
    "z",
)
query(
    "z_normalise",
    lambda s, d: quality.z_normalise(long(s, d)),
    f"{LONG} ||| SELECT series_id, t, (value - avg(value) OVER w) / greatest(stddev_pop(value) OVER w, 1e-6) AS z FROM L WINDOW w AS (PARTITION BY series_id)",
    "z",
)
query(
    "min_max_scale",
    lambda s, d: quality.min_max(long(s, d), -1.0, 1.0),
    f"{LONG} ||| SELECT series_id, t, -1 + 2 * (value - min(value) OVER w) / greatest(max(value) OVER w - min(value) OVER w, 1e-8) AS scaled FROM L WINDOW w AS (PARTITION BY series_id)",
    "scaled",
)
query("rolling_mean", lambda s, d: quality.rolling_mean(long(s, d), 5), f"{LONG} ||| SELECT series_id, t, avg(value) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS smooth FROM L", "smooth")
query("differences", lambda s, d: quality.differences(long(s, d)), f"{LONG} ||| SELECT series_id, t, coalesce(value - lag(value) OVER (PARTITION BY series_id ORDER BY t), 0.0) AS diff FROM L", "diff")
query("running_sum", lambda s, d: quality.integrate(long(s, d)), f"{LONG} ||| SELECT series_id, t, sum(value) OVER (PARTITION BY series_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS total FROM L", "total")
query(
    "channel_quality",
    lambda s, d: quality.channel_report(holed(s, d)),
    f"{HOLED}, X AS (SELECT *, lag(value) OVER (PARTITION BY series_id ORDER BY t) AS p FROM H) ||| SELECT series_id, count(*) FILTER (value IS NULL) AS missing, count(*) FILTER (value = p) AS repeats, "
    "var_pop(value) < 1e-10 AS dead, median(abs(value - p)) AS noise_floor, max(value) - min(value) AS span FROM X GROUP BY series_id",
    "noise_floor span",
)
query(
    "saturation_runs",
    lambda s, d: quality.saturation_runs(long(s, d)),
    f"{LONG}, Q AS (SELECT series_id, quantile_cont(value, 0.9) AS q FROM L GROUP BY 1), I AS (SELECT series_id, t, t - row_number() OVER (PARTITION BY series_id ORDER BY t) AS k FROM L JOIN Q USING (series_id) WHERE value >= q) "
    '||| SELECT series_id, min(t) AS start, max(t) AS "end", count(*) AS length FROM I GROUP BY series_id, k HAVING count(*) >= 2',
)
query("low_variance_filter", lambda s, d: quality.varied(long(s, d), 3000.0), f"{LONG} ||| SELECT series_id, var_pop(value) AS variance FROM L GROUP BY 1 HAVING var_pop(value) > 3000", "variance")
query(
    "fill_ols",
    lambda s, d: quality.fill_by_trend(holed(s, d)),
    f"{HOLED}, A AS (SELECT series_id, regr_slope(value, t) AS a, regr_intercept(value, t) AS b FROM H GROUP BY 1) ||| SELECT series_id, t, coalesce(value, a * t + b) AS value FROM H JOIN A USING (series_id)",
    "value",
)
query(
    "target_bins",
    lambda s, d: quality.quantile_bins(read(s, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", [0.0, 0.2, 0.4, 0.6]),
    "SELECT c_custkey, c_acctbal, CAST(len(list_filter(q, lambda x: x <= c_acctbal)) AS BIGINT) AS bin FROM customer, (SELECT quantile_cont(c_acctbal, [0.0, 0.2, 0.4, 0.6]) AS q FROM customer)",
)

# ---- features
LAGS = f"{LONG}, G AS (SELECT series_id, t, value, count(*) OVER a AS n, lag(value) OVER w AS p1, lag(value, 2) OVER w AS p2, last_value(value) OVER f AS lst, value > (min(value) OVER a + max(value) OVER a) / 2 AS up FROM L WINDOW a AS (PARTITION BY series_id), w AS (PARTITION BY series_id ORDER BY t), f AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)), U AS (SELECT *, lag(up) OVER (PARTITION BY series_id ORDER BY t) AS was, greatest(2, n // 10) AS span FROM G)"
BASIC_SQL = "avg(value) AS mean, median(value) AS median, stddev_pop(value) AS std, max(value) AS max, min(value) AS min, quantile_cont(value, 0.05) AS q5, quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.75) AS q75, quantile_cont(value, 0.95) AS q95"
MOMENTS = (
    "C AS (SELECT series_id, t, value, value - avg(value) OVER (PARTITION BY series_id) AS e FROM L), MO AS (SELECT series_id, avg(e * e * e) / power(avg(e * e), 1.5) AS skewness, avg(e * e * e * e) / power(avg(e * e), 2) - 3 AS kurtosis, "
    "regr_slope(value, t) AS slope, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr, avg(value * value) AS energy, max(value) - min(value) AS ptp, max(abs(value)) / sqrt(avg(value * value)) AS crest FROM C GROUP BY 1)"
)
PEAKS = (
    "K0 AS (SELECT *, CASE WHEN lag(value) OVER (PARTITION BY series_id ORDER BY t) = value THEN 0 ELSE 1 END AS c FROM L), K1 AS (SELECT *, sum(c) OVER (PARTITION BY series_id ORDER BY t) AS r FROM K0), "
    "K2 AS (SELECT series_id, r, min(t) AS a, max(t) AS b, any_value(value) AS v FROM K1 GROUP BY series_id, r), K3 AS (SELECT *, lag(v) OVER w AS l, lead(v) OVER w AS n FROM K2 WINDOW w AS (PARTITION BY series_id ORDER BY r)), "
    "PK AS (SELECT series_id, (a + b) // 2 AS t FROM K3 WHERE v > l AND v > n), PF AS (SELECT series_id, count(PK.t) AS n_peaks, CASE WHEN count(PK.t) > 1 THEN (max(PK.t) - min(PK.t)) / (count(PK.t) - 1) END AS mean_peak_distance "
    "FROM (SELECT DISTINCT series_id FROM L) LEFT JOIN PK USING (series_id) GROUP BY series_id)"
)
SEQ = (
    "SF AS (SELECT series_id, count(*) FILTER (up <> was) / count(*) AS cross_rate, corr(value, coalesce(p1, lst)) AS autocorrelation, sqrt(avg((value - p1) * (value - p1)) / avg(value * value)) AS mobility, "
    "sqrt(avg((value - 2 * p1 + p2) * (value - 2 * p1 + p2)) * avg(value * value)) / avg((value - p1) * (value - p1)) AS complexity, "
    "log10(count(*)) / (log10(count(*)) + log10(count(*) / (count(*) + 0.4 * count(*) FILTER ((value - p1) * (p1 - p2) < 0)))) AS petrosian, "
    "sum(power(1 - 2 / (span + 1), n - 1 - t) * value) / sum(power(1 - 2 / (span + 1), n - 1 - t)) AS ema FROM U GROUP BY 1)"
)
SHANNON = "EN AS (SELECT series_id, -sum(p * log2(p)) AS shannon FROM (SELECT series_id, count(*) / sum(count(*)) OVER (PARTITION BY series_id) AS p FROM L GROUP BY series_id, value) GROUP BY 1)"
BENFORD = (
    "BD AS (SELECT series_id, try_cast(substr(ltrim(CAST(CAST(abs(value) AS DECIMAL(24,6)) AS VARCHAR), '0.'), 1, 1) AS INT) AS d, count(*) AS k FROM L GROUP BY ALL), "
    "BF AS (SELECT series_id, corr(log10(1 + 1 / x.d), coalesce(k, 0)) AS benford FROM (SELECT DISTINCT series_id FROM L) s CROSS JOIN (SELECT unnest(range(1, 10)) AS d) x LEFT JOIN BD USING (series_id, d) GROUP BY 1)"
)
MEDIANS = (
    "MA AS (SELECT series_id, list(value ORDER BY t) AS v, count(*) AS n, greatest(2, count(*) // 10) AS s FROM L GROUP BY 1), "
    "MM AS (SELECT series_id, list_avg(list_transform(range(0, greatest(1, n - s + 1)), lambda i: list_median(v[i + 1:i + s]))) AS moving_median FROM MA)"
)
query("feat_basic9", lambda s, d: features.basic(long(s, d)), f"{LONG} ||| SELECT series_id, {BASIC_SQL} FROM L GROUP BY 1", " ".join(features.BASIC))
for name, columns in (("feat_skew_kurt", "skewness kurtosis"), ("feat_slope", "slope"), ("feat_iqr", "iqr"), ("feat_energy", "energy"), ("feat_crest", "crest"), ("feat_ptp", "ptp")):
    query(name, lambda s, d, c=columns: features.moments(long(s, d)).select("series_id", *c.split()), f"{LONG}, {MOMENTS} ||| SELECT series_id, {', '.join(columns.split())} FROM MO", columns)
query("feat_peaks", lambda s, d: features.peak_features(long(s, d)).select("series_id", "n_peaks"), f"{LONG}, {PEAKS} ||| SELECT series_id, n_peaks FROM PF")
query("feat_peak_distance", lambda s, d: features.peak_features(long(s, d)).select("series_id", "mean_peak_distance"), f"{LONG}, {PEAKS} ||| SELECT series_id, mean_peak_distance FROM PF", "mean_peak_distance")
for name, columns in (("feat_cross_rate", "cross_rate"), ("feat_autocorr", "autocorrelation"), ("feat_ema", "ema"), ("feat_hjorth", "mobility complexity"), ("feat_petrosian", "petrosian")):
    query(name, lambda s, d, c=columns: features.sequence_features(long(s, d)).select("series_id", *c.split()), f"{LAGS}, {SEQ} ||| SELECT series_id, {', '.join(columns.split())} FROM SF", columns)
query("feat_shannon", lambda s, d: features.entropy(long(s, d)), f"{LONG}, {SHANNON} ||| SELECT series_id, shannon FROM EN", "shannon")
query("feat_benford", lambda s, d: features.benford(long(s, d)), f"{LONG}, {BENFORD} ||| SELECT series_id, benford FROM BF", "benford")
query("feat_moving_median", lambda s, d: features.moving_median(long(s, d)), f"{LONG}, {MEDIANS} ||| SELECT series_id, moving_median FROM MM", "moving_median")
query(
    "feat_base_entropy",
    lambda s, d: features.distribution_entropy(long(s, d)),
    f"{LONG}, PE AS (SELECT series_id, value, value / nullif(sum(value) OVER (PARTITION BY series_id), 0) AS p FROM L) ||| SELECT series_id, -sum(p * ln(p)) FILTER (p > 0) AS base_entropy, count(*) FILTER (value < 0.01) AS below FROM PE GROUP BY 1",
    "base_entropy",
)
ALL = [*features.BASIC, *"skewness kurtosis slope iqr energy ptp crest n_peaks mean_peak_distance cross_rate autocorrelation mobility complexity petrosian ema shannon benford moving_median".split()]
query(
    "feat_global",
    lambda s, d: features.all_features(long(s, d)),
    f"{LAGS}, {MOMENTS}, {PEAKS}, {SEQ}, {SHANNON}, {BENFORD}, {MEDIANS}, BA AS (SELECT series_id, {BASIC_SQL} FROM L GROUP BY 1) ||| SELECT series_id, "
    + ", ".join(f"CASE WHEN {c} IS NULL OR isnan(CAST({c} AS DOUBLE)) THEN 0.0 ELSE CAST({c} AS DOUBLE) END AS {c}" for c in ALL)
    + " FROM BA JOIN MO USING (series_id) JOIN PF USING (series_id) JOIN SF USING (series_id) JOIN EN USING (series_id) JOIN BF USING (series_id) JOIN MM USING (series_id)",
    " ".join(ALL),
)

# ---- windows
WINDOWS = (
    'NW AS (SELECT series_id, count(*) AS n FROM L GROUP BY 1), WI AS (SELECT series_id, unnest(range(0, (n - {w}) // {s} + 1)) AS window_id FROM NW WHERE n >= {w}), '
    'WP AS (SELECT series_id, window_id, window_id * {s} AS "start", window_id * {s} + {w} AS "end", t, value FROM WI JOIN L USING (series_id) WHERE t >= window_id * {s} AND t < window_id * {s} + {w})'
)
SUMS = 'SELECT series_id, window_id, any_value("start") AS "start", any_value("end") AS "end", arg_min(value, t) AS "first", arg_max(value, t) AS "last", sum(value) AS sum FROM WP GROUP BY series_id, window_id'
STATS = 'SELECT series_id, window_id, any_value("start") AS "start", any_value("end") AS "end", avg(value) AS mean, stddev_pop(value) AS std, min(value) AS min, max(value) AS max, arg_max(value, t) - arg_min(value, t) AS trend FROM WP GROUP BY series_id, window_id'
query("hankel_windows", lambda s, d: windows.window_sums(windows.sliding(long(s, d), 8, 2)), f"{LONG}, {WINDOWS.format(w=8, s=2)} ||| {SUMS}", "sum")
query("page_windows", lambda s, d: windows.window_sums(windows.pages(long(s, d), 7)), f"{LONG}, {WINDOWS.format(w=7, s=7)} ||| {SUMS}", "sum")
query("window_stats5", lambda s, d: windows.window_statistics(windows.sliding(long(s, d), 8, 2)), f"{LONG}, {WINDOWS.format(w=8, s=2)} ||| {STATS}", "mean std min max trend")
query(
    "local_basic9",
    lambda s, d: features.basic(windows.pages(long(s, d), 10), ("series_id", "window_id")),
    f"{LONG}, {WINDOWS.format(w=10, s=10)} ||| SELECT series_id, window_id, {BASIC_SQL} FROM WP GROUP BY series_id, window_id",
    " ".join(features.BASIC),
)
query(
    "window_gaps",
    lambda s, d: windows.gap_fractions(windows.sliding(holed(s, d), 8, 3), 0.2),
    f"{HOLED}, NW AS (SELECT series_id, count(*) AS n FROM H GROUP BY 1), WI AS (SELECT series_id, unnest(range(0, (n - 8) // 3 + 1)) AS window_id FROM NW WHERE n >= 8), WP AS (SELECT series_id, window_id, value FROM WI JOIN H USING (series_id) WHERE t >= window_id * 3 AND t < window_id * 3 + 8) "
    "||| SELECT series_id, window_id, avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END) AS gap_fraction, avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END) <= 0.2 AS valid FROM WP GROUP BY 1, 2",
    "gap_fraction",
)
query("diagonal_average", lambda s, d: windows.diagonal_average(windows.sliding(long(s, d), 8, 2)), f"{LONG}, {WINDOWS.format(w=8, s=2)} ||| SELECT series_id, t, avg(value) AS value FROM WP GROUP BY 1, 2", "value")
query(
    "supervised_windows",
    lambda s, d: windows.supervised(long(s, d), 6, 2, 3).select("series_id", "window_id", F.aggregate("x", F.lit(0.0), lambda a, x: a + x).alias("sx"), F.element_at("y", -1).alias("y_last")),
    f"{LONG}, {WINDOWS.format(w=8, s=3)} ||| SELECT series_id, window_id, sum(CASE WHEN t < \"start\" + 6 THEN value ELSE 0 END) AS sx, arg_max(value, t) AS y_last FROM WP GROUP BY series_id, window_id",
    "sx",
)
query(
    "window_sizes",
    lambda s, d: long(s, d).groupBy("series_id").agg(F.count("*").cast("int").alias("n")).select("series_id", windows.window_size(F.col("n")).cast("long").alias("size"), windows.stride_of(windows.window_size(F.col("n"))).cast("long").alias("stride"), windows.trajectory_length(F.col("n")).cast("long").alias("trajectory")),
    f"{LONG}, NN AS (SELECT series_id, count(*) AS n FROM L GROUP BY 1), SZ AS (SELECT series_id, n, CASE WHEN n < 4 THEN greatest(1, n) ELSE least(greatest(8, CAST(round_even(n * 0.1, 0) AS BIGINT)), n) END AS size, CAST(round_even(n * 0.35, 0) AS BIGINT) AS r FROM NN) "
    "||| SELECT series_id, CAST(size AS BIGINT) AS size, CAST(greatest(1, size // 4) AS BIGINT) AS stride, CAST(CASE WHEN r < 2 OR r > n / 2 THEN n // 3 ELSE r END AS BIGINT) AS trajectory FROM SZ",
)
query(
    "piecewise_means",
    lambda s, d: windows.piecewise_means(long(s, d), 6),
    f"{LONG}, X AS (SELECT *, count(*) OVER (PARTITION BY series_id) AS n FROM L) ||| SELECT series_id, CAST(t * 6 // n AS BIGINT) AS piece, avg(value) AS value FROM X GROUP BY 1, 2",
    "value",
)
query(
    "lag_table",
    lambda s, d: windows.lag_table(long(s, d).select("series_id", "t", "value"), 2, 1),
    f"{LONG}, X AS (SELECT series_id, t, value, lag(value) OVER w AS lag_1, lag(value, 2) OVER w AS lag_2, lead(value) OVER w AS lead_1 FROM L WINDOW w AS (PARTITION BY series_id ORDER BY t)) ||| SELECT * FROM X WHERE lag_2 IS NOT NULL AND lead_1 IS NOT NULL",
)

# ---- detection
Z = " + ".join(f"power(({c} - avg({c}) OVER w) / greatest(stddev_pop({c}) OVER w, 1e-8), 2)" for c in ("mean", "std", "min", "max", "trend"))
POINTS = (
    f"{LONG}, {WINDOWS.format(w=8, s=2)}, WS AS ({STATS}), SC AS (SELECT *, sqrt(({Z}) / 5) AS score FROM WS WINDOW w AS (PARTITION BY series_id)), "
    'PT AS (SELECT L.series_id, L.t, coalesce(avg(s.score), 0.0) AS score FROM L LEFT JOIN SC s ON L.series_id = s.series_id AND L.t >= s."start" AND L.t < s."end" GROUP BY 1, 2)'
)
MAD = (
    "T1 AS (SELECT series_id, median(score) AS m FROM PT GROUP BY 1), T2 AS (SELECT series_id, any_value(m) AS m, median(abs(score - m)) AS d, stddev_pop(score) AS s FROM PT JOIN T1 USING (series_id) GROUP BY 1), "
    "TH AS (SELECT series_id, m + 3 * CASE WHEN d <= 1e-8 THEN s ELSE d END AS threshold FROM T2)"
)
REGIMES = (
    "RD AS (SELECT series_id, t, value, coalesce(value - lag(value) OVER (PARTITION BY series_id ORDER BY t), 0.0) AS step FROM L), "
    "RQ AS (SELECT series_id, quantile_cont(abs(step), 0.85) AS q85, quantile_cont(value, 0.75) AS q75, quantile_cont(value, 0.25) AS q25 FROM RD GROUP BY 1), "
    "RG AS (SELECT series_id, t, value, step, CASE WHEN abs(step) >= q85 THEN 'transition' WHEN value >= q75 THEN 'high_load' WHEN value <= q25 THEN 'low_load' ELSE 'stable' END AS regime FROM RD JOIN RQ USING (series_id)), "
    "RR AS (SELECT *, CASE WHEN lag(regime) OVER (PARTITION BY series_id ORDER BY t) = regime THEN 0 ELSE 1 END AS c, coalesce(stddev_samp(value) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 0.0) AS vol FROM RG), "
    "RS AS (SELECT *, sum(c) OVER (PARTITION BY series_id ORDER BY t) AS run FROM RR), "
    'SG AS (SELECT series_id, min(t) AS "start", max(t) AS "end", any_value(regime) AS regime, avg(value) AS level, avg(vol) AS volatility, avg(step) AS slope FROM RS GROUP BY series_id, run)'
)
EVENTS = (
    "EV0 AS (SELECT PT.*, t - row_number() OVER (PARTITION BY series_id ORDER BY t) AS k FROM PT JOIN TH USING (series_id) WHERE score >= threshold), "
    'EV AS (SELECT series_id, min(t) AS "start", max(t) AS "end", count(*) AS length, arg_min(t, (-score, t)) AS peak_t, max(score) AS peak, avg(score) AS mean FROM EV0 GROUP BY series_id, k)'
)


def _points(s, d):
    rows = long(s, d)
    w = windows.window_statistics(windows.sliding(rows, 8, 2))
    return windows.points_of(detect.z_distance(w, ["mean", "std", "min", "max", "trend"]), rows, "score")


query("window_scores", lambda s, d: detect.z_distance(windows.window_statistics(windows.sliding(long(s, d), 8, 2)), ["mean", "std", "min", "max", "trend"]).select("series_id", "window_id", "score"), f"{POINTS} ||| SELECT series_id, window_id, score FROM SC", "score")
query("points_from_windows", _points, f"{POINTS} ||| SELECT series_id, t, score FROM PT", "score")
query("threshold_mad", lambda s, d: detect.threshold(_points(s, d), "mad"), f"{POINTS}, {MAD} ||| SELECT * FROM TH", "threshold")
query("threshold_quantile", lambda s, d: detect.threshold(_points(s, d), "quantile"), f"{POINTS} ||| SELECT series_id, quantile_cont(score, 0.99) AS threshold FROM PT GROUP BY 1", "threshold")
query("threshold_domain", lambda s, d: detect.threshold(_points(s, d), "domain_calibrated"), f"{POINTS} ||| SELECT series_id, avg(score) + 2.5 * stddev_pop(score) AS threshold FROM PT GROUP BY 1", "threshold")
query("threshold_regime", lambda s, d: detect.regime_threshold(_points(s, d), detect.regimes(long(s, d))), f"{POINTS}, {REGIMES} ||| SELECT series_id, quantile_cont(score, 0.99) AS threshold FROM PT JOIN RG USING (series_id, t) WHERE regime <> 'transition' GROUP BY 1", "threshold")
query("score_probabilities", lambda s, d: detect.probabilities(_points(s, d), detect.threshold(_points(s, d), "mad")), f"{POINTS}, {MAD}, PS AS (SELECT *, stddev_pop(score) OVER (PARTITION BY series_id) AS sd FROM PT JOIN TH USING (series_id)) ||| SELECT series_id, t, 1 / (1 + exp(-(score - threshold) / CASE WHEN sd <= 1e-8 THEN greatest(threshold, 1) ELSE sd END)) AS probability FROM PS", "probability")
query("regime_labels", lambda s, d: detect.regimes(long(s, d)), f"{LONG}, {REGIMES} ||| SELECT * FROM RG", "step")
query("regime_segments", lambda s, d: detect.segments(detect.regimes(long(s, d))), f"{LONG}, {REGIMES} ||| SELECT * FROM SG", "level volatility slope")
query("detect_events", lambda s, d: detect.events(_points(s, d), detect.threshold(_points(s, d), "mad")), f"{POINTS}, {MAD}, {EVENTS} ||| SELECT * FROM EV", "peak mean")
RISK = 'SELECT e.series_id, e.peak_t, e."start", e."end", e.length, e.peak, e.mean, g.regime, g.level FROM EV e LEFT JOIN SG g ON e.series_id = g.series_id AND e.peak_t BETWEEN g."start" AND g."end"'
query("risk_frame", lambda s, d: detect.detect(long(s, d)), f"{POINTS}, {MAD}, {EVENTS}, {REGIMES} ||| {RISK}", "peak mean level")
query("flagship_detection", lambda s, d: detect.detect(long(s, d)), f"{POINTS}, {MAD}, {EVENTS}, {REGIMES} ||| {RISK}", "peak mean level")

# ---- forecasts and folds
STEPS = "NF AS (SELECT series_id, count(*) AS n, arg_max(value, t) AS lst, arg_min(value, t) AS fst, avg(value) AS m, regr_slope(value, t) AS a, regr_intercept(value, t) AS b FROM L GROUP BY 1), HS AS (SELECT unnest(range(1, 6)) AS h)"
for name, method, y in (
    ("naive_last", "last", "lst"),
    ("naive_mean", "mean", "m"),
    ("naive_drift", "drift", "lst + CASE WHEN n > 1 THEN (lst - fst) / (n - 1) ELSE 0 END * h"),
    ("linear_trend", "linear_trend", "coalesce(b, m) + coalesce(a, 0) * (n - 1 + h)"),
):
    query(name, lambda s, d, m=method: forecast.naive(long(s, d), 5, m), f"{LONG}, {STEPS} ||| SELECT series_id, h, {y} AS y FROM NF, HS", "y")
query("moving_average", lambda s, d: forecast.naive(long(s, d), 5, "moving_average"), f"{LONG}, {STEPS} ||| SELECT series_id, h, avg(value) AS y FROM L JOIN NF USING (series_id), HS WHERE t >= n - 3 GROUP BY 1, 2", "y")
query("seasonal_naive", lambda s, d: forecast.seasonal_naive(long(s, d), 5, 4), f"{LONG}, {STEPS} ||| SELECT series_id, h, value AS y FROM L JOIN NF USING (series_id), HS WHERE t = n - 4 + (h - 1) % 4")
query("split_holdout", lambda s, d: forecast.split_last(long(s, d), 5).select("series_id", "t", "split"), f"{LONG}, {STEPS} ||| SELECT series_id, t, CASE WHEN t >= n - 5 THEN 'test' ELSE 'train' END AS split FROM L JOIN NF USING (series_id)")
FOLD = {
    "holdout": "SELECT series_id, CAST(0 AS BIGINT) AS fold, CAST(0 AS BIGINT) AS train_start, n - 5 AS train_end, n - 5 AS test_start, n AS test_end FROM NF WHERE n >= 12",
    "expanding": "SELECT series_id, fold, CAST(0 AS BIGINT) AS train_start, n - 5 - (k - 1 - fold) * 5 AS train_end, n - 5 - (k - 1 - fold) * 5 AS test_start, n - (k - 1 - fold) * 5 AS test_end FROM (SELECT series_id, n, k, unnest(range(0, k)) AS fold FROM (SELECT series_id, n, least(10, (n - 12) // 5 + 1) AS k FROM NF WHERE n >= 12))",
    "series_split": "SELECT series_id, fold, CAST(0 AS BIGINT) AS train_start, n - (10 - fold) * z AS train_end, n - (10 - fold) * z AS test_start, n - (10 - fold) * z + z AS test_end FROM (SELECT series_id, n, n // 11 AS z, unnest(range(0, 10)) AS fold FROM NF WHERE n // 11 >= 1)",
}
FOLD["rolling"] = FOLD["expanding"].replace("CAST(0 AS BIGINT) AS train_start", "greatest(0, n - 5 - (k - 1 - fold) * 5 - 7) AS train_start")
for name, kind in (("folds_holdout", "holdout"), ("folds_expanding", "expanding"), ("folds_rolling", "rolling"), ("folds_tss", "series_split")):
    query(name, lambda s, d, k=kind: forecast.folds(long(s, d), 5, k), f"{LONG}, {STEPS} ||| {FOLD[kind]}")
