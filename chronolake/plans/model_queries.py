"""Queries over spectra, low-rank models, learned heads, injected anomalies and streams."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import functions as F

from chronolake.operators import features, forecast, learn, spectral, windows
from chronolake.plans.inputs import LONG, PANEL, long, panel, query, read
from chronolake.session import shared_folder
from chronolake.streaming import online

query("lagged_ridge", lambda s, d: forecast.lagged_ridge(long(s, d), 5))
query("ssa_forecast", lambda s, d: forecast.ssa(long(s, d), 5))
query("low_rank_ridge", lambda s, d: forecast.low_rank_ridge(long(s, d), 5))
query("forced_operator", lambda s, d: forecast.forced_operator(long(s, d), 5))
query("autoregression", lambda s, d: forecast.autoregression(long(s, d), 5))
query("dynamic_modes", lambda s, d: spectral.dynamic_modes(long(s, d)))
query("hurst", lambda s, d: spectral.hurst(long(s, d)))
FOURIER = (
    f"{LONG}, FE AS (SELECT series_id, t, value - avg(value) OVER w AS e, count(*) OVER w AS n FROM L WINDOW w AS (PARTITION BY series_id)), FB AS (SELECT DISTINCT series_id, n, unnest(range(0, n // 2 + 1)) AS bin FROM FE), "
    f"FW AS (SELECT FB.series_id, bin, any_value(FB.n) AS n, power(sum(e * cos({2 * math.pi!r} * bin * t / FB.n)), 2) + power(sum(e * sin({2 * math.pi!r} * bin * t / FB.n)), 2) AS p FROM FB JOIN FE USING (series_id) GROUP BY 1, 2)"
)
query("fourier_spectrum", lambda s, d: spectral.spectrum(long(s, d)), f"{FOURIER} ||| SELECT series_id, bin, p / n AS power FROM FW", "power", 5)
query(
    "dominant_period",
    lambda s, d: spectral.dominant_period(long(s, d)),
    f"{FOURIER}, FS AS (SELECT series_id, any_value(n) / arg_max(bin, p) AS period, max(p) / sum(p) AS concentration, exp(avg(ln(p + 1e-12))) / avg(p + 1e-12) AS flatness, sum(p) > 1e-12 AS strong FROM FW WHERE bin > 0 GROUP BY 1) "
    "||| SELECT series_id, CASE WHEN strong THEN period ELSE 0 END AS period, CASE WHEN strong THEN concentration ELSE 0 END AS concentration, CASE WHEN strong THEN flatness ELSE 0 END AS flatness FROM (SELECT DISTINCT series_id FROM L) LEFT JOIN FS USING (series_id)",
    "period concentration flatness",
)
# frames of 16 values, 8 apart, of the series reflected by 8 values at most
query(
    "stft",
    lambda s, d: spectral.short_time_spectrum(long(s, d)),
    f"{LONG}, TN AS (SELECT series_id, count(*) AS n, least(8, count(*) - 1) AS r FROM L GROUP BY 1), TP AS (SELECT series_id, n, r, unnest(range(0, n + 2 * r)) AS p FROM TN), "
    "TS AS (SELECT series_id, p, CASE WHEN p < r THEN r - p WHEN p - r > n - 1 THEN 2 * (n - 1) - p + r ELSE p - r END AS t FROM TP), "
    "TF AS (SELECT series_id, unnest(range(0, greatest(1, CAST(floor((n + 2 * r - 16) / 8) AS BIGINT) + 1))) AS frame FROM TN), "
    "TJ AS (SELECT j, bin FROM (SELECT unnest(range(0, 16)) AS j), (SELECT unnest(range(0, 9)) AS bin)), "
    f"TV AS (SELECT TF.series_id, frame, bin, j, coalesce(value, 0) * (0.5 - 0.5 * cos({2 * math.pi!r} * j / 16)) AS v FROM TF CROSS JOIN TJ LEFT JOIN TS ON TS.series_id = TF.series_id AND TS.p = frame * 8 + j LEFT JOIN L ON L.series_id = TS.series_id AND L.t = TS.t) "
    f"||| SELECT series_id, frame, bin, power(sum(v * cos({2 * math.pi!r} * bin * j / 16)), 2) + power(sum(v * sin({2 * math.pi!r} * bin * j / 16)), 2) AS power FROM TV GROUP BY 1, 2, 3",
    "power",
    4,
)
query("svd_rank", lambda s, d: spectral.singular_values(long(s, d)))
query("low_rank_series", lambda s, d: spectral.low_rank(long(s, d)))
query(
    "kalman",
    lambda s, d: spectral.kalman(long(s, d)),
    f"RECURSIVE {LONG}, KF AS (SELECT series_id, t, value AS level, 1.01 / 2.01 AS spread FROM L WHERE t = 0 UNION ALL SELECT L.series_id, L.t, k.level + (k.spread + 0.01) / (k.spread + 1.01) * (L.value - k.level), (k.spread + 0.01) / (k.spread + 1.01) FROM KF k JOIN L ON L.series_id = k.series_id AND L.t = k.t + 1) "
    "||| SELECT series_id, t, level FROM KF",
    "level",
)
query("sst", lambda s, d: spectral.subspace_change(long(s, d)))
query("kernel_features", lambda s, d: spectral.kernel_features(long(s, d)))
query("wavelet_haar", lambda s, d: spectral.haar(long(s, d)), f"{LONG} ||| SELECT series_id, CAST(t // 2 AS BIGINT) AS k, (arg_min(value, t) + arg_max(value, t)) / sqrt(2) AS approximation, (arg_min(value, t) - arg_max(value, t)) / sqrt(2) AS detail FROM L GROUP BY 1, 2", "approximation detail")
query(
    "switching_rate",
    lambda s, d: spectral.change_rates(long(s, d)),
    f"{LONG}, S1 AS (SELECT series_id, t, sign(value - lag(value) OVER (PARTITION BY series_id ORDER BY t)) AS s FROM L), S2 AS (SELECT *, lag(s) OVER (PARTITION BY series_id ORDER BY t) AS p FROM S1) ||| SELECT series_id, count(*) FILTER (s <> p) / greatest(count(p), 1) AS switching FROM S2 GROUP BY 1",
    "switching",
)
query("isolation_forest", lambda s, d: spectral.isolation_scores(windows.window_statistics(windows.sliding(long(s, d), 8, 2)), ["mean", "std", "min", "max", "trend"]).select("series_id", "window_id", "score"))


def _features(s, d):
    table = features.basic(long(s, d)).join(features.moments(long(s, d)), "series_id")
    return table.withColumn("target", F.when(F.col("q95") > 200, 1.0).otherwise(0.0))


query("rf_features", lambda s, d: learn.fit_predict(_features(s, d), "series_id", ["mean", "std", "q75", "slope", "crest"], "rf")[1])
query("logit_pca", lambda s, d: learn.fit_predict(_features(s, d), "series_id", ["mean", "median", "std", "q5", "q25", "q75"], "logit", 3)[1])
query("ridge_regressor", lambda s, d: learn.fit_predict(_features(s, d).withColumn("target", F.col("energy")), "series_id", ["mean", "std", "max"], "ridge")[1])

SHIFTS = {"shift_down": "value - 50", "dip": "value - 50 * (1 - abs(2 * ((t - 10) / 10.0) - 1))", "squeeze": "m + (value - m) / 50", "shift": "value + 50", "trend": "value + 50 * (t - 10) / 10.0", "peak": "value + 50 * (1 - abs(2 * ((t - 10) / 10.0) - 1))", "dispersion": "m + (value - m) * 50"}
for kind, value in SHIFTS.items():
    query(
        f"inject_{kind}",
        lambda s, d, k=kind: learn.inject(long(s, d), k, 10, 20, 50.0).select("series_id", "t", "value", "is_anomaly"),
        f"{LONG}, I AS (SELECT *, avg(value) FILTER (t BETWEEN 10 AND 20) OVER (PARTITION BY series_id) AS m FROM L) ||| SELECT series_id, t, CASE WHEN t BETWEEN 10 AND 20 THEN {value} ELSE value END AS value, CAST(t BETWEEN 10 AND 20 AS BIGINT) AS is_anomaly FROM I",
        "value",
    )


def _scores(s, d):
    """Three models' scores of three classes, from components of the vectors."""
    cells = panel(s, d).select("sample_id", F.posexplode("values").alias("k", "score"))
    return cells.select("sample_id", (F.col("k") % 3).alias("model"), (F.floor(F.col("k") / 3) % 3).alias("class"), (F.abs("score") + 0.01).alias("score"))


for how, agg in (("mean", "avg(s)"), ("median", "median(s)"), ("min", "min(s)"), ("max", "max(s)"), ("product", "exp(sum(ln(s)))")):
    query(
        f"rank_ensemble_{how}",
        lambda s, d, h=how: learn.rank_ensemble(_scores(s, d), h),
        f"{PANEL}, CS AS (SELECT sample_id, CAST(k // 3 % 3 AS BIGINT) AS c, abs(v[k + 1]) + 0.01 AS s FROM (SELECT sample_id, v, unnest(range(0, len(v))) AS k FROM P)), AG AS (SELECT sample_id, c, round({agg}, 9) AS s FROM CS GROUP BY 1, 2) ||| SELECT sample_id, arg_max(c, (s, -c)) AS label FROM AG GROUP BY 1",
    )
query(
    "occlusion",
    lambda s, d: learn.occlusion(long(s, d), "mean", 10),
    f"{LONG}, B AS (SELECT *, CAST(t // 10 AS BIGINT) AS b FROM L), W AS (SELECT series_id, avg(value) AS w FROM L GROUP BY 1), N AS (SELECT DISTINCT series_id, b AS block FROM B) ||| SELECT series_id, block, any_value(abs(w - p)) AS importance FROM (SELECT N.series_id, N.block, avg(B.value) AS p FROM N JOIN B ON N.series_id = B.series_id AND N.block <> B.b GROUP BY 1, 2) JOIN W USING (series_id) GROUP BY 1, 2",
    "importance",
)


# ---- streams: the table read as a stream of files, drained into Parquet
def _drained(s, d, make):
    base = f"{shared_folder(s)}/stream-{uuid.uuid4().hex}"
    schema = read(s, d, "events").schema
    stream = s.readStream.schema(schema).parquet(f"{d}/events.parquet*")  # a pattern fits a file and a folder alike
    stream = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    return online.drain(make(stream), f"{base}/out", f"{base}/state")


query(
    "stream_tumbling",
    lambda s, d: _drained(s, d, online.tumbling).withColumn("start", F.unix_seconds("start")),
    "SELECT epoch_us(date_trunc('day', ts)) // 1000000 AS start, event_type, count(*) AS n, sum(value) AS total FROM events WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY 1, 2",
    "total",
)
query("stream_dedup", lambda s, d: _drained(s, d, lambda x: online.first_only(x, ["event_id"])).select("event_id", "value"), "SELECT event_id, value FROM events")
query("stream_session", lambda s, d: _drained(s, d, online.sessions))
query("stream_online_z", lambda s, d: _drained(s, d, online.online_z))
