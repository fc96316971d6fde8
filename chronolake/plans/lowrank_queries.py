"""Queries over low-rank models, alignments, kernels, one-class detection and filters with state."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronolake.operators import alignment, filters, kernels, lowrank, matrix, windows
from chronolake.plans.inputs import PANEL, long, panel, query
from chronolake.plans.model_queries import _drained
from chronolake.streaming import online

RANK = 8


def _svd(s, d):
    return lowrank.randomised_svd(panel(s, d), RANK, rounds=6)


def _singular(s, d):
    svd = _svd(s, d)
    rows = [(k, float(x), float(x * x / svd.norm), svd.stable_rank) for k, x in enumerate(svd.values)]
    return s.createDataFrame(rows, "component long, value double, share double, stable_rank double")


query("rsvd_values", _singular, doubles="value share stable_rank")
query("rsvd_scores", lambda s, d: lowrank.left_scores(panel(s, d), _svd(s, d)), doubles="score")
query("cur_errors", lambda s, d: lowrank.cur_errors(panel(s, d), lowrank.cur(panel(s, d), 24, 16)), doubles="norm error")

# ---- alignment of all samples with the four of least id, and their stretches as shapelets
FIRST = f"{PANEL}, F4 AS (SELECT sample_id, v FROM P WHERE v IS NOT NULL ORDER BY sample_id LIMIT 4)"


def _first(s, d):
    return panel(s, d).where(F.col("values").isNotNull()).orderBy("sample_id").limit(4)


query("soft_dtw", lambda s, d: alignment.soft_dtw(matrix.anchored_pairs(panel(s, d), _first(s, d)), 0.1), doubles="distance")
query("soft_dtw_loss", lambda s, d: alignment.soft_dtw_loss(matrix.anchored_pairs(panel(s, d), _first(s, d)), 0.1), doubles="loss")
query("shapelet_features", lambda s, d: alignment.shapelet_distances(panel(s, d), [c for _, _, c in alignment.shapelets(panel(s, d))]), doubles="distance")
query(
    "shapelet_first",
    lambda s, d: alignment.shapelet_distances(panel(s, d), [list(r["values"][4 * k : 4 * k + 12]) for k, r in enumerate(_first(s, d).collect())]),
    f"{FIRST}, SC AS (SELECT CAST(row_number() OVER (ORDER BY sample_id) - 1 AS INT) AS shapelet, v FROM F4), SL AS (SELECT shapelet, v[4 * shapelet + 1 : 4 * shapelet + 12] AS c FROM SC), "
    "SP AS (SELECT sample_id, shapelet, c, v, unnest(range(0, len(v) - 11)) AS pos FROM P, SL) ||| SELECT sample_id, shapelet, min(sqrt(list_sum(list_transform(list_zip(v[pos + 1 : pos + 12], c), lambda p: power(p[1] - p[2], 2))) / 12)) AS distance FROM SP GROUP BY 1, 2",
    "distance",
)
query("random_projection", lambda s, d: alignment.random_projection(panel(s, d), lowrank.width_of(panel(s, d)), 16), doubles="value")

# ---- kernels and one class
KERNELS = {"rbf": ("rbf", 0.5), "wide": ("rbf", 0.05), "linear": ("linear", 1.0), "poly": ("poly", 0.5)}


def _weights(s, d):
    ids, marks = kernels.landmarks(panel(s, d), 32)
    return s.createDataFrame(kernels.kernel_weights(kernels.kernel_products(panel(s, d), KERNELS, marks)), "kernel string, alignment double, complexity double, redundancy double, weight double")


query("kernel_weights", _weights, doubles="alignment complexity redundancy weight")
STATISTICS = ["mean", "std", "min", "max", "trend"]


def _one_class(s, d):
    points = windows.window_statistics(windows.sliding(long(s, d), 8, 2)).select("series_id", "window_id", *STATISTICS)
    return kernels.one_class_scores(points, kernels.one_class(points, STATISTICS)).select("series_id", "window_id", "score")


query("one_class_windows", _one_class, doubles="score")

# ---- filters
query("unscented_filter", lambda s, d: filters.unscented(long(s, d), filters.damped_trend(noise=100.0)), doubles="expected variance level score")
query("online_autoregression", lambda s, d: filters.online_autoregression(long(s, d)).withColumn("expected", F.nanvl("expected", F.lit(None).cast("double"))), doubles="expected move")
query("stream_online_weights", lambda s, d: _drained(s, d, online.online_weights).select("user_id", "event_id", "expected", "move"), doubles="expected move")
