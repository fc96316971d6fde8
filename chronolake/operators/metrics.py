"""Metrics over groups of predictions: regression, forecasting, classification, detection."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolake.operators.layouts import by_series, whole_series


def _over(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def regression(rows: DataFrame, *keys: str) -> DataFrame:
    """mse rmse mae r2 mape smape medae max_error explained_variance msle (negatives as 0) by ``keys``."""
    y, p = F.col("y_true"), F.col("y_pred")
    e = y - p
    sst = F.var_pop("y_true") * F.count("*")
    return rows.groupBy(*keys).agg(
        F.avg(e * e).alias("mse"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        F.when(sst <= 1e-12, 0.0).otherwise(1 - F.sum(e * e) / sst).alias("r2"),
        F.avg(F.abs(e) / F.greatest(F.lit(1e-8), F.abs(y))).alias("mape"),
        F.avg(200 * F.abs(e) / F.greatest(F.lit(1e-8), F.abs(y) + F.abs(p))).alias("smape"),
        F.percentile(F.abs(e), F.lit(0.5)).alias("medae"),
        F.max(F.abs(e)).alias("max_error"),
        F.when(F.var_pop("y_true") <= 1e-12, 0.0).otherwise(1 - F.var_pop(e) / F.var_pop("y_true")).alias("explained_variance"),
        F.avg((F.log1p(F.greatest(y, F.lit(0.0))) - F.log1p(F.greatest(p, F.lit(0.0)))) ** 2).alias("msle"),
    )


def d2_absolute(rows: DataFrame, *keys: str) -> DataFrame:
    """1 - MAE / MAE of the median."""
    w = Window.partitionBy(*keys)
    m = rows.withColumn("m", F.percentile("y_true", F.lit(0.5)).over(w))
    base = F.avg(F.abs(F.col("y_true") - F.col("m")))
    return m.groupBy(*keys).agg(F.when(base <= 1e-12, 0.0).otherwise(1 - F.avg(F.abs(F.col("y_true") - F.col("y_pred"))) / base).alias("d2"))


def _scaled(train: DataFrame, season: int) -> DataFrame:
    """series_id, scale: the mean absolute seasonal step of the training values (of one place, where a series isn't
    longer than the season); 1 where that is 1e-8 or less, or nothing is left."""
    w, n = by_series(), F.count("*").over(whole_series())
    far = F.when((n > season) & F.lit(season > 1), F.lag("value", season).over(w)).otherwise(F.lag("value").over(w))
    steps = train.select("series_id", F.abs(F.col("value") - far).alias("d")).groupBy("series_id").agg(F.avg("d").alias("s"))
    return steps.select("series_id", F.when(F.coalesce("s", F.lit(0.0)) <= 1e-8, 1.0).otherwise(F.col("s")).alias("scale"))


def _smape(p: str) -> Column:
    return 200 * F.abs(F.col("y_true") - F.col(p)) / F.greatest(F.lit(1e-8), F.abs("y_true") + F.abs(p))


def forecast(train: DataFrame, rows: DataFrame, naive: DataFrame, season: int = 1) -> DataFrame:
    """series_id, smape, mase, owa. ``rows``: series_id, h, y_true, y_pred; ``naive``: series_id, h, y."""
    both = rows.join(naive, ["series_id", "h"]).join(_scaled(train, season), "series_id")

    def mase(p: str) -> Column:
        return F.avg(F.abs(F.col("y_true") - F.col(p)) / F.col("scale"))

    out = both.groupBy("series_id").agg(F.avg(_smape("y_pred")).alias("smape"), mase("y_pred").alias("mase"), F.avg(_smape("y")).alias("s0"), mase("y").alias("m0"))
    owa = 0.5 * (F.col("smape") / F.greatest("s0", F.lit(1e-8)) + F.col("mase") / F.greatest("m0", F.lit(1e-8)))
    return out.select("series_id", "smape", "mase", owa.alias("owa"))


def pointwise(train: DataFrame, rows: DataFrame, naive: DataFrame, season: int = 1) -> DataFrame:
    """series_id, h, pw_mae, pw_rmse (the same, by point), pw_smape, pw_mase, pw_owa; inputs as in ``forecast``."""
    both = rows.join(naive, ["series_id", "h"]).join(_scaled(train, season), "series_id")
    e, e0 = F.abs(F.col("y_true") - F.col("y_pred")), F.abs(F.col("y_true") - F.col("y"))
    mase, mase0 = e / F.col("scale"), e0 / F.col("scale")
    owa = 0.5 * (_smape("y_pred") / F.greatest(_smape("y"), F.lit(1e-8)) + mase / F.greatest(mase0, F.lit(1e-8)))
    return both.select("series_id", "h", e.alias("pw_mae"), e.alias("pw_rmse"), _smape("y_pred").alias("pw_smape"), mase.alias("pw_mase"), owa.alias("pw_owa"))


def confusion(rows: DataFrame) -> DataFrame:
    """y_true, y_pred, n for all pairs of labels that occur on either side; absent pairs are 0."""
    counts = rows.groupBy("y_true", "y_pred").agg(F.count("*").alias("n"))
    labels = counts.select(F.explode(F.array("y_true", "y_pred")).alias("label")).distinct()
    every = labels.select(F.col("label").alias("y_true")).crossJoin(labels.select(F.col("label").alias("y_pred")))
    return every.join(counts, ["y_true", "y_pred"], "left").select("y_true", "y_pred", F.coalesce("n", F.lit(0)).alias("n"))


def per_class(rows: DataFrame) -> DataFrame:
    """label, precision, recall, f1 (0 over 0 is 0), support: from the pairs of labels that occur, never from all; null
    labels have no row."""
    c = rows.groupBy("y_true", "y_pred").agg(F.count("*").alias("n"))
    by_true = c.groupBy(F.col("y_true").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)).alias("hit"))
    by_pred = c.groupBy(F.col("y_pred").alias("label")).agg(F.sum("n").alias("told"))
    both = by_true.join(by_pred, "label", "full").where(F.col("label").isNotNull()).na.fill(0, ["support", "hit", "told"])
    precision, recall = _over(F.col("hit"), F.col("told")), _over(F.col("hit"), F.col("support"))
    return both.select("label", precision.alias("precision"), recall.alias("recall"), _over(2 * F.col("hit"), F.col("told") + F.col("support")).alias("f1"), "support")


def classification(rows: DataFrame) -> DataFrame:
    """One row: accuracy, balanced_accuracy, macro and weighted precision, recall, f1."""
    c = per_class(rows)
    n, seen = F.sum("support"), F.when(F.col("support") > 0, F.col("recall"))
    macro = [F.avg(x).alias(f"{x}_macro") for x in ("precision", "recall", "f1")]
    weighted = [(F.sum(F.col(x) * F.col("support")) / n).alias(f"{x}_weighted") for x in ("precision", "recall", "f1")]
    return c.agg((F.sum(F.col("recall") * F.col("support")) / n).alias("accuracy"), F.avg(seen).alias("balanced_accuracy"), *macro, *weighted)


def averaged(rows: DataFrame) -> DataFrame:
    """One row: micro (the accuracy) and automatic averages of precision, recall, f1. Automatic: with two classes the
    class of least support (ties: the smaller) counts as positive; else precision and recall are macro, f1 weighted."""
    c = per_class(rows)
    n, positive = F.sum("support"), F.struct("support", "label")
    named = {"precision": F.avg("precision"), "recall": F.avg("recall"), "f1": F.sum(F.col("f1") * F.col("support")) / n}
    auto = [F.when(F.count("*") == 2, F.min_by(F.col(x), positive)).otherwise(many).alias(f"{x}_auto") for x, many in named.items()]
    return c.agg((F.sum(F.col("recall") * F.col("support")) / n).alias("micro"), *auto)


def binary(rows: DataFrame) -> DataFrame:
    """One row for labels 0 and 1: tp fp fn tn, precision, recall, f1, far and mar (percent)."""
    y, p = F.col("y_true") == 1, F.col("y_pred") == 1
    c = rows.agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select(
        "tp",
        "fp",
        "fn",
        "tn",
        _over(tp, tp + fp).alias("precision"),
        _over(tp, tp + fn).alias("recall"),
        _over(2 * tp, 2 * tp + fp + fn).alias("f1"),
        _over(100 * fp, fp + tn).alias("far"),
        _over(100 * fn, fn + tp).alias("mar"),
    )


def roc_auc(rows: DataFrame, *keys: str) -> DataFrame:
    """Area under the ROC curve by rank sums with average ranks; ``rows``: keys, y_true (0, 1), score.

    Equal scores are counted first, so the running sum is over distinct scores."""
    ties = rows.groupBy(*keys, "score").agg(F.count_if(F.col("y_true") == 1).alias("p"), F.count_if(F.col("y_true") == 0).alias("q"))
    below = F.sum("q").over(Window.partitionBy(*keys).orderBy("score")) - F.col("q")
    won = ties.select(*keys, "p", "q", (F.col("p") * (below + F.col("q") / 2)).alias("w"))
    return won.groupBy(*keys).agg(_over(F.sum("w"), F.sum("p") * F.sum("q")).alias("roc_auc"))


def log_loss(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows``: keys, y_true (0, 1), prob of 1."""
    p = F.least(F.greatest(F.when(F.col("y_true") == 1, F.col("prob")).otherwise(1 - F.col("prob")), F.lit(1e-15)), F.lit(1.0))
    return rows.groupBy(*keys).agg((-F.avg(F.ln(p))).alias("log_loss"))


def multiclass_log_loss(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows``: keys, sample_id, y_true, class, prob of every class; probabilities are normalised by sample."""
    w = Window.partitionBy(*keys, "sample_id")
    own = rows.withColumn("p", F.col("prob") / F.sum("prob").over(w)).where(F.col("class") == F.col("y_true"))
    p = F.least(F.greatest(F.col("p"), F.lit(1e-15)), F.lit(1.0))
    return own.groupBy(*keys).agg((-F.avg(F.ln(p))).alias("log_loss")) if keys else own.agg((-F.avg(F.ln(p))).alias("log_loss"))


def one_against_rest_auc(rows: DataFrame) -> DataFrame:
    """One row: the mean over classes of the area under the curve of each against the others; ``rows``: y_true, class,
    score of every class."""
    sides = rows.select("class", (F.col("y_true") == F.col("class")).cast("int").alias("y_true"), "score")
    return roc_auc(sides, "class").agg(F.avg("roc_auc").alias("roc_auc"))


def kl_divergence(rows: DataFrame, *keys: str) -> DataFrame:
    """Sum of p ln(p / q); ``rows``: keys, p, q (unnormalised)."""
    w = Window.partitionBy(*keys)
    p, q = F.greatest(F.col("p") / F.sum("p").over(w), F.lit(1e-12)), F.greatest(F.col("q") / F.sum("q").over(w), F.lit(1e-12))
    return rows.select(*keys, (p * F.ln(p / q)).alias("d")).groupBy(*keys).agg(F.sum("d").alias("kl"))


def skyline(costs: np.ndarray) -> np.ndarray:
    """Places of the rows that no other dominates: as good in all costs and better in one."""
    order = np.lexsort(costs.T[::-1])
    kept = np.empty((0, costs.shape[1]))
    out = []
    for i in order:
        x = costs[i]
        if not ((kept <= x).all(axis=1) & (kept < x).any(axis=1)).any():
            out.append(i)
            kept = np.vstack([kept, x])
    return np.array(out, int)


def _pareto_of_two(plain: DataFrame, a: str, b: str, buckets: int = 256) -> DataFrame:
    """A row stays if its second cost is the least of its first, and less than all before. The first cost is cut
    into ``buckets`` ranges; the least second cost of those before, a number a range, is all that they share."""
    least = plain.groupBy(a).agg(F.min(b).alias("_m")).where(F.col(a).isNotNull() & F.col("_m").isNotNull())
    edges = sorted(set(least.approxQuantile(a, [i / buckets for i in range(1, buckets)], 1 / (4 * buckets))))
    of = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= F.col(a))) if edges else F.lit(0)
    least = least.withColumn("_bucket", of)
    lows = {r["_bucket"]: float(r["m"]) for r in least.groupBy("_bucket").agg(F.min("_m").alias("m")).collect()}
    before = [float("inf")]
    for i in range(len(edges)):
        before.append(min(before[-1], lows.get(i, before[-1])))
    known = F.get(F.array(*map(F.lit, before)), F.col("_bucket"))
    w = Window.partitionBy("_bucket").orderBy(a).rowsBetween(Window.unboundedPreceding, -1)
    kept = least.withColumn("_before", F.least(F.coalesce(F.min("_m").over(w), F.lit(float("inf"))), known)).where("_m < _before")
    kept = kept.select(F.col(a).alias("_a"), "_m")
    return plain.join(kept, (plain[a] == F.col("_a")) & (plain[b] == F.col("_m"))).drop("_a", "_m")


def pareto(rows: DataFrame, key: str, costs: list[str]) -> DataFrame:
    """key and costs of the rows that no other dominates; rows with a null cost are none.

    Of more than two costs each task keeps its own front as its rows pass; fronts then meet by eights, round by
    round. How large the fronts are depends on the data: where most rows are on it, the last task holds it."""
    plain = rows.select(key, *costs).dropna(subset=costs)
    if len(costs) == 2:
        return _pareto_of_two(plain, *costs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        front = None
        for batch in batches:
            both = batch if front is None else pd.concat([front, batch], ignore_index=True)
            front = both.iloc[skyline(both[costs].to_numpy("float64"))]
        if front is not None:
            yield front

    parts, out = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), plain.mapInPandas(run, plain.schema)
    while parts > 1:
        parts = -(-parts // 8)
        out = out.repartition(parts).mapInPandas(run, plain.schema)
    return out


def detection_windows(truth: DataFrame, width: int) -> DataFrame:
    """series_id, w_start, w_end around each true change point t: from it to ``width`` after."""
    return truth.select("series_id", F.col("t").alias("w_start"), (F.col("t") + width).alias("w_end"))


def detection_delay(truth: DataFrame, hits: DataFrame, width: int) -> DataFrame:
    """series_id, found, missed, false_alarms, mean_delay of predicted change points.

    Windows explode into their points, so that the interval join is an equality."""
    windows = detection_windows(truth, width)
    inside = windows.select("series_id", "w_start", F.explode(F.sequence("w_start", "w_end")).alias("t"))
    joined = hits.select("series_id", "t").join(inside, ["series_id", "t"], "left")
    false = joined.groupBy("series_id").agg(F.count_if(F.col("w_start").isNull()).alias("false_alarms"))
    first = joined.where(F.col("w_start").isNotNull()).groupBy("series_id", "w_start").agg((F.min("t") - F.col("w_start")).alias("delay"))
    each = windows.join(first, ["series_id", "w_start"], "left").groupBy("series_id").agg(F.count("delay").alias("found"), F.count_if(F.col("delay").isNull()).alias("missed"), F.avg("delay").alias("mean_delay"))
    return each.join(false, "series_id", "left").select("series_id", "found", "missed", F.coalesce("false_alarms", F.lit(0)).alias("false_alarms"), "mean_delay")


#: Weights of hits, false alarms and misses by profile.
PROFILES = {"standard": (1.0, -0.11, -1.0), "low_fp": (1.0, -0.22, -1.0), "low_fn": (1.0, -0.11, -2.0)}


def nab_score(truth: DataFrame, hits: DataFrame, width: int, profile: str = "standard") -> DataFrame:
    """series_id, score. The first hit in the window of ``width`` after a change earns by its place: the reward at the
    start, down to the cost of a false alarm at the end, along a hyperbolic tangent in a thousand places; hits
    outside all windows cost that much each, and a window without a hit costs a miss. Scaled so that no
    hits at all are 0 and the full reward in every window is 100."""
    reward, fp, fn = PROFILES[profile]
    windows = detection_windows(truth, width)
    inside = windows.select("series_id", "w_start", F.explode(F.sequence("w_start", "w_end")).alias("t"))
    joined = hits.select("series_id", "t").join(inside, ["series_id", "t"], "left")
    first = joined.groupBy("series_id", "w_start").agg(F.min("t").alias("t"), F.count("*").alias("n"))
    place = F.floor((F.col("t") - F.col("w_start")) / max(width, 1) * 999) / 999
    earned = (reward - fp) / 2 * (1 - F.tanh(math.pi * place - math.pi / 2) / math.tanh(math.pi / 2)) + fp if width else F.lit(fp)
    gain = F.when(F.col("w_start").isNull(), fp * F.col("n")).otherwise(earned)
    won = first.select("series_id", gain.alias("g"), F.col("w_start").isNotNull().cast("int").alias("hit")).groupBy("series_id").agg(F.sum("g").alias("g"), F.sum("hit").alias("hit"))
    total = windows.groupBy("series_id").agg(F.count("*").alias("k")).join(won, "series_id", "left")
    raw = F.coalesce("g", F.lit(0.0)) + fn * (F.col("k") - F.coalesce("hit", F.lit(0)))
    return total.select("series_id", (100 * (raw - fn * F.col("k")) / ((reward - fn) * F.col("k"))).alias("score"))
