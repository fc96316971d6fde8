"""Small hand-made series: edges that the tables don't have."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolake.operators import detect, features, forecast, layouts, leaderboard, learn, matrix, metrics, quality, spectral, windows


def series(spark, values, key=1):
    return spark.createDataFrame([(key, i, None if v is None else float(v)) for i, v in enumerate(values)], "series_id long, t long, value double")


def one(df):
    return df.collect()[0]


def test_layouts_round_trip(spark):
    rows = series(spark, [3, 1, 2])
    assert [r["values"] for r in layouts.to_panel(rows).collect()] == [[3.0, 1.0, 2.0]]
    assert sorted(map(tuple, layouts.from_panel(layouts.to_panel(rows)).collect())) == sorted(map(tuple, rows.collect()))


@pytest.mark.parametrize(("values", "peaks"), [([1, 3, 1], [1]), ([1, 3, 3, 1], [1]), ([1, 3, 3, 3, 1], [2]), ([3, 1, 3], []), ([1, 1, 1], []), ([1], []), ([0, 2, 1, 2, 0], [1, 3])])
def test_peaks(spark, values, peaks):
    assert sorted(r.t for r in features.peaks(series(spark, values)).collect()) == peaks


def test_features_of_degenerate_series(spark):
    for values in ([5], [5, 5], [1, 2, 3], [1, -1] * 10, [0] * 12):
        row = one(features.all_features(series(spark, values)))
        assert all(isinstance(x, (int, float)) and not math.isnan(x) for x in row)
    row = one(features.all_features(series(spark, [1, -1] * 10)))
    assert row.cross_rate == pytest.approx(19 / 20) and row.autocorrelation == pytest.approx(-1)


def test_window_arithmetic(spark):
    sizes = spark.createDataFrame([(n,) for n in (1, 2, 3, 4, 10, 15, 25, 35, 45, 200)], "n int")
    got = {r.n: (r.a, r.b, r.c) for r in sizes.select("n", windows.window_size(F.col("n")).alias("a"), windows.window_size(F.col("n"), percent=10).alias("b"), windows.trajectory_length(F.col("n")).alias("c")).collect()}
    for n, (a, b, c) in got.items():
        assert a == (max(1, n) if n < 4 else min(max(8, round(n * 0.1)), n))
        assert b == (max(1, n) if n < 4 else max(2, min(round(n * 10 / 100), n)))
        raw = round(n * 0.35)
        assert c == (n // 3 if raw < 2 or raw > n / 2 else raw)


def test_window_shares_are_decimals(spark):
    """Shares of whole numbers in hundredths: a half is one, and goes to the even number, also where 0.35 n as a double isn't."""
    even = lambda n, hundredths: (n * hundredths + 49 + (n * hundredths // 100) % 2) // 100
    sizes = spark.range(4, 1200).withColumn("n", F.col("id").cast("int"))
    for r in sizes.select("n", windows.window_size(F.col("n")).alias("a"), windows.window_size(F.col("n"), percent=35).alias("b"), windows.trajectory_length(F.col("n")).alias("c")).collect():
        raw = even(r.n, 35)
        assert (r.a, r.b, r.c) == (min(max(8, even(r.n, 10)), r.n), max(2, raw), r.n // 3 if raw < 2 or raw > r.n / 2 else raw)


@pytest.mark.parametrize(("n", "width", "stride"), [(10, 3, 1), (10, 4, 3), (5, 5, 2), (3, 4, 1), (9, 2, 5)])
def test_sliding_is_exact(spark, n, width, stride):
    values = list(range(n))
    got = {}
    for r in windows.sliding(series(spark, values), width, stride).collect():
        got.setdefault(r.window_id, []).append(r.value)
    assert {k: sorted(v) for k, v in got.items()} == {i: [float(x) for x in range(s, s + width)] for i, s in enumerate(range(0, n - width + 1, stride))}


def test_fill_policies(spark):
    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate([None, 2.0, None, None, 8.0, None])] + [(2, 0, None)], "k int, s long, value double")
    ffill = rows.withColumn("f", quality.fill("k", "s", "value", "forward_fill")).orderBy("k", "s").collect()
    line = rows.withColumn("f", quality.fill("k", "s", "value", "interpolate_linear")).orderBy("k", "s").collect()
    assert [r.f for r in ffill] == [2, 2, 2, 2, 8, 8, 0]
    assert [r.f for r in line] == [2, 2, 4, 6, 8, 8, 0]


def test_duplicate_times(spark):
    rows = spark.createDataFrame([(1, 0, 5.0), (1, 1, 7.0), (2, 2, 1.0)], "ts int, pos int, value double")
    of = lambda p: {r.ts: r.value for r in quality.dedup_times(rows, ["ts"], F.col("pos"), "value", p).collect()}
    assert of("keep_last") == {1: 7, 2: 1} and of("mean") == {1: 6, 2: 1} and of("drop") == {2: 1}
    with pytest.raises(ValueError):
        of("other")


def test_times_as_seconds(spark):
    rows = spark.createDataFrame([("12.5",), ("2024-01-01T00:00:10",), ("rubbish",), (None,)], "x string")
    assert [r[0] for r in rows.select(quality.seconds(F.col("x"))).collect()] == [12.5, 1704067210.0, None, None]


def test_constant_series_have_no_events_of_their_own(spark):
    rows = series(spark, [4] * 40)
    assert [r.d for r in quality.robust_scale(rows).select((F.col("z")).alias("d")).collect()] == [0.0] * 40
    points = rows.select("series_id", "t", F.lit(0.0).alias("score"))
    assert one(detect.threshold(points, "mad")).threshold == 0
    spiky = series(spark, [0, 0, 9, 9, 0, 9, 0]).withColumnRenamed("value", "score")
    limit = spark.createDataFrame([(1, 5.0)], "series_id long, threshold double")
    assert sorted((r.start, r.end, r.peak_t) for r in detect.events(spiky, limit).collect()) == [(2, 3, 2), (5, 5, 5)]
    assert [(r.start, r.end) for r in detect.events(spiky, limit, 2).collect()] == [(2, 3)]


def test_folds(spark):
    rows = series(spark, range(30))
    for kind in ("holdout", "expanding", "rolling", "series_split"):
        got = forecast.folds(rows, 4, kind, most=3).collect()
        assert got and all(0 <= r.train_start < r.train_end <= r.test_start < r.test_end <= 30 for r in got)
        assert max(r.test_end for r in got) == 30
    assert forecast.folds(series(spark, range(5)), 4, "expanding").count() == 0


def test_forecasts_of_a_line(spark):
    rows = series(spark, [2 * i + 1 for i in range(40)])
    for df in (forecast.naive(rows, 3, "drift"), forecast.naive(rows, 3, "linear_trend"), forecast.lagged_ridge(rows, 3, 1e-9), forecast.ssa(rows, 3, 1.0)):
        assert [r.y for r in df.orderBy("h").collect()] == pytest.approx([81, 83, 85], rel=1e-2)
    short = series(spark, [7])
    assert [r.y for r in forecast.lagged_ridge(short, 2).collect()] == [7, 7]


def test_metric_edges(spark):
    same = spark.createDataFrame([(1, 2.0, 2.0), (1, 2.0, 3.0)], "k int, y_true double, y_pred double")
    row = one(metrics.regression(same, "k"))
    assert row.r2 == 0 and row.explained_variance == 0 and row.mae == 0.5
    labels = spark.createDataFrame([(0, 0), (0, 0)], "y_true int, y_pred int")
    assert [tuple(r) for r in metrics.per_class(labels).collect()] == [(0, 1.0, 1.0, 1.0, 2)]
    b = one(metrics.binary(labels))
    assert (b.tp, b.tn, b.precision, b.mar) == (0, 2, 0, 0)
    auc = spark.createDataFrame([("a", 1, 0.5), ("a", 0, 0.5), ("a", 1, 0.9), ("a", 0, 0.1), ("b", 1, 0.3)], "k string, y_true int, score double")
    assert {r.k: r.roc_auc for r in metrics.roc_auc(auc, "k").collect()} == {"a": 0.875, "b": 0}


def test_leaderboard_ties(spark):
    rows = spark.createDataFrame([("d", "a", 1.0), ("d", "b", 1.0), ("d", "c", 0.5)], "dataset string, model string, value double")
    assert {r.model: r["rank"] for r in leaderboard.ranked(rows, True).collect()} == {"a": 1.5, "b": 1.5, "c": 3}
    assert one(leaderboard.best_by_dataset(rows, True)).model == "a"
    assert {r.model: r.place for r in leaderboard.leaderboard(rows, True).collect()} == {"a": 1, "b": 1, "c": 2}


@pytest.mark.parametrize("metric", matrix.METRICS)
def test_distance_to_itself(spark, metric):
    row = spark.createDataFrame([([1.0, 2.0, 4.0], [1.0, 2.0, 4.0])], "a array<double>, b array<double>")
    assert one(row.select(matrix.distance(F.col("a"), F.col("b"), metric)))[0] == pytest.approx(0, abs=1e-12)


def test_numpy_operators(spark):
    wave = series(spark, [math.sin(2 * math.pi * i / 8) for i in range(64)])
    assert one(spectral.dominant_period(wave)).period == pytest.approx(8)
    assert one(spectral.singular_values(wave)).rank == 2
    rebuilt = [r.value for r in spectral.low_rank(wave, 0.999).orderBy("t").collect()]
    assert np.allclose(rebuilt, [math.sin(2 * math.pi * i / 8) for i in range(64)], atol=1e-2)
    noise = np.random.default_rng(0).normal(size=512)
    assert 0.35 < one(spectral.hurst(series(spark, noise))).hurst < 0.75
    jump = series(spark, [math.sin(i) for i in range(40)] + [math.sin(3 * i) for i in range(40)])
    scores = {r.t: r.score for r in spectral.subspace_change(jump).collect()}
    assert abs(max(scores, key=scores.get) - 40) <= 12
    for short in ([1.0], [1.0, 2.0]):
        for f in (spectral.hurst, spectral.spectrum, spectral.short_time_spectrum, spectral.singular_values, spectral.kalman, spectral.subspace_change, spectral.low_rank):
            f(series(spark, short)).collect()


def test_isolation_forest_finds_the_outlier(spark):
    rng = np.random.default_rng(1)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(300, 2)))] + [(999, 9.0, -9.0)]
    out = spectral.isolation_scores(spark.createDataFrame(rows, "i int, a double, b double"), ["a", "b"]).orderBy(F.desc("score")).first()
    assert out.i == 999


def test_isolation_forest_with_one_row_repeated(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(7)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(800, 2)))] + [(9999, 9.0, -9.0)]
    # the repeated row comes first by the hash of its values
    first = spark.createDataFrame(rows[:800], "i int, a double, b double").orderBy(F.xxhash64("a", "b")).first()
    rows += [(1000 + i, first.a, first.b) for i in range(400)]
    out = spectral.isolation_scores(spark.createDataFrame(rows, "i int, a double, b double"), ["a", "b"]).orderBy(F.desc("score")).collect()
    assert out[0].i == 9999 and out[0].score > out[-1].score + 0.2


def test_heads_and_injection(spark):
    rng = np.random.default_rng(2)
    rows = [(i, float(x), float(x > 0)) for i, x in enumerate(rng.normal(size=400))]
    table = spark.createDataFrame(rows, "i long, x double, target double")
    for head in ("logit", "dt", "rf"):
        _, out = learn.fit_predict(table, "i", ["x"], head)
        assert out.where("prediction = target").count() >= 0.9 * out.count() > 40
    noisy = learn.inject(series(spark, [0] * 30), "noise", 5, 9, 2.0)
    assert noisy.where("is_anomaly = 1").count() == 5 and noisy.where("value <> 0 and is_anomaly = 0").count() == 0
