"""Queries without SQL against a brute-force reading in numpy, on every series of the smallest tables; and operators
whose results are known."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolake.operators import detect, forecast, leaderboard, learn, matrix, metrics, quality, rolling, spectral, synthetic
from chronolake.plans.catalogue import QUERIES
from chronolake.plans.inputs import long
from chronolake.sources import datasets, readers

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def series(spark):
    rows = long(spark, FOLDER).toPandas().sort_values(["series_id", "t"])
    return {k: g["value"].to_numpy("float64") for k, g in rows.groupby("series_id")}


def table(spark, name, order=()):
    out = QUERIES[name](spark, FOLDER).toPandas()
    return {k: g.sort_values(list(order)) if order else g for k, g in out.groupby("series_id")}


def numbers(spark, values, key=1):
    return spark.createDataFrame([(key, i, None if v is None else float(v)) for i, v in enumerate(values)], "series_id long, t long, value double")


def trajectory(v, w):
    return np.stack([v[i : i + w] for i in range(len(v) - w + 1)])


def ridge_steps(v, lag, horizon, strength):
    x = np.column_stack([trajectory(v[:-1], lag), np.ones(len(v) - lag)])
    penalty = strength * np.eye(lag + 1)
    penalty[-1, -1] = 0
    w, tail, out = np.linalg.lstsq(x.T @ x + penalty, x.T @ v[lag:], rcond=None)[0], v[-lag:], []
    for _ in range(horizon):
        out.append(tail @ w[:-1] + w[-1])
        tail = np.r_[tail[1:], out[-1]]
    return out


def averaged_back(m, n):
    total, times = np.zeros(n), np.zeros(n)
    for i, row in enumerate(m):
        total[i : i + len(row)] += row
        times[i : i + len(row)] += 1
    return total / times


def at_rank(v, share):
    m = trajectory(v, len(v) // 3)
    u, s, w = np.linalg.svd(m, full_matrices=False)
    energy = np.cumsum(s * s)
    k = int(np.searchsorted(energy, share * energy[-1])) + 1
    return averaged_back((u[:, :k] * s[:k]) @ w[:k], len(v)), s, k


def test_ridge_and_low_rank_forecasts(spark, series):
    ridge, ssa, smooth, rank = (table(spark, n, o) for n, o in (("lagged_ridge", ["h"]), ("ssa_forecast", ["h"]), ("low_rank_series", ["t"]), ("svd_rank", [])))
    for k, v in series.items():
        assert np.allclose(ridge[k]["y"], ridge_steps(v, max(2, round(0.1 * len(v))), 5, 1.0), rtol=1e-5, atol=1e-5)
        low, s, _ = at_rank(v, 0.95)
        assert np.allclose(ssa[k]["y"], ridge_steps(low, min(max(2, len(v) // 3), 12, len(v) - 2), 5, 1e-3), rtol=1e-3, atol=1e-3)
        assert np.allclose(smooth[k]["value"], at_rank(v, 0.9)[0], atol=1e-6)
        row = rank[k].iloc[0]
        assert row["rank"] == at_rank(v, 0.95)[2] and row["hard_rank"] == (s >= 2.858 * np.median(s)).sum() and row["leading"] == pytest.approx(100 * s[0] / s.sum(), rel=1e-6)


def test_spectra_and_filters(spark, series):
    power, period, frames, level, slope = (table(spark, n, o) for n, o in (("fourier_spectrum", ["bin"]), ("dominant_period", []), ("stft", ["frame", "bin"]), ("kalman", ["t"]), ("hurst", [])))
    for k, v in series.items():
        n, e = len(v), v - v.mean()
        true = [abs(sum(e[t] * np.exp(-2j * math.pi * t * b / n) for t in range(n))) ** 2 / n for b in range(n // 2 + 1)]
        assert np.allclose(power[k]["power"], true, atol=1e-6)
        assert period[k]["period"].iloc[0] == pytest.approx(n / (1 + int(np.argmax(true[1:]))))
        padded = np.r_[v[8:0:-1], v, v[-2:-10:-1]]
        window = [0.5 - 0.5 * math.cos(2 * math.pi * i / 16) for i in range(16)]
        own = [abs(sum(padded[a + t] * window[t] * np.exp(-2j * math.pi * t * b / 16) for t in range(16))) ** 2 for a in range(0, len(padded) - 15, 8) for b in range(9)]
        assert np.allclose(frames[k]["power"], own, atol=1e-6)
        x, p, levels = v[0], 1.0, []
        for y in v:
            p += 0.01
            g = p / (p + 1)
            x, p = x + g * (y - x), p * (1 - g)
            levels.append(x)
        assert np.allclose(level[k]["level"], levels)
        points = []
        for i in range(2, n + 1):
            part, s = v[:i], v[:i].std()
            spread = np.ptp(np.cumsum(part) - part.mean() * np.arange(1, i + 1))
            if s > 1e-12 and spread > 1e-12:
                points.append((math.log(i), math.log(spread / s)))
        assert slope[k]["hurst"].iloc[0] == pytest.approx(np.polyfit(*zip(*points, strict=True), 1)[0] if len(points) > 1 else 0, abs=1e-6)


def test_kernels_and_changes(spark, series):
    shares, change = table(spark, "kernel_features", ["dilation", "kernel"]), table(spark, "sst", ["t"])
    from itertools import combinations

    for k, v in list(series.items())[:3]:
        true = []
        for d in (1, 2, 4):
            if len(v) > 8 * d:
                for taps in combinations(range(9), 3):
                    y = np.array([sum((2 if j in taps else -1) * v[t + d * j] for j in range(9)) for t in range(len(v) - 8 * d)])
                    true.append((y > np.median(y)).mean())
        assert np.allclose(shares[k]["ppv"], true, atol=0.02)  # ties with the median depend on the order of sums
        for t in range(12, len(v) - 11):
            past = np.linalg.svd(trajectory(v[t - 12 : t], 6).T, full_matrices=False)[0][:, :2]
            coming = np.linalg.svd(trajectory(v[t : t + 12], 6).T, full_matrices=False)[0][:, 0]
            assert change[k]["score"].iloc[t] == pytest.approx(max(0, 1 - ((past.T @ coming) ** 2).sum()), abs=1e-6)


def forced_steps(v, w, h, share=0.99, decay=0.85):
    m = trajectory(v, w)
    _, s, vt = np.linalg.svd(m, full_matrices=False)
    energy = np.cumsum(s * s)
    k = max(2, int(np.searchsorted(energy, share * energy[-1])) + 1)
    z = m @ vt[:k].T
    ones = np.ones((len(z) - 1, 1))
    move, force = np.linalg.lstsq(np.hstack([z[:-1], ones]), z[1:, :-1], rcond=None)[0], np.linalg.lstsq(np.hstack([z[:-1, -1:], ones]), z[1:, -1], rcond=None)[0]
    state, out = z[-1], []
    for _ in range(h):
        state = np.r_[np.r_[state, 1.0] @ move, decay * (force[0] * state[-1] + force[1])]
        out.append((state @ vt[:k])[-1])
    return out


def test_operators_of_motion(spark, series):
    wave = [math.sin(2 * math.pi * i / 12) for i in range(120)]
    for f in (forecast.low_rank_ridge, forecast.autoregression):
        got = [r.y for r in f(numbers(spark, wave), 4).orderBy("h").collect()]
        assert np.allclose(got, [math.sin(2 * math.pi * i / 12) for i in range(120, 124)], atol=0.25), f.__name__
    forced = table(spark, "forced_operator", ["h"])
    for k, v in series.items():
        assert np.allclose(forced[k]["y"], forced_steps(v, min(max(7, round(0.15 * len(v))), len(v) - 1), 5), rtol=1e-4, atol=1e-3)
    modes = spectral.dynamic_modes(numbers(spark, wave)).where("growth > 0.5").collect()
    assert {round(abs(m.frequency), 4) for m in modes} == {round(1 / 12, 4)} and all(abs(m.growth - 1) < 1e-6 for m in modes)
    for short in ([1.0], [1.0, 2.0, 3.0]):
        for f in (forecast.forced_operator, forecast.low_rank_ridge, forecast.autoregression):
            assert f(numbers(spark, short), 2).count() == 2
        spectral.dynamic_modes(numbers(spark, short)).collect()


def test_rolling_by_hand(spark):
    rows = numbers(spark, [1, 3, 2, 6, 4, 9, 5])
    out = rolling.rolling_forecasts(rows, 2, "mean", 2, refit="always").orderBy("step", "h").collect()
    assert [(r.train_end, r.h, r.y_true, round(r.y_pred, 6)) for r in out] == [(2, 1, 2, 2), (2, 2, 6, 2), (4, 1, 4, 3), (4, 2, 9, 3), (6, 1, 5, round(25 / 6, 6))]
    never = rolling.rolling_forecasts(rows, 2, "last", 2, refit="never").collect()
    assert {r.y_pred for r in never} == {3.0} and sum(r.refit for r in never) == 2
    short = rolling.rolling_forecasts(rows, 2, "drift", 2, context=3).orderBy("step", "h").collect()
    assert (short[0].train_end, short[0].y_pred, short[1].y_pred) == (3, 2.5, 3.0)
    drift = rolling.rolling_forecasts(rows, 2, "last", 2, refit="drift", drift=2.5).orderBy("step", "h").collect()
    # errors of the steps: (1 + 3) / 2, then (1 + 6) / 2 with the first fit, so that the third fits anew
    assert [(r.step, r.refit, r.y_pred) for r in drift] == [(0, True, 3), (0, True, 3), (1, False, 3), (1, False, 3), (2, True, 9)]
    z = 1.6448536269514722
    got = {(r.step, r.h): (r.low, r.high, r.enough) for r in rolling.intervals(rolling.rolling_forecasts(rows, 2, "mean", 2), least=2).collect()}
    assert got[0, 1][:2] == pytest.approx((2 - z * 1e-6, 2 + z * 1e-6)) and not got[0, 1][2]
    assert got[1, 1] == (pytest.approx(3 - z * 2), pytest.approx(3 + z * 2), True)  # residuals 0 and 4
    assert rolling.rolling_forecasts(numbers(spark, [1, 2]), 2, "last").count() == 0


def test_detection_score_by_hand(spark):
    truth = spark.createDataFrame([(1, 10), (1, 30)], "series_id long, t long")
    hits = spark.createDataFrame([(1, 10), (1, 12), (1, 25)], "series_id long, t long")
    # a hit at the start earns 1, a false alarm costs 0.11, a miss 1; null is -2, perfect 2
    assert metrics.nab_score(truth, hits, 8).first().score == pytest.approx(100 * (1 - 0.11 - 1 + 2) / 4)
    late = spark.createDataFrame([(1, 18), (1, 34)], "series_id long, t long")
    middle = (1 + 0.22) / 2 * (1 - math.tanh(math.pi * 499 / 999 - math.pi / 2) / math.tanh(math.pi / 2)) - 0.22
    assert metrics.nab_score(truth, late, 8, "low_fp").first().score == pytest.approx(100 * (-0.22 + middle + 2) / 4)
    assert metrics.nab_score(truth, hits.where("t = 12"), 0).first().score == pytest.approx(100 * -0.11 / 4)


def test_grid_by_hand(spark):
    rows = spark.createDataFrame([(1, 0, 0.0, 5.0), (1, 1, 10.0, 6.0), (1, 2, 14.0, 7.0), (1, 3, 24.0, 8.0), (1, 4, 45.0, None)], "series_id long, t long, s double, value double")
    rows = rows.withColumn("ts", F.timestamp_seconds("s"))
    # steps 10, 4, 10, 21: the median is 10; 14 is nearest to slot 1, where it comes last; 45 is half way: slot 4
    got = [(r.slot, r.second, r.value, r.is_gap) for r in quality.regular_grid(rows).orderBy("slot").collect()]
    assert got == [(0, 0, 5, False), (1, 10, 7, False), (2, 20, 8, False), (3, 30, None, True), (4, 40, None, True)]
    filled = [(r.value, r.is_gap) for r in quality.regular_grid(rows, "forward_fill").orderBy("slot").collect()]
    assert filled == [(5, False), (7, False), (8, False), (8, True), (8, False)]
    assert quality.regular_grid(rows.limit(1)).collect()[0].slot == 0


def test_front_of_two_and_three_costs(spark):
    rng = np.random.default_rng(3)
    cells = rng.integers(0, 30, (400, 3)).astype(float)
    rows = [(i, *map(float, c)) for i, c in enumerate(cells)] + [(900, None, 1.0, 1.0), (901, *map(float, cells[0]))]
    df = spark.createDataFrame(rows, "k long, a double, b double, c double").repartition(4)
    for costs in (["a", "b"], ["a", "b", "c"]):
        at = {"a": 1, "b": 2, "c": 3}
        of = lambda r, costs=costs: np.array([r[at[c]] for c in costs])
        good = [r for r in rows if r[1] is not None]
        true = {r[0] for r in good if not any((of(o) <= of(r)).all() and (of(o) < of(r)).any() for o in good)}
        assert {r.k for r in metrics.pareto(df, "k", costs).collect()} == true


def test_pairwise_learning(spark):
    rng = np.random.default_rng(5)
    rows = [(i, i % 3, [float(x) for x in rng.normal(size=4) * 0.3 + (i % 3) * 2]) for i in range(150)]
    panel = spark.createDataFrame(rows, "sample_id long, target int, values array<double>")
    train, rest = panel.where("sample_id < 100"), panel.where("sample_id >= 100")
    out = learn.pairwise_classes(train, rest.select("sample_id", "values"), 3, trees=10)
    best = {r.sample_id: r["class"] for r in out.groupBy("sample_id").agg(F.max_by("class", "probability").alias("class")).collect()}
    assert sum(best[i] == i % 3 for i in best) >= 0.95 * len(best) == 0.95 * 50
    assert all(abs(r.s - 1) < 1e-9 for r in out.groupBy("sample_id").agg(F.sum("probability").alias("s")).collect())
    assert {r.target: r["count"] for r in learn.class_anchors(train, 3).groupBy("target").count().collect()} == {0: 3, 1: 3, 2: 3}
    pairs = matrix.anchored_pairs(panel, learn.class_anchors(panel, 2))
    assert pairs.count() == 6 * 149 and pairs.select("i", "j").distinct().count() == 6 * 149
    one = learn.pair_features(pairs.where("i <> j").limit(1), "concat_diff").first()
    assert one.features == [*one.b, *one.a, *(x - y for x, y in zip(one.b, one.a, strict=True))]
    values = panel.withColumn("target", F.get("values", F.lit(0)) * 2)
    got = learn.pairwise_values(values.where("sample_id < 100"), values.where("sample_id >= 100").select("sample_id", "values"), values.where("sample_id < 10"), trees=20).join(values, "sample_id")
    assert got.agg(F.corr("y", "target")).first()[0] > 0.9


def test_kernels_and_domains(spark):
    assert matrix.simplex_weights({"a": 0.9, "b": 0.5, "c": -2.0}) == pytest.approx({"a": 0.7, "b": 0.3, "c": 0.0})
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(300, 2)) @ np.array([[2, 1], [0, 0.5]]) + 4, rng.normal(size=(200, 2)) * [3, 0.2] - 1
    source, target = (spark.createDataFrame([tuple(map(float, r)) for r in m], "a double, b double") for m in (x, y))
    moved = detect.align(source, target, ["a", "b"]).toPandas().to_numpy()
    assert np.allclose(moved.mean(axis=0), y.mean(axis=0), atol=1e-6) and np.allclose(np.cov(moved.T), np.cov(y.T), atol=1e-3)
    rows = [(i, c, [float(v) for v in m]) for i in range(30) for c, m in enumerate(rng.normal(size=(3, 40)) * (1 + 4 * (i % 2)))]
    panel = spark.createDataFrame(rows, "sample_id long, channel int, values array<double>")
    logs = matrix.log_covariances(panel, 0.0)
    own = {r.sample_id: np.array(r.v) for r in logs.collect()}
    data = {i: np.array([m for j, _, m in rows if j == i]) for i in own}
    for i, v in own.items():
        values, vectors = np.linalg.eigh(np.cov(data[i], bias=True))
        m = (vectors * np.log(values)) @ vectors.T
        assert np.allclose(v, [m[a, b] * (1 if a == b else math.sqrt(2)) for a in range(3) for b in range(a, 3)], atol=1e-8)
    told = matrix.tangent_features(logs, spark.createDataFrame([(i, i % 2) for i in own], "sample_id long, target int"))
    assert all(r.label == r.sample_id % 2 for r in told.collect())


def test_synthetic_series(spark):
    walk = synthetic.make(spark, "random_walk", 20, 400, seed=3)
    again = synthetic.make(spark, "random_walk", 20, 400, seed=3).repartition(7)
    assert walk.exceptAll(again).count() == 0
    steps = quality.differences(walk).where("t > 0").agg(F.avg("diff").alias("m"), F.stddev("diff").alias("s")).first()
    assert abs(steps.m) < 0.05 and abs(steps.s - 1) < 0.05
    auto = synthetic.make(spark, "auto_regression", 10, 800, order=(0.8,))
    lagged = auto.join(auto.select("series_id", (F.col("t") + 1).alias("t"), F.col("value").alias("p")), ["series_id", "t"])
    assert abs(lagged.agg(F.corr("value", "p")).first()[0] - 0.8) < 0.05
    wave = synthetic.make(spark, "sin", 3, 48, size=2.0)
    assert wave.agg(F.max("value")).first()[0] <= 2.0 and synthetic.labelled(spark, ["sin", "smooth_normal"], 3, 20).groupBy("target").count().count() == 2


def test_boards(spark):
    rows = spark.createDataFrame([("d", "own", 1.0), ("d", "a", 2.0), ("e", "own", 3.0), ("e", "a", 1.0)], "dataset string, model string, value double")
    assert {r.dataset: (r.difference, r.outcome) for r in leaderboard.wins(rows, "own").collect()} == {"d": (1.0, "win"), "e": (-2.0, "loss")}
    assert leaderboard.sampled(rows, "dataset", 1).count() == 2
    assert [r.item for r in leaderboard.exploded(spark.createDataFrame([(1, "a, b,,c ")], "k int, cell string"), "k", "cell").collect()] == ["a", "b", "c"]


def test_data_sets(spark, tmp_path):
    for part, text in (("TRAIN", "1\t0.5\t2\n1\t0.5\t2\n2\t1\t1\n"), ("TEST", "2\t3\t4\n")):
        (tmp_path / f"Toy_{part}.tsv").write_text(text)
    train, test = datasets.load(spark, str(tmp_path), "Toy", shuffle=1)
    assert train.select("sample_id").distinct().count() == 3 and test.first().label == 2.0
    assert datasets.probe(spark, str(tmp_path), "Toy") == "tsv"
    with pytest.raises(FileNotFoundError):
        datasets.load(spark, str(tmp_path), "Other")
    schema = "dataset string, model string, status string, value string"
    assert datasets.records_or_aggregate(spark, str(tmp_path), "metrics", schema).count() == 0
    (tmp_path / "aggregate").mkdir()
    (tmp_path / "aggregate" / "metrics.csv").write_text("dataset,model,status,value\nd,m,success,0.5\n")
    assert datasets.records_or_aggregate(spark, str(tmp_path), "metrics", schema).count() == 1
    (tmp_path / "runs" / "a").mkdir(parents=True)
    (tmp_path / "runs" / "a" / "metrics.jsonl").write_text('{"dataset": "d", "status": "success", "value": "1.5"}\n\n{"dataset": "e", "status": "failed", "value": "2"}\n')
    assert [r.value for r in datasets.metric_records(spark, str(tmp_path / "runs"), schema).collect()] == [1.5]
    (tmp_path / "history" / "3").mkdir(parents=True)
    (tmp_path / "history" / "3" / "x.json").write_text('{"uid": "u", "fitness": 0.5, "operations": ["a", "b"]}')
    assert tuple(datasets.composition_history(spark, str(tmp_path / "history")).first()) == (3, "u", 0.5, "a,b")
    manifest = datasets.save_results(str(tmp_path / "out"), {"metrics": spark.range(2)})
    assert manifest.first().name == "metrics" and spark.read.parquet(str(tmp_path / "out" / "metrics")).count() == 2
    assert datasets.markdown(spark.range(1)) == "| id |\n| - |\n| 0 |" and datasets.latex(spark.range(1)).startswith("\\begin{tabular}{l}\nid \\\\")
    assert readers.exists(spark, str(tmp_path)) and not readers.exists(spark, str(tmp_path / "none"))
