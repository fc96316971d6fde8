"""Low-rank models, alignments, kernels, one class and filters with state against plain numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolake.operators import alignment, filters, kernels, lowrank
from chronolake.streaming import online


def panel(spark, data, targets=None):
    rows = [(i, None if v is None else [None if x is None else float(x) for x in v], None if targets is None else targets[i]) for i, v in enumerate(data)]
    return spark.createDataFrame(rows, "sample_id long, values array<double>, target long").repartition(3)


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    return rng.normal(size=(150, 5)) @ rng.normal(size=(5, 20)) * 3 + rng.normal(size=(150, 20)) / 50


def test_randomised_svd(spark, data):
    svd = lowrank.randomised_svd(panel(spark, data), 5)
    u, s, v = np.linalg.svd(data, full_matrices=False)
    assert np.allclose(svd.values, s[:5], rtol=1e-6) and np.allclose(np.abs((svd.vectors * v[:5]).sum(axis=1)), 1, atol=1e-6)
    assert svd.stable_rank == pytest.approx((data**2).sum() / s[0] ** 2)
    scores = lowrank.left_scores(panel(spark, data), svd).toPandas().pivot(index="sample_id", columns="component", values="score").to_numpy()
    assert np.allclose(scores, data @ svd.vectors.T)
    odd = panel(spark, [[1.0, None, 2.0], None, [3.0], [math.nan, 1.0, math.inf]])
    clean = np.array([[1.0, 0, 2], [3, 0, 0], [0, 1, 0]])
    assert np.allclose(lowrank.randomised_svd(odd, 3).values, np.linalg.svd(clean)[1])
    none = lowrank.randomised_svd(odd.limit(0), 3)
    assert none.values.size == 0 and none.stable_rank == 0
    assert lowrank.sketched_rank(10) == 10 and lowrank.sketched_rank(10**6) == int(4 * math.log(10**6) / (0.125 - 0.125 / 3))


def test_cur(spark, data):
    model = lowrank.cur(panel(spark, data), 12, 10)
    assert len(set(model.rows)) == 12 and len(set(model.columns)) == 10
    assert np.allclose(model.values, data[model.rows]) and np.allclose(model.middle, np.linalg.pinv(data[model.rows][:, model.columns]))
    errors = lowrank.cur_errors(panel(spark, data), model).toPandas().set_index("sample_id")
    rest = data - data[:, model.columns] @ model.middle @ data[model.rows]
    assert np.allclose(errors.loc[range(150), "error"], (rest**2).sum(axis=1)) and np.allclose(errors.loc[range(150), "norm"], (data**2).sum(axis=1))
    assert errors["error"].sum() < 1e-2 * errors["norm"].sum()
    empty = lowrank.cur(panel(spark, [[0.0, 0.0], None]), 2, 2)
    assert empty.rows == [] and empty.columns == []


def test_rows_are_drawn_by_their_norms(spark):
    heavy = panel(spark, [[10.0 if i % 10 == 0 else 1.0] for i in range(2000)])
    rows = lowrank.cur(heavy, 200, 1).rows
    assert sum(i % 10 == 0 for i in rows) > 140  # a tenth of the rows with 92 % of the weight


def plain_soft(a, b, gamma):
    r = np.full((len(a) + 1, len(b) + 1), np.inf)
    r[0, 0] = 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            x = np.array([r[i - 1, j], r[i, j - 1], r[i - 1, j - 1]])
            low = x.min()
            r[i, j] = (a[i - 1] - b[j - 1]) ** 2 + (low - gamma * math.log(np.exp(-(x - low) / gamma).sum()) if gamma else low)
    return r[-1, -1]


@pytest.mark.parametrize("gamma", [0.0, 0.1, 2.0])
def test_soft_alignment(spark, gamma):
    rng = np.random.default_rng(6)
    rows = [(i, 100 + i, rng.normal(size=int(rng.integers(1, 12))).tolist(), rng.normal(size=int(rng.integers(1, 12))).tolist()) for i in range(60)]
    odd = [(70, 1, None, [1.0]), (71, 1, [], [1.0]), (72, 1, [None, 1.0], [1.0])]
    pairs = spark.createDataFrame(rows + odd, "i long, j long, a array<double>, b array<double>")
    found = {r.i: r.distance for r in alignment.soft_dtw(pairs, gamma, 4).collect()}
    assert all(found[i] == pytest.approx(plain_soft(a, b, gamma)) for i, _, a, b in rows)
    assert 70 not in found and found[71] is None and found[72] == pytest.approx(plain_soft([0.0, 1.0], [1.0], gamma))
    if gamma:
        loss = {r.i: r.loss for r in alignment.soft_dtw_loss(pairs.where("i < 60"), gamma).collect()}
        own = lambda a, b: plain_soft(a, b, gamma) - (plain_soft(a, a, gamma) + plain_soft(b, b, gamma)) / 2
        assert all(loss[i] == pytest.approx(own(a, b)) and loss[i] >= -1e-9 for i, _, a, b in rows)


def test_shapelets(spark, data):
    rows = panel(spark, [*data.tolist(), None, [], [1.0, None, 2.0], data[0].tolist()[:5]])
    found = alignment.shapelets(rows, 6)
    assert len({i for i, _, _ in found}) == 6
    for i, start, values in found:
        assert np.allclose(values, data[i][start : start + 5])
    cells = {(r.sample_id, r.shapelet): r.distance for r in alignment.shapelet_distances(rows, [v for _, _, v in found]).collect()}
    for k, (i, _, values) in enumerate(found):
        assert cells[i, k] == pytest.approx(0, abs=1e-9) and cells[151, k] is None and cells[152, k] is None
        for j in (3, 77):
            assert cells[j, k] == pytest.approx(min(math.sqrt(((data[j][p : p + 5] - values) ** 2).mean()) for p in range(16)))
    few = alignment.shapelets(panel(spark, data[:2]), 5, 8)
    assert len(few) == 5 and len({(i, s) for i, s, _ in few}) > 2 and alignment.shapelets(rows.limit(0)) == []


def test_random_projection(spark, data):
    out = alignment.random_projection(panel(spark, data), 20, 4, 1).toPandas().pivot(index="sample_id", columns="k", values="value").to_numpy()
    assert np.allclose(out, np.tanh(data @ np.random.default_rng(1).normal(scale=1 / math.sqrt(20), size=(20, 4))))


def test_landmark_kernels_equal_whole_matrices(spark, data):
    """With every row a landmark the features give the kernels themselves."""
    x, y = data[:60] / 5, np.arange(60) % 3
    rows = panel(spark, x, y.tolist())
    ids, marks = kernels.landmarks(rows, 100)
    assert sorted(ids) == list(range(60)) and np.allclose(marks, x[ids])
    names = {"rbf": ("rbf", 0.1), "linear": ("linear", 1.0), "poly": ("poly", 0.3), "laplace": ("laplace", 0.2)}
    got = kernels.kernel_products(rows, names, marks)
    centre = np.eye(60) - 1 / 60
    whole = [centre @ kernels.kernel_block(x, x, *k) @ centre for k in names.values()] + [centre @ (y[:, None] == y[None, :]) @ centre]
    assert got.n == 60
    for a in range(5):
        for b in range(5):
            assert got.inner(a, b) == pytest.approx((whole[a] * whole[b]).sum(), rel=1e-5)
    table = kernels.kernel_weights(got, least=0.0).set_index("kernel")
    like = lambda a, b: (a * b).sum() / math.sqrt((a * a).sum() * (b * b).sum())
    assert np.allclose(table["alignment"], [like(k, whole[4]) for k in whole[:4]], rtol=1e-4)
    assert np.allclose(table["complexity"], [np.trace(k) / math.sqrt((k * k).sum()) for k in whole[:4]], rtol=1e-4)
    r = np.array([[like(a, b) if a is not b else 0.0 for b in whole[:4]] for a in whole[:4]])
    goal = lambda w: w @ (table["alignment"].to_numpy() - 0.01 * table["complexity"].to_numpy()) - 0.05 * w @ r @ w
    rng = np.random.default_rng(0)
    assert table["weight"].sum() == pytest.approx(1) and all(goal(table["weight"].to_numpy()) >= goal(w) - 1e-3 for w in rng.dirichlet(np.ones(4), 4000))
    assert kernels.kernel_products(rows.limit(0), names, marks).n == 0


def test_centred_landmark_kernel(spark, data):
    rows = panel(spark, data[:40] / 5)
    ids, marks = kernels.first_landmarks(rows, 7)
    assert ids == list(range(7))
    out = kernels.centred_landmarks(kernels.landmark_kernel(rows, ids, marks, "rbf", 0.2)).toPandas().pivot(index="i", columns="j", values="k").to_numpy()
    k = kernels.kernel_block(data[:40] / 5, marks, "rbf", 0.2)
    assert np.allclose(out, k - k.mean(axis=0) - k.mean(axis=1, keepdims=True) + k.mean())


def test_one_class(spark):
    rng = np.random.default_rng(2)
    far = rng.uniform(-14, 14, size=(60, 2))
    x = np.vstack([rng.normal(size=(480, 2)), far[np.abs(far).max(axis=1) > 5][:20]])
    points = spark.createDataFrame([(i, float(a), float(b), "k") for i, (a, b) in enumerate(x)], "n long, a double, b double, score string").repartition(4)
    model = kernels.one_class(points, ["a", "b"], 0.08, 512, 20)
    scores = kernels.one_class_scores(points.drop("score"), model).toPandas().set_index("n")["score"].loc[range(500)].to_numpy()
    assert (scores > 1e-9).mean() == pytest.approx(0.08, abs=0.02) and scores[480:].min() > np.median(scores[:480])
    assert np.mean(scores[480:] > 0) >= 0.9
    import pandas as pd

    z = model.features(pd.DataFrame(x, columns=["a", "b"]))
    assert np.allclose(scores, model.rho - z @ model.w)
    # the dual's gap: no direction that its constraints allow is much better
    low = np.sort(z @ model.w)[:40]
    assert model.w @ model.w - low.mean() <= 0.02 * (model.w @ model.w) + 1e-3
    odd = spark.createDataFrame([(1.0, None), (None, 2.0), (3.0, 3.0)], "a double, b double")
    assert kernels.one_class_scores(odd, kernels.one_class(odd, ["a", "b"], rounds=2)).where("score IS NULL").count() == 0


def series_frame(spark, series):
    rows = [(k, t, None if v is None else float(v)) for k, values in series.items() for t, v in enumerate(values)]
    return spark.createDataFrame(rows, "series_id long, t long, value double").repartition(3)


def test_unscented_is_the_linear_filter_for_linear_models(spark):
    rng = np.random.default_rng(8)
    a, q, r = np.array([[1.0, 1.0], [0.0, 0.95]]), 0.05 * np.eye(2), 2.0
    model = filters.StateModel(lambda x: x @ a.T, lambda x: x[:, 0], q, r, np.zeros(2), 10 * np.eye(2))
    series = {1: rng.normal(size=80).cumsum().tolist(), 2: [1.0, None, 2.0, None, None, 4.0], 3: [5.0] * 12, 4: [7.0]}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "9")  # state goes over batches
    try:
        out = filters.unscented(series_frame(spark, series), model).toPandas()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for k, values in series.items():
        own = out[out["series_id"] == k].sort_values("t")
        m, p = np.zeros(2), 10 * np.eye(2)
        for y, row in zip(values, own.itertuples(), strict=True):
            m, p = a @ m, a @ p @ a.T + q
            s = p[0, 0] + r
            assert row.expected == pytest.approx(m[0], abs=1e-7) and row.variance == pytest.approx(s, rel=1e-6)
            if y is not None:
                g = p[:, 0] / s
                assert row.score == pytest.approx(abs(y - m[0]) / math.sqrt(s), abs=1e-6)
                m, p = m + g * (y - m[0]), p - np.outer(g, g) * s
            assert row.level == pytest.approx(m[0], abs=1e-7)


def test_unscented_transform_of_a_square():
    """Mean and variance of a squared normal are exact with beta 2 about zero."""
    spread, means, covariances = filters.sigma_weights(1, 1.0, 2.0, 2.0)
    points = filters.sigma_points(np.zeros(1), np.eye(1) * 3, spread)
    y = points[:, 0] ** 2
    assert means @ y == pytest.approx(3) and sum(means) == pytest.approx(1)
    model = filters.damped_trend(noise=4.0)
    steep = filters.unscented_step(model, np.array([0.0, 50.0]), np.eye(2) * 1e-9, math.nan)
    assert steep[2] == pytest.approx(2.0, abs=1e-3)  # the slope saturates at the noise's deviation


def plain_online(v, order, rate, circle):
    w, out = np.full(order + 1, 0.005), []
    for i, y in enumerate(v):
        if i < order:
            out.append((math.nan, 0.0))
            continue
        x = np.r_[v[i - order : i], 1.0]
        new = w - rate * np.tanh(w @ x - y) * x
        roots = np.roots(new[::-1])
        if 0 < np.linalg.norm(roots) < circle and len(roots) == order:
            new = np.real(np.poly(roots * circle / np.linalg.norm(roots)))[::-1]
        out.append((w @ x, np.linalg.norm(new - w)))
        w = new
    return np.array(out)


def test_online_autoregression_in_batch_and_stream(spark, tmp_path):
    rng = np.random.default_rng(9)
    series = {k: (np.sin(np.arange(60 - 13 * k) / 5) + rng.normal(size=60 - 13 * k) / 9).tolist() for k in range(4)}
    model = filters.OnlineAutoregression(3, 0.05)
    batch = filters.online_autoregression(series_frame(spark, series), model).toPandas()
    for k, v in series.items():
        own = batch[batch["series_id"] == k].sort_values("t")
        assert np.allclose(own[["expected", "move"]], plain_online(np.array(v), 3, 0.05, 1.01), equal_nan=True)
    holes = filters.online_autoregression(series_frame(spark, {1: [1.0, 2.0, None, 3.0, None, 4.0]}), model).orderBy("t").collect()
    assert len(holes) == 6 and holes[4].move == 0 and all(math.isfinite(r.expected) for r in holes[3:])
    # the stream sees the same values in three files
    for part in range(3):
        rows = [(k * 1000 + t, k, t, v) for k, values in series.items() for t, v in enumerate(values) if t // 20 == part]
        frame = spark.createDataFrame(rows, "event_id long, user_id long, t long, value double").withColumn("ts", F.timestamp_seconds(F.col("t") * 60 + 1_700_000_000))
        frame.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = online.source(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
    out = online.drain(online.online_weights(stream, model), str(tmp_path / "out"), str(tmp_path / "state")).toPandas()
    both = out.assign(series_id=out["user_id"], t=out["event_id"] % 1000).merge(batch, on=["series_id", "t"])
    assert len(both) == len(batch) and np.allclose(both["move_x"], both["move_y"]) and np.allclose(both["expected_x"].astype(float), both["expected_y"], equal_nan=True)


def test_weights_far_within_the_circle_are_scaled_out():
    model = filters.OnlineAutoregression(2, 0.1)
    w = model.projected(np.array([0.001, 0.001, 5.0]))
    assert np.linalg.norm(np.roots(w[::-1])) == pytest.approx(1.01) and w[-1] == pytest.approx(1)
    same = np.array([3.0, 1.0, 1.0])
    assert (model.projected(same) == same).all()
