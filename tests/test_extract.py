"""Feature tables, reductions, normalisers and metrics against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolake.operators import extract, learn


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(80, 3)) @ rng.normal(size=(3, 6)) + rng.normal(size=(80, 6)) / 30
    x[:, 5] = 7.0  # constant
    return x, spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "n long, " + ", ".join(f"a{i} double" for i in range(6))).repartition(3)


def scaled(x):
    s = x.std(axis=0, ddof=1)
    return (x - x.mean(axis=0)) / np.where(s == 0, 1, s) * (s > 0)


def test_reduction_equals_svd(table):
    x, rows = table
    model = extract.reduction(rows, "n", 0.9)
    z = scaled(x)
    s, v = np.linalg.svd(z, full_matrices=False)[1:]
    ratios = s * s / (s * s).sum()
    k = int(np.searchsorted(np.cumsum(ratios), 0.9)) + 1
    assert model.vectors.shape == (6, k) and np.allclose(model.ratios, ratios[:k])
    out = model.transform(rows.select("n", *[f"a{i}" for i in (5, 3, 1, 0, 2, 4)], F.lit(1).alias("more"))).toPandas().sort_values("n")
    mine = out[[f"c{i}" for i in range(k)]].to_numpy()
    assert np.allclose(np.abs(mine), np.abs(z @ v[:k].T), atol=1e-6)
    short = model.transform(rows.drop("a2")).toPandas().sort_values("n")  # a column that is missing is 0
    y = x.copy()
    y[:, 2] = 0
    moved = (y - x.mean(axis=0)) / np.where(x.std(axis=0, ddof=1) == 0, 1, x.std(axis=0, ddof=1)) * (x.std(axis=0) > 0)
    assert np.allclose(short[[f"c{i}" for i in range(k)]].to_numpy(), moved @ model.vectors, atol=1e-6)


def test_choice_and_discriminative_columns(spark, table):
    x, rows = table
    rng = np.random.default_rng(2)
    noise = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rng.normal(size=(80, 40)))], "n long, " + ", ".join(f"b{i} double" for i in range(40)))
    name, found = extract.best_table({"noise": noise, "low": rows}, "n")
    assert name == "low" and all((m.ratios > 0.05).all() for m in found.values())
    model = found["low"]
    scores = scaled(x) @ model.vectors
    true = {(i, f"a{c}") for i in range(scores.shape[1]) for c in range(5) if abs(np.corrcoef(scores[:, i], x[:, c])[0, 1]) > 0.8}
    assert {(r.component, r.column) for r in extract.discriminative(rows, model).collect()} == true and true


def test_generators_by_name_and_function(spark):
    rows = spark.createDataFrame([(1, 0, 1.0), (1, 1, 3.0), (2, 0, 5.0)], "series_id long, t long, value double")
    extract.register_generator("size", lambda r: r.groupBy("series_id").agg(F.count("*").alias("n")))

    def only_long(r):
        return r.groupBy("series_id").agg(F.count("*").alias("n")).where("n > 1")

    out = {r.series_id: r.asDict() for r in extract.feature_table(rows, ["size", only_long, only_long]).collect()}
    assert out[1] == {"series_id": 1, "size_n": 2.0, "only_long_n": 2.0, "only_long2_n": 2.0} and out[2]["only_long_n"] == 0
    with pytest.raises(ValueError, match="unknown generator"):
        extract.feature_table(rows, ["nothing"])
    extract.register_metric("worst", lambda y, p: F.max(F.abs(y - p)))
    found = extract.evaluated(rows, "value", "t", ["worst", "bias"]).first()
    assert found.worst == 5 and found.bias == pytest.approx((1 - 9) / 3)
    assert extract.evaluated(rows.limit(0), "value", "t", ["mae"]).first().mae is None


def test_normaliser_is_fitted_on_training_rows_alone(spark):
    rng = np.random.default_rng(3)
    x = rng.exponential(size=(50, 2)) * [1, 9]
    rows = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)] + [(50, None, -1.0)], "n long, a double, b double")
    fitted = extract.normaliser(rows.where("n < 30"), {"x": (["a"], ["log1p", "standard"]), "y": (["b"], ["robust"])})
    out = fitted.transform(rows).toPandas().sort_values("n")
    low = np.log1p(x[:, 0])
    assert np.allclose(out["a"][:50], (low - low[:30].mean()) / low[:30].std()) and np.isnan(out["a"].iloc[50])
    q = np.quantile(x[:30, 1], [0.25, 0.5, 0.75])
    assert np.allclose(out["b"][:50], (x[:, 1] - q[1]) / (q[2] - q[0]))
    empty = extract.normaliser(rows.limit(0), {"x": (["a"], ["standard"])}).transform(rows).first()
    assert empty.a == pytest.approx(x[0, 0] / 1e-6)


def test_greedy_ensemble(spark):
    rng = np.random.default_rng(4)
    y = rng.integers(0, 3, 300)
    scores = {m: np.maximum(0.01, rng.random((300, 3)) + w * np.eye(3)[y]) for m, w in (("a", 0.5), ("b", 0.45), ("c", 0.4), ("d", 0.0))}
    rows = spark.createDataFrame([(i, m, k, float(s[i, k])) for m, s in scores.items() for i in range(300) for k in range(3)], "sample_id long, model string, class long, score double")
    targets = spark.createDataFrame([(i, int(t)) for i, t in enumerate(y)], "sample_id long, target long")
    got = [(r.step, r.models, r.accuracy) for r in learn.greedy_ensemble(rows, targets).orderBy("step").collect()]
    how = {"mean": np.mean, "median": np.median, "min": np.min, "max": np.max, "product": np.prod}
    right = lambda s: float((s.argmax(axis=1) == y).mean())
    order = sorted(scores, key=lambda m: (-right(scores[m]), m))
    true = [(1, order[:1], right(scores[order[0]]))]
    for k in range(2, 5):
        best = max(right(f(np.stack([scores[m] for m in order[:k]]), axis=0)) for f in how.values())
        if best > true[-1][2]:
            true.append((k, order[:k], best))
    assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in true] and np.allclose([c for *_, c in got], [c for *_, c in true])
