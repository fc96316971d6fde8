"""Parametric spectra, wavelets, chunks and scans against plain numpy; nulls, short and constant series."""

import math

import numpy as np
import pytest

from chronolake.operators import chunks, spectra, wavelets


def frame(spark, series):
    rows = [(k, t, None if v is None else float(v), "x") for k, values in series.items() for t, v in enumerate(values)]
    return spark.createDataFrame(rows, "series_id long, t long, value double, n string").repartition(3)


@pytest.fixture(scope="module")
def series():
    rng = np.random.default_rng(4)
    out = {k: rng.normal(size=n).cumsum() for k, n in enumerate((200, 57, 12, 7))}
    noise = rng.normal(size=8000)
    made = np.zeros(8000)
    for t in range(8000):
        made[t] = 0.6 * made[t - 1] - 0.3 * made[t - 2] + noise[t] + 0.4 * noise[t - 1]
    return {**out, 10: np.full(30, 4.0), 11: [1.0], 12: [2.0, 5.0], 20: made}


def covariances(v, most):
    e = np.asarray(v, "float64") - np.mean(v)
    return np.array([(e[k:] * e[: max(0, len(e) - k)]).sum() / len(e) for k in range(most + 1)])


def test_yule_walker_solves_the_equations(spark, series):
    for r in spectra.yule_walker(frame(spark, series), 4).collect():
        c, p = covariances(series[r.series_id], 4), min(4, len(series[r.series_id]) - 1)
        if c[0] == 0:
            assert r.noise == 0 and r.a == [0.0] * 4
            continue
        a = np.linalg.solve(c[np.abs(np.subtract.outer(range(p), range(p)))], c[1 : p + 1])
        assert np.allclose(r.a[:p], a) and r.a[p:] == [0.0] * (4 - p)
        assert r.noise == pytest.approx(c[0] - a @ c[1 : p + 1])


def plain_burg(v, order):
    f = b = np.asarray(v, "float64") - np.mean(v)
    a, e = np.empty(0), (f * f).mean()
    for m in range(order):
        f, b = f[1:], b[:-1]
        down = (f * f + b * b).sum() if e > 1e-12 else 0
        k = 2 * (f * b).sum() / down if down > 0 else 0.0
        a, e = np.r_[a - k * a[::-1], k], e * (1 - k * k)
        f, b = f - k * b, b - k * f
    return e, a


def test_burg_equals_the_recursion(spark, series):
    for r in spectra.burg(frame(spark, series), 6).collect():
        e, a = plain_burg(series[r.series_id], 6)
        assert np.allclose(r.a, a, atol=1e-8) and r.noise == pytest.approx(e, abs=1e-9)


def test_arma_finds_its_coefficients(spark, series):
    found = {r.series_id: r for r in spectra.arma(frame(spark, series), 2, 1, 12).collect()}
    assert np.allclose(found[20].a, [0.6, -0.3], atol=0.12) and found[20].b[0] == pytest.approx(0.4, abs=0.15) and found[20].noise == pytest.approx(1, abs=0.15)
    assert found[10].a == [0, 0] and found[11].b == [0]
    # the first part by brute force
    c = covariances(series[0], 15)
    x = np.array([[c[abs(k - i)] for i in (1, 2)] for k in range(2, 14)])
    assert np.allclose(found[0].a, np.linalg.lstsq(x, c[2:14], rcond=None)[0])


def test_power_is_the_response(spark, series):
    models = spectra.arma(frame(spark, {20: series[20]}), 2, 1)
    m = models.first()
    for r in spectra.model_power(models, 8).collect():
        z = np.exp(-2j * np.pi * r.frequency * np.arange(1, 3))
        assert r.power == pytest.approx(m.noise * abs(1 + m.b[0] * z[0]) ** 2 / abs(1 - np.dot(m.a, z)) ** 2) and r.frequency == r.bin / 16
    total = spectra.power_summary(spectra.model_power(models, 2048)).first()
    assert total["mean"] == pytest.approx(np.var(series[20]), rel=0.15)  # the spectrum's mean is the variance


def test_nulls_are_no_values(spark):
    v = [1.0, None, 3.0, 2.0, None, 5.0, 4.0]
    rows = frame(spark, {1: v, 2: [None, None]})
    mean = 3.0
    e = [None if x is None else x - mean for x in v]
    c1 = sum(a * b for a, b in zip(e[1:], e, strict=False) if a is not None and b is not None) / 5
    found = {r.series_id: r for r in spectra.autocovariances(rows, 1).collect()}
    assert found[1].n == 5 and found[1].c == pytest.approx([2.0, c1]) and found[2].c == [0, 0]
    assert spectra.yule_walker(rows, 2).where("series_id = 2").first().a == [0, 0]


def test_daubechies_filters():
    assert wavelets.daubechies(1) == pytest.approx([1 / math.sqrt(2)] * 2)
    root = math.sqrt(3)
    assert wavelets.daubechies(2) == pytest.approx([(1 + root) / (4 * math.sqrt(2)), (3 + root) / (4 * math.sqrt(2)), (3 - root) / (4 * math.sqrt(2)), (1 - root) / (4 * math.sqrt(2))])
    for n in range(1, 9):
        h = np.array(wavelets.daubechies(n))
        g = h[::-1] * (-1.0) ** np.arange(2 * n)
        assert [h[: 2 * n - 2 * k] @ h[2 * k :] for k in range(n)] == pytest.approx([1.0] + [0.0] * (n - 1), abs=1e-7)
        assert [(np.arange(2 * n) ** k) @ g for k in range(min(n, 3))] == pytest.approx([0.0] * min(n, 3), abs=1e-5)


def plain_level(v, low):
    n_taps, v = len(low), np.asarray(v, "float64")
    s = np.arange(1, n_taps + 1)
    on, back = (v[1] - v[0], v[-1] - v[-2]) if len(v) > 1 else (0.0, 0.0)
    x = np.r_[(v[0] - s * on)[::-1], v, v[-1] + s * back]
    pick = lambda taps: [sum(taps[j] * x[n_taps + 2 * k + 1 - j] for j in range(n_taps)) for k in range((len(v) + n_taps - 1) // 2)]
    return pick(low[::-1]), pick([(-1) ** (i + 1) * c for i, c in enumerate(low)])


@pytest.mark.parametrize("moments", [1, 2, 4])
def test_filter_bank(spark, series, moments):
    low = wavelets.daubechies(moments)
    out = wavelets.filtered(frame(spark, series), low).toPandas().sort_values("t")
    for k, v in series.items():
        own = out[out["series_id"] == k]
        a, d = plain_level(v, low)
        assert own["t"].tolist() == list(range(len(a))) and np.allclose(own["approximation"], a) and np.allclose(own["detail"], d)
    if moments > 1:  # a line has no detail
        line = wavelets.filtered(frame(spark, {1: np.arange(40)}), low).toPandas()
        assert np.allclose(line["detail"], 0, atol=1e-7)


def test_continuous_transform_by_chunks(spark, series):
    rows = frame(spark, {k: v for k, v in series.items() if k < 12})
    whole = wavelets.continuous(rows, "mexh", (2, 10)).toPandas().sort_values(["series_id", "scale", "t"])
    small = wavelets.continuous(rows, "mexh", (2, 10), 16).toPandas().sort_values(["series_id", "scale", "t"])
    assert np.allclose(whole.to_numpy("float64"), small.to_numpy("float64"))
    psi = lambda x: (1 - x * x) * np.exp(-x * x / 2) * 2 / (math.sqrt(3) * math.pi**0.25)
    v = np.asarray(series[0])
    own = whole[(whole["series_id"] == 0) & (whole["scale"] == 10)]["value"].to_numpy()
    direct = [sum(x * psi((s - t) / 10) for s, x in enumerate(v)) / math.sqrt(10) for t in range(len(v))]
    assert np.corrcoef(own, direct)[0, 1] > 0.995 and np.allclose(own, direct, atol=0.1 * np.abs(direct).max())
    assert wavelets.continuous(rows.limit(0)).count() == 0


def test_scans_go_on_across_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rng = np.random.default_rng(1)
        series = {k: rng.normal(size=int(rng.integers(1, 40))) for k in range(12)}
        out = chunks.scanned(frame(spark, series), lambda: 0.0, lambda s, v: (s + v.sum(), {"total": s + np.cumsum(v)}), "total double").toPandas()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for k, v in series.items():
        assert np.allclose(out[out["series_id"] == k].sort_values("t")["total"], np.cumsum(v))
