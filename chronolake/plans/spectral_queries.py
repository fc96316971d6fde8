"""Queries over parametric spectra and wavelets; their SQL unrolls the recursions."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from chronolake.operators import components, spectra, wavelets
from chronolake.plans.inputs import LONG, long, query

ORDER, BINS = 5, 16
MEAN = f"{LONG}, EM AS (SELECT series_id, t, value - avg(value) OVER (PARTITION BY series_id) AS e FROM L)"


def _names(m: int) -> str:
    return ", ".join(f"a{i}" for i in range(1, m + 1))


def _grown(m: int, k: str) -> str:
    """Coefficients of order m from those of order m - 1 and their reflection: a[i] - k * a[m - i], and k."""
    return ", ".join([*[f"a{i} - {k} * a{m - i} AS a{i}" for i in range(1, m)], f"{k} AS a{m}"])


def _levinson() -> str:
    lagged = ", ".join(f"lag(e, {k}) OVER w AS e{k}" for k in range(1, ORDER + 1))
    sums = ", ".join(f"coalesce(sum(e * e{k}), 0) / count(*) AS c{k}" for k in range(1, ORDER + 1))
    steps = [f"{MEAN}, EL AS (SELECT series_id, e, {lagged} FROM EM WINDOW w AS (PARTITION BY series_id ORDER BY t)), AC AS (SELECT series_id, count(*) AS n, sum(e * e) / count(*) AS c0, {sums} FROM EL GROUP BY 1), Y0 AS (SELECT *, c0 AS noise FROM AC)"]
    for m in range(1, ORDER + 1):
        rest = " - ".join([f"c{m}", *[f"a{i} * c{m - i}" for i in range(1, m)]])
        steps.append(
            f"K{m} AS (SELECT *, CASE WHEN noise > 1e-12 * c0 AND n > {m} THEN ({rest}) / noise ELSE 0 END AS k FROM Y{m - 1}), "
            f"Y{m} AS (SELECT series_id, n, {', '.join(f'c{i}' for i in range(ORDER + 1))}, noise * (1 - k * k) AS noise, {_grown(m, 'k')} FROM K{m})"
        )
    return ", ".join(steps) + f", AR AS (SELECT series_id, n, noise, {_names(ORDER)} FROM Y{ORDER})"


def _burg() -> str:
    steps = [f"{MEAN}, B0 AS (SELECT series_id, t, e AS f, e AS b FROM EM), Z0 AS (SELECT series_id, count(*) AS n, sum(e * e) / count(*) AS noise, sum(e * e) / count(*) AS c0 FROM EM GROUP BY 1)"]
    for m in range(1, ORDER + 1):
        steps.append(
            f"G{m} AS (SELECT series_id, t, f, lag(b) OVER (PARTITION BY series_id ORDER BY t) AS b FROM B{m - 1}), "
            f"R{m} AS (SELECT series_id, 2 * sum(f * b) / nullif(sum(f * f + b * b), 0) AS k FROM G{m} WHERE t >= {m} GROUP BY 1), "
            f"Q{m} AS (SELECT Z{m - 1}.*, CASE WHEN noise > 1e-12 * c0 THEN coalesce(k, 0) ELSE 0 END AS k FROM Z{m - 1} LEFT JOIN R{m} USING (series_id)), "
            f"B{m} AS (SELECT series_id, t, f - k * b AS f, b - k * f AS b FROM G{m} JOIN Q{m} USING (series_id) WHERE t >= {m}), "
            f"Z{m} AS (SELECT series_id, n, c0, noise * (1 - k * k) AS noise, {_grown(m, 'k')} FROM Q{m})"
        )
    return ", ".join(steps) + f", AR AS (SELECT series_id, n, noise, {_names(ORDER)} FROM Z{ORDER})"


def _power() -> str:
    turn = [" + ".join(f"a{i} * {f}({i} * w)" for i in range(1, ORDER + 1)) for f in ("cos", "sin")]
    return (
        f"BN AS (SELECT AR.*, bin, bin / {2.0 * BINS} AS frequency, {2 * math.pi!r} * bin / {2.0 * BINS} AS w FROM AR, (SELECT unnest(range(0, {BINS})) AS bin)), "
        f"PW AS (SELECT series_id, bin, frequency, noise / greatest(power(1 - ({turn[0]}), 2) + power({turn[1]}, 2), 1e-300) AS power FROM BN)"
    )


def _power_of(s, d, model):
    return spectra.model_power(model(long(s, d), ORDER), BINS)


for name, model, sql in (("yule_walker", spectra.yule_walker, _levinson()), ("burg", spectra.burg, _burg())):
    query(f"{name}_model", lambda s, d, m=model: m(long(s, d), ORDER).select("series_id", "n", "noise", *[F.get("a", F.lit(i - 1)).alias(f"a{i}") for i in range(1, ORDER + 1)]), f"{sql} ||| SELECT * FROM AR", "noise " + _names(ORDER).replace(",", ""))
    query(f"{name}_spectrum", lambda s, d, m=model: _power_of(s, d, m), f"{sql}, {_power()} ||| SELECT * FROM PW", "frequency power", 4)
query("arma_spectrum", lambda s, d: spectra.model_power(spectra.arma(long(s, d)), BINS), doubles="frequency power")
query(
    "spectrum_summary",
    lambda s, d: spectra.power_summary(_power_of(s, d, spectra.yule_walker)),
    f"{_levinson()}, {_power()} ||| SELECT series_id, avg(power) AS mean, var_pop(power) AS variance, sqrt(avg(power * power)) AS rms, max(power) AS peak, arg_max(frequency, (power, -frequency)) AS peak_frequency, sum(power) AS energy, max(power) / nullif(sqrt(avg(power * power)), 0) AS crest FROM PW GROUP BY 1",
    "mean variance rms peak peak_frequency energy crest",
    3,
)
query(
    "spectrum_leading",
    lambda s, d: spectra.leading_power(_power_of(s, d, spectra.yule_walker), 0.75),
    f"{_levinson()}, {_power()}, PQ AS (SELECT series_id, quantile_cont(power, 0.75) AS q FROM PW GROUP BY 1) ||| SELECT series_id, bin, frequency, CASE WHEN power >= q THEN power ELSE 0 END AS power FROM PW JOIN PQ USING (series_id)",
    "frequency power",
    4,
)

# ---- wavelets
LOW = wavelets.daubechies(4)
SCALES = (2.0, 4.0, 10.0)


def _level(source: str, target: str) -> str:
    """CTEs of one level of the filter bank: ``source`` and ``target`` have series_id, t and value (a, d)."""
    taps = len(LOW)
    high = [(-1) ** (i + 1) * x for i, x in enumerate(LOW)]
    return (
        f"{target}N AS (SELECT *, count(*) OVER (PARTITION BY series_id) AS n, lead(value) OVER w AS up, lag(value) OVER w AS down FROM {source} WINDOW w AS (PARTITION BY series_id ORDER BY t)), "
        f"{target}P AS (SELECT series_id, n, t, value FROM {target}N UNION ALL SELECT series_id, n, -s, value - s * coalesce(up - value, 0) FROM {target}N, range(1, {taps + 1}) r(s) WHERE t = 0 "
        f"UNION ALL SELECT series_id, n, t + s, value + s * coalesce(value - down, 0) FROM {target}N, range(1, {taps + 1}) r(s) WHERE t = n - 1), "
        f"{target}T AS (SELECT unnest(range(0, {taps})) AS j, unnest({LOW[::-1]}) AS lo, unnest({high}) AS hi), "
        f"{target} AS (SELECT series_id, CAST((t + j - 1) // 2 AS BIGINT) AS t, sum(lo * value) AS a, sum(hi * value) AS d FROM {target}P, {target}T "
        f"WHERE (t + j - 1) % 2 = 0 AND t + j >= 1 AND (t + j - 1) // 2 < (n + {taps - 1}) // 2 GROUP BY 1, 2)"
    )


query("wavelet_level", lambda s, d: wavelets.filtered(long(s, d), LOW), f"{LONG}, {_level('L', 'W1')} ||| SELECT series_id, t, a AS approximation, d AS detail FROM W1", "approximation detail")
CASCADE = f"{LONG}, {_level('L', 'W1')}, X1 AS (SELECT series_id, t, a AS value FROM W1), {_level('X1', 'W2')}, X2 AS (SELECT series_id, t, a AS value FROM W2), {_level('X2', 'W3')}"
query(
    "wavelet_cascade",
    lambda s, d: wavelets.cascade(long(s, d), LOW, 3),
    f"{CASCADE} ||| "
    + " UNION ALL ".join(f"SELECT series_id, {i} AS level, 'detail' AS kind, t, d AS value FROM W{i}" for i in (1, 2, 3))
    + " UNION ALL SELECT series_id, 3, 'approximation', t, a FROM W3",
    "value",
)
DETAILS = f"D1 AS (SELECT series_id, t, d AS value FROM W1), {_level('D1', 'V2')}, D2 AS (SELECT series_id, t, d AS value FROM V2), {_level('D2', 'V3')}"
query(
    "wavelet_packet_sums",
    lambda s, d: wavelets.packet_sums(long(s, d), LOW),
    f"{CASCADE}, {DETAILS} ||| " + " UNION ALL ".join(f"SELECT series_id, '{c * i}' AS path, sum({c}) AS total FROM {'W' if c == 'a' or i == 1 else 'V'}{i} GROUP BY 1" for c in "ad" for i in (1, 2, 3)),
    "total",
)
TAPS = {s: wavelets.taps_of("mexh", s) for s in SCALES}
query(
    "wavelet_continuous",
    lambda s, d: wavelets.continuous(long(s, d), "mexh", SCALES),
    f"{LONG}, CT AS ("
    + " UNION ALL ".join(f"SELECT {s} AS scale, unnest(range(0, {len(w)})) - {o} AS back, unnest({w.tolist()}) AS w" for s, (w, o) in TAPS.items())
    + ") ||| SELECT a.series_id, scale, a.t, sum(w * b.value) AS value FROM L a JOIN L b ON a.series_id = b.series_id JOIN CT ON b.t = a.t - back GROUP BY 1, 2, 3",
    "scale value",
)


# ---- components of each series; related series share the remainder of their key
WIDTH = 12


def _basis(s, d):
    return components.directions(long(s, d), WIDTH)


def _correlations(s, d):
    return components.weighted_correlations(long(s, d), _basis(s, d), WIDTH)


query("component_shares", lambda s, d: components.shares(_basis(s, d)), doubles="share")
query("component_correlations", _correlations, doubles="correlation")
query("component_groups", lambda s, d: components.component_groups(_correlations(s, d)))
query("component_signal", lambda s, d: components.grouped_signal(long(s, d), _basis(s, d), components.component_groups(_correlations(s, d)), WIDTH), doubles="leading rest")


def _related(s, d):
    return long(s, d).withColumn("group", F.pmod("series_id", F.lit(5)))


query(
    "related_pages",
    lambda s, d: components.pages(_related(s, d), WIDTH).select("group", "series_id", "page", F.array_join(F.transform("values", lambda x: F.round(x, 6).cast("decimal(20,6)")), ",").alias("cells")),
    f"{LONG} ||| SELECT series_id % 5 AS \"group\", series_id, t // {WIDTH} AS page, string_agg(CAST(CAST(round(value, 6) AS DECIMAL(20, 6)) AS VARCHAR), ',' ORDER BY t) AS cells FROM L GROUP BY 1, 2, 3 HAVING count(*) = {WIDTH}",
)
query("shared_basis", lambda s, d: components.shared_basis(components.pages(_related(s, d), WIDTH), WIDTH).select("group", "rank", "retained"), doubles="retained")
query("mssa_forecast", lambda s, d: components.multivariate_ssa(_related(s, d), WIDTH, 6, 5), doubles="y")
