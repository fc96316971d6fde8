"""Operators on feature tables, channels, distributions, labelled intervals and record metadata."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolake.operators.layouts import by_series, whole_series


def impute_means(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls as the mean of their column; one row of means is joined."""
    means = rows.agg(*[F.avg(c).alias(f"_{c}") for c in columns])
    return rows.crossJoin(F.broadcast(means)).withColumns({c: F.coalesce(c, f"_{c}") for c in columns}).drop(*[f"_{c}" for c in columns])


def standardise(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(x - mean) / population deviation; a deviation of 0 counts as 1."""
    stats = rows.agg(*[F.avg(c).alias(f"_m{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s{c}") for c in columns])
    out = rows.crossJoin(F.broadcast(stats))
    scaled = {c: (F.col(c) - F.col(f"_m{c}")) / F.when(F.col(f"_s{c}") == 0, 1.0).otherwise(F.col(f"_s{c}")) for c in columns}
    return out.withColumns(scaled).select(rows.columns)


def weighted_filter(long: DataFrame, weights: list[float]) -> DataFrame:
    """A centred weighted mean over 2k + 1 values; at the ends over those that are there."""
    k = len(weights) // 2
    near = [F.lag("value", -d).over(by_series()) for d in range(-k, k + 1)]  # a negative lag looks ahead
    rows = long.select("series_id", "t", *[x.alias(f"w{i}") for i, x in enumerate(near)])
    top = reduce(lambda a, b: a + b, [F.coalesce(F.col(f"w{i}") * w, F.lit(0.0)) for i, w in enumerate(weights)])
    mass = reduce(lambda a, b: a + b, [F.when(F.col(f"w{i}").isNull(), 0.0).otherwise(w) for i, w in enumerate(weights)])
    return rows.select("series_id", "t", (top / mass).alias("smooth"))


def correlated_pairs(rows: DataFrame, columns: list[str], limit: float) -> DataFrame:
    """a, b, r of the column pairs with |r| > ``limit``; dropping each b leaves an uncorrelated table."""
    pairs = list(combinations(columns, 2))

    def r(a: str, b: str) -> Column:
        return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))

    wide = rows.agg(*[r(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    found = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)]))
    return wide.select(found.alias("p")).select("p.*").where(F.abs("r") > limit)


def merge_branches(branches: list[DataFrame], key: str) -> DataFrame:
    """Feature tables of the same samples side by side; columns of branch i are prefixed with b<i>_."""
    renamed = [b.select(key, *[F.col(c).alias(f"b{i}_{c}") for c in b.columns if c != key]) for i, b in enumerate(branches)]
    return reduce(lambda a, b: a.join(b, key), renamed)


def bag_columns(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """mean, median, max, min over columns of each row."""
    x = F.array_sort(F.array(*columns))
    n = len(columns)
    return rows.select(
        key,
        (F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / n).alias("mean"),
        ((F.element_at(x, (n - 1) // 2 + 1) + F.element_at(x, n // 2 + 1)) / 2).alias("median"),
        F.array_max(x).alias("max"),
        F.array_min(x).alias("min"),
    )


def distribution_distances(rows: DataFrame, *keys: str) -> DataFrame:
    """kl, js, total_variation, hellinger of p against q (unnormalised, positive) by ``keys``."""
    w = Window.partitionBy(*keys)
    r = rows.select(*keys, (F.col("p") / F.sum("p").over(w)).alias("p"), (F.col("q") / F.sum("q").over(w)).alias("q")).withColumn("m", (F.col("p") + F.col("q")) / 2)
    p, q, m = F.col("p"), F.col("q"), F.col("m")
    return r.groupBy(*keys).agg(
        F.sum(p * F.ln(p / q)).alias("kl"),
        (F.sum(p * F.ln(p / m)) / 2 + F.sum(q * F.ln(q / m)) / 2).alias("js"),
        (F.sum(F.abs(p - q)) / 2).alias("total_variation"),
        (F.sqrt(F.sum((F.sqrt(p) - F.sqrt(q)) ** 2)) / F.sqrt(F.lit(2.0))).alias("hellinger"),
    )


def boundaries(points: DataFrame, width: int, side: str) -> DataFrame:
    """series_id, t, w_start, w_end around each labelled point: before (``left``), after (``right``) or both
    (``center``); where windows overlap the earlier ends before the later begins."""
    a, b = {"left": (-width, 0), "right": (0, width), "center": (-(width // 2), width // 2)}[side]
    raw = points.select("series_id", "t", (F.col("t") + a).alias("w_start"), (F.col("t") + b).alias("w_end"))
    following = F.lead("w_start").over(by_series())
    return raw.select("series_id", "t", "w_start", F.when(following <= F.col("w_end"), following - 1).otherwise(F.col("w_end")).alias("w_end"))


def changepoint_confusion(windows: DataFrame, hits: DataFrame) -> DataFrame:
    """series_id, tp (windows with a hit), fn (windows without), fp (hits outside all windows)."""
    inside = windows.where("w_start <= w_end").select("series_id", F.col("t").alias("w"), F.explode(F.sequence("w_start", "w_end")).alias("t"))
    joined = hits.select("series_id", "t").distinct().join(inside, ["series_id", "t"], "left")
    out = joined.groupBy("series_id").agg(F.count_distinct("w").alias("tp"), F.count_if(F.col("w").isNull()).alias("fp"))
    n = windows.groupBy("series_id").agg(F.count("*").alias("n"))
    tp = F.coalesce("tp", F.lit(0))
    return n.join(out, "series_id", "left").select("series_id", tp.alias("tp"), F.coalesce("fp", F.lit(0)).alias("fp"), (F.col("n") - tp).alias("fn"))


def modal_intervals(intervals: DataFrame) -> DataFrame:
    """Labelled intervals (class, start, end) of one length: the most frequent (the longer of ties). Longer ones are cut into
    as many as fit, shorter ones extended to their right."""
    length = (F.col("end") - F.col("start")).alias("n")
    mode = intervals.select(length).groupBy("n").agg(F.count("*").alias("k")).agg(F.max_by("n", F.struct("k", "n")).alias("m"))
    rows = intervals.crossJoin(F.broadcast(mode)).withColumn("parts", F.greatest(F.lit(1).cast("long"), F.floor((F.col("end") - F.col("start")) / F.col("m"))))
    rows = rows.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    start = F.col("start") + F.col("i") * F.col("m")
    return rows.select("class", start.alias("start"), (start + F.col("m")).alias("end"))


def temporal_split(long: DataFrame, train: float, calibration: float) -> DataFrame:
    """series_id, t, part: train, calibration and test in the order of time."""
    share = F.col("t") / F.count("*").over(whole_series())
    part = F.when(share < train, "train").when(share < train + calibration, "calibration").otherwise("test")
    return long.select("series_id", "t", part.alias("part"))


def leave_one_out(rows: DataFrame, domain: str) -> DataFrame:
    """held_out, part, n: the sizes of the splits that leave each domain out in turn."""
    counts = rows.groupBy(domain).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("all"))
    each = counts.crossJoin(F.broadcast(total))
    parts = F.explode(F.array(F.struct(F.lit("test").alias("part"), F.col("n")), F.struct(F.lit("train").alias("part"), (F.col("all") - F.col("n")).alias("n"))))
    return each.select(F.col(domain).alias("held_out"), parts.alias("p")).select("held_out", "p.part", "p.n")


def best_width(long: DataFrame, widths: list[int]) -> DataFrame:
    """series_id, width, mae: the moving-average width of least one-step error; ties to the narrower. All widths
    are columns of one pass."""
    w = by_series()
    tries = [F.abs(F.col("value") - F.avg("value").over(w.rowsBetween(-k, -1))).alias(f"e{k}") for k in widths]
    errors = long.select("series_id", "t", *tries).where(F.col("t") >= max(widths)).groupBy("series_id").agg(*[F.avg(f"e{k}").alias(f"e{k}") for k in widths])
    each = F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("width"), F.col(f"e{k}").alias("mae")) for k in widths]))
    return errors.select("series_id", each.alias("x")).groupBy("series_id").agg(F.min(F.struct(F.round("x.mae", 9).alias("m"), F.col("x.width").alias("width"), F.col("x.mae").alias("mae"))).alias("b")).select("series_id", "b.width", "b.mae")


def class_channels(panel: DataFrame, keep: int) -> DataFrame:
    """channel, spread: the ``keep`` dimensions whose class means lie farthest apart (sum over pairs of classes)."""
    cells = panel.select("target", F.posexplode("values").alias("channel", "x"))
    means = cells.groupBy("target", "channel").agg(F.avg("x").alias("m"))
    a, b = means.alias("a"), means.alias("b")
    pairs = a.join(b, (F.col("a.channel") == F.col("b.channel")) & (F.col("a.target") < F.col("b.target")))
    spread = pairs.groupBy(F.col("a.channel").alias("channel")).agg(F.sum(F.abs(F.col("a.m") - F.col("b.m"))).alias("spread"))
    return spread.orderBy(F.desc(F.round("spread", 9)), "channel").limit(keep)


def autocorrelations(long: DataFrame, lags: int) -> DataFrame:
    """series_id, lag, r for lags 1 to ``lags``: centred products over the variance, as columns of one pass."""
    w = by_series()
    centred = long.select("series_id", "t", (F.col("value") - F.avg("value").over(whole_series())).alias("e"))
    rows = centred.select("series_id", "e", *[(F.col("e") * F.lag("e", k).over(w)).alias(f"p{k}") for k in range(1, lags + 1)])
    sums = rows.groupBy("series_id").agg(F.sum(F.col("e") * F.col("e")).alias("s"), *[F.sum(f"p{k}").alias(f"p{k}") for k in range(1, lags + 1)])
    each = F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("lag"), F.try_divide(F.col(f"p{k}"), F.col("s")).alias("r")) for k in range(1, lags + 1)]))
    return sums.select("series_id", each.alias("x")).select("series_id", "x.lag", "x.r")


def window_by_autocorrelation(long: DataFrame, lags: int) -> DataFrame:
    """series_id, width: the lag of the highest autocorrelation that is above both its neighbours'; ``lags`` if none is."""
    acf = autocorrelations(long, lags)
    w = whole_series().orderBy("lag")
    peaks = acf.withColumn("l", F.lag("r").over(w)).withColumn("n", F.lead("r").over(w))
    best = F.max_by(F.col("lag"), F.when((F.col("r") > F.col("l")) & (F.col("r") > F.col("n")), F.struct(F.round("r", 9), -F.col("lag"))))
    return peaks.groupBy("series_id").agg(F.coalesce(best, F.lit(lags).cast("long")).alias("width"))


def flatten_json(rows: DataFrame, key: str, text: str, fields: dict[str, str]) -> DataFrame:
    """Fields of a JSON text as columns, by (name, type)."""
    schema = ", ".join(f"{n} {t}" for n, t in fields.items())
    return rows.select(key, F.from_json(text, schema).alias("j")).select(key, *[f"j.{n}" for n in fields])


def route(diagnostics: DataFrame) -> DataFrame:
    """series_id, family: a forecaster's family by rules on switching and slope."""
    family = F.when(F.col("switching") > 0.7, "smoothing").when(F.abs("slope") > 0.3, "trend").otherwise("lagged")
    return diagnostics.select("series_id", family.alias("family"))
