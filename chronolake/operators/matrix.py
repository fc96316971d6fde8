"""Distances, recurrence, kernels and images of vectors and series.

Pairs are a product of a stated set of rows with all others, in a join on exploded block numbers; each side
carries its vector, so no matrix is held anywhere. Kernel matrices are long tables (i, j, k)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolake.operators.layouts import by_series, to_panel, whole_series
from chronolake.operators.windows import piecewise_means


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)


def distance(a: Column, b: Column, metric: str) -> Column:
    """Distance of two arrays of doubles; null where cosine or correlation aren't defined."""
    def each(f):
        return F.zip_with(a, b, f)

    if metric == "euclidean":
        return F.sqrt(_sum(each(lambda x, y: (x - y) * (x - y))))
    if metric == "cityblock":
        return _sum(each(lambda x, y: F.abs(x - y)))
    if metric == "chebyshev":
        return F.array_max(each(lambda x, y: F.abs(x - y)))
    if metric == "minkowski":
        return F.pow(_sum(each(lambda x, y: F.pow(F.abs(x - y), F.lit(3.0)))), F.lit(1.0) / 3)
    if metric == "canberra":
        return _sum(each(lambda x, y: F.when(F.abs(x) + F.abs(y) == 0, 0.0).otherwise(F.abs(x - y) / (F.abs(x) + F.abs(y)))))
    if metric == "cosine":
        dot = _sum(each(lambda x, y: x * y))
        return 1 - F.try_divide(dot, F.sqrt(_sum(F.transform(a, lambda x: x * x)) * _sum(F.transform(b, lambda x: x * x))))
    if metric == "correlation":
        n = F.size(a)
        sx, sy = _sum(a), _sum(b)
        sxy = _sum(each(lambda x, y: x * y))
        vx, vy = _sum(F.transform(a, lambda x: x * x)) - sx * sx / n, _sum(F.transform(b, lambda x: x * x)) - sy * sy / n
        return 1 - F.try_divide(sxy - sx * sy / n, F.sqrt(vx * vy))
    raise ValueError(f"unknown metric {metric}")


METRICS = ["euclidean", "cityblock", "chebyshev", "minkowski", "cosine", "correlation", "canberra"]


#: Anchors in a block, and other rows that meet it in one task, about.
BLOCK_ANCHORS, BLOCK_ROWS = 256, 16_384


def anchored_pairs(panel: DataFrame, anchors: DataFrame) -> DataFrame:
    """i, j, a, b: each of ``anchors`` with each other row of ``panel`` (sample_id, values).

    The anchors are a stated set. Both sides are dealt into blocks, whose numbers follow from their counts, and
    meet by an equi-join on the two block numbers, never as one product."""
    left, right = _dealt(panel, anchors)
    return left.join(right, ["p", "q"]).where("i <> j").drop("p", "q")


def _dealt(panel: DataFrame, anchors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Anchors (i, a) and rows (j, b) with the numbers p, q of the blocks in which they meet."""
    left_blocks, right_blocks = -(-anchors.count() // BLOCK_ANCHORS) or 1, -(-panel.count() // BLOCK_ROWS) or 1
    right_blocks = max(right_blocks, min(panel.sparkSession.sparkContext.defaultParallelism, right_blocks * 8))

    def dealt(n: int) -> Column:
        return F.pmod(F.xxhash64("sample_id"), F.lit(n)).cast("int")

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = anchors.select(F.col("sample_id").alias("i"), F.col("values").alias("a"), dealt(left_blocks).alias("p"), every(right_blocks).alias("q"))
    right = panel.select(F.col("sample_id").alias("j"), F.col("values").alias("b"), dealt(right_blocks).alias("q"), every(left_blocks).alias("p"))
    return left, right


def _all_distances(a: np.ndarray, rows: np.ndarray, metrics: list[str]) -> dict[str, np.ndarray]:
    """Distances of ``a`` to each of ``rows``; nan where they aren't defined. What metrics share is computed once."""
    out = {}
    with np.errstate(all="ignore"):
        apart = np.abs(rows - a)
        if {"cosine", "correlation"} & set(metrics):
            dot, qa, qb = rows @ a, a @ a, (rows * rows).sum(axis=1)
        for m in metrics:
            if m == "euclidean":
                out[m] = np.sqrt((apart * apart).sum(axis=1))
            elif m == "cityblock":
                out[m] = apart.sum(axis=1)
            elif m == "chebyshev":
                out[m] = apart.max(axis=1) if apart.shape[1] else np.full(len(rows), np.nan)
            elif m == "minkowski":
                out[m] = np.cbrt((apart * apart * apart).sum(axis=1))
            elif m == "canberra":
                size = np.abs(rows) + np.abs(a)
                out[m] = np.where(size == 0, 0.0, apart / np.where(size == 0, 1.0, size)).sum(axis=1)
            elif m == "cosine":
                out[m] = 1 - dot / np.sqrt(qa * qb)
            elif m == "correlation":
                n, sa, sb = len(a), a.sum(), rows.sum(axis=1)
                out[m] = 1 - (dot - sa * sb / n) / np.sqrt((qa - sa * sa / n) * (qb - sb * sb / n)) if n else np.full(len(rows), np.nan)
            else:
                raise ValueError(f"unknown metric {m}")
    return out


def distances(panel: DataFrame, anchors: DataFrame, metrics: list[str] = METRICS) -> DataFrame:
    """i, j and a column for each metric, null where it isn't defined, where a component is null, or where vectors
    differ in length. Blocks of anchors and of rows meet as in ``anchored_pairs``; an anchor is taken with all rows of
    its block at once."""
    kind = panel.schema["sample_id"].dataType.simpleString()
    left, right = _dealt(panel, anchors)

    def run(asked: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"i": asked["i"][:0], "j": block["j"][:0], **{m: np.empty(0) for m in metrics}})]
        sizes = block["b"].map(lambda v: -1 if v is None else len(v)).to_numpy()
        parts = {n: (np.flatnonzero(sizes == n), np.array([np.asarray(v, "float64") for v in block["b"][sizes == n]])) for n in set(sizes.tolist()) - {-1}}
        ids = block["j"].to_numpy()
        for i, a in zip(asked["i"], asked["a"], strict=True):
            values = np.full((len(metrics), len(block)), np.nan)
            if a is not None and len(a) in parts:
                at, rows = parts[len(a)]
                values[:, at] = list(_all_distances(np.asarray(a, "float64"), rows, metrics).values())
            other = ids != i
            out.append(pd.DataFrame({"i": i, "j": ids[other], **{m: v[other] for m, v in zip(metrics, values, strict=True)}}))
        return pd.concat(out[1:] or out)

    found = left.groupBy("p", "q").cogroup(right.groupBy("p", "q")).applyInPandas(run, f"i {kind}, j {kind}, {', '.join(f'{m} double' for m in metrics)}")
    return found.select("i", "j", *[F.nanvl(m, F.lit(None).cast("double")).alias(m) for m in metrics])


def _stacked(column: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: which vectors have it and no null component, and these as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False).copy()
    holes = np.unique(pc.list_parent_indices(column).to_numpy()[pc.is_null(pc.list_flatten(column)).to_numpy(zero_copy_only=False)])
    sizes[holes] = -1
    found = {int(n): np.flatnonzero(sizes == n) for n in np.unique(sizes) if n >= 0}
    return {n: (at, pc.list_flatten(column.take(pa.array(at))).to_numpy(zero_copy_only=False).astype("float64", copy=False).reshape(len(at), n)) for n, at in found.items()}


def kernel_family(panel: DataFrame, anchors: DataFrame, degree: int = 3, gamma: float = 0.1) -> DataFrame:
    """i, j, linear, polynomial (of the product and 1), laplacian (of the sum of absolute differences); null where a component
    is null, or where vectors differ in length. Blocks of anchors and of rows meet as in ``distances``, in as many partitions
    as the session shuffles to: adaptive execution would put blocks together by size."""
    kind = panel.schema["sample_id"].dataType.simpleString()
    names = ("linear", "polynomial", "laplacian")
    tasks = int(panel.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    left, right = (side.repartition(tasks, "p", "q") for side in _dealt(panel, anchors))

    def run(asked: pa.Table, block: pa.Table) -> pa.Table:
        n, rows = block.num_rows, _stacked(block["b"])
        values, known = np.full((3, asked.num_rows, n), np.nan), np.zeros((asked.num_rows, n), bool)
        for width, (own, marks) in _stacked(asked["a"]).items():
            if width not in rows:
                continue
            at, vectors = rows[width]
            columns = np.ascontiguousarray(vectors.T)
            apart, one = np.empty(len(at)), np.empty(len(at))
            for i, mark, products in zip(own, marks, marks @ columns, strict=True):
                apart[:] = 0
                for c, x in zip(columns, mark, strict=True):
                    apart += np.abs(np.subtract(c, x, out=one), out=one)
                values[0, i, at], values[1, i, at], values[2, i, at], known[i, at] = products, (products + 1) ** degree, np.exp(-gamma * apart), True
        i, j = pa.array(np.repeat(np.arange(asked.num_rows), n)), pa.array(np.tile(np.arange(n), asked.num_rows))
        out = {"i": asked["i"].take(i), "j": block["j"].take(j)}
        out |= {name: pa.array(v.ravel(), mask=~known.ravel()) for name, v in zip(names, values, strict=True)}
        return pa.table(out).filter(pc.not_equal(out["i"], out["j"]))

    return left.groupBy("p", "q").cogroup(right.groupBy("p", "q")).applyInArrow(run, f"i {kind}, j {kind}, {', '.join(f'{m} double' for m in names)}")


def rbf_kernel(panel: DataFrame, anchors: DataFrame, gamma: float) -> DataFrame:
    d = distance(F.col("a"), F.col("b"), "euclidean")
    return anchored_pairs(panel, anchors).select("i", "j", F.exp(-gamma * d * d).alias("k"))


def pair_learning(panel: DataFrame, anchors: DataFrame) -> DataFrame:
    """i, j, differs, diff (absolute differences), target_delta: rows for pairwise difference learning."""
    t = panel.select(F.col("sample_id").alias("j"), F.col("target").alias("tj"))
    u = anchors.select(F.col("sample_id").alias("i"), F.col("target").alias("ti"))
    pairs = anchored_pairs(panel, anchors).join(t, "j").join(u, "i")
    diff = F.zip_with("a", "b", lambda x, y: F.abs(x - y))
    return pairs.select("i", "j", (F.col("ti") != F.col("tj")).cast("long").alias("differs"), diff.alias("diff"), (F.col("tj") - F.col("ti")).cast("double").alias("target_delta"))


#: Most numbers in the class centroids that are sent to all tasks.
MOST_CENTROIDS = 4_000_000


def nearest_centroid(panel: DataFrame) -> DataFrame:
    """sample_id, label: the class whose mean vector is nearest; ties to the smaller label.

    Centroids are aggregated by class and dimension, and sent to all tasks as one row, after a check of their
    size; larger sets meet the samples' cells in an equi-join on the dimension."""
    cells = panel.select("sample_id", "target", F.posexplode("values").alias("d", "x"))
    centre = cells.groupBy("target", "d").agg(F.avg("x").alias("c")).withColumnRenamed("target", "label")
    if centre.count() > MOST_CENTROIDS:
        far = cells.drop("target").join(centre, "d").groupBy("sample_id", "label").agg(F.sum((F.col("x") - F.col("c")) ** 2).alias("far"))
        return far.groupBy("sample_id").agg(F.min(F.struct(F.round("far", 9), "label")).alias("m")).select("sample_id", F.col("m.label").alias("label"))
    vectors = centre.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("d", "c"))).alias("v"))
    vectors = vectors.select(F.struct("label", F.transform("v", lambda x: x["c"]).alias("c")).alias("s")).agg(F.collect_list("s").alias("centres"))

    def far_from(c: Column) -> Column:
        return F.struct(F.round(_sum(F.zip_with("values", c["c"], lambda x, y: (x - y) * (x - y))), 9).alias("far"), c["label"].alias("label"))

    nearest = F.array_min(F.transform("centres", far_from))
    return panel.select("sample_id", "values").join(F.broadcast(vectors)).select("sample_id", nearest["label"].alias("label"))


def majority_class(panel: DataFrame) -> DataFrame:
    """One row: the most frequent class (ties to the smaller) and its share."""
    counts = panel.groupBy("target").agg(F.count("*").alias("n"))
    return counts.agg(F.max_by(F.col("target"), F.struct("n", -F.col("target"))).alias("label"), (F.max("n") / F.sum("n")).alias("share"))


def _unit(long: DataFrame) -> DataFrame:
    """series_id, t, x: values less the series' least, over its range, which is the largest distance."""
    low, high = F.min("value").over(whole_series()), F.max("value").over(whole_series())
    return long.select("series_id", "t", ((F.col("value") - low) / F.greatest(high - low, F.lit(1e-12))).alias("x"))


def _nearness(threshold: float) -> float:
    """Points are recurrent if 1 - distance / largest distance >= ``threshold``, to nine places."""
    return 1 - threshold + 5e-10


def recurrence_rate(long: DataFrame, threshold: float = 0.7) -> DataFrame:
    """series_id, rate: recurrent pairs over all pairs. Counted by a range of values around each: no pair is a row."""
    eps = _nearness(threshold)
    near = F.expr(f"count(*) OVER (PARTITION BY series_id ORDER BY x RANGE BETWEEN {eps!r}D PRECEDING AND {eps!r}D FOLLOWING)") - 1
    n = F.count("*")
    return _unit(long).select("series_id", near.alias("k")).groupBy("series_id").agg((F.sum("k") / F.greatest(n * (n - 1), F.lit(1))).alias("rate"))


#: Diagonals, or points, of a series whose lines one row of work counts.
LINES = 256


def line_lengths(long: DataFrame, threshold: float = 0.7) -> DataFrame:
    """series_id, kind, length, n: how many lines of each length the recurrence matrix of a series has: ``diagonal``
    ones above the main diagonal, ``vertical`` ones, and ``white`` vertical ones of points that aren't recurrent.

    All pairs of a series are compared, which is quadratic in its length, but none is a row: a row of work is the
    series' values and a block of ``LINES`` diagonals or points, and gives counts by length."""
    eps = _nearness(threshold)
    panel = to_panel(_unit(long).withColumnRenamed("x", "value"))
    blocks = F.explode(F.sequence(F.lit(0), F.floor((F.size("values") - 1) / LINES).cast("int")))
    work = panel.select("series_id", "values", blocks.alias("block")).repartition("series_id", "block")

    def runs(flags: np.ndarray) -> np.ndarray:
        """How many runs of each length the rows of a boolean matrix have."""
        edges = np.diff(np.pad(flags.astype("int8"), ((0, 0), (1, 1))), axis=1)
        return np.bincount(np.nonzero(edges.ravel() < 0)[0] - np.nonzero(edges.ravel() > 0)[0], minlength=1)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, values, block in zip(batch["series_id"], batch["values"], batch["block"], strict=True):
                x, found = np.asarray(values), {}
                offset = np.arange(max(1, block * LINES), min(len(x), (block + 1) * LINES))
                if len(offset):
                    ahead = np.arange(len(x) - offset[0]) + offset[:, None]
                    other = x[np.minimum(ahead, len(x) - 1)]
                    found["diagonal"] = runs((np.abs(other - x[: other.shape[1]]) <= eps) & (ahead < len(x)))
                near = np.abs(x[block * LINES : (block + 1) * LINES, None] - x[None, :]) <= eps
                found["vertical"], found["white"] = runs(near), runs(~near)
                out += [(key, kind, int(k), int(lengths[k])) for kind, lengths in found.items() for k in np.flatnonzero(lengths)]
            yield pd.DataFrame(out, columns=["series_id", "kind", "length", "n"])

    kind = long.schema["series_id"].dataType.simpleString()
    parts = work.mapInPandas(count, f"series_id {kind}, kind string, length long, n long")
    return parts.groupBy("series_id", "kind", "length").agg(F.sum("n").alias("n"))


def diagonal_lines(long: DataFrame, threshold: float = 0.7, least: int = 2) -> DataFrame:
    """series_id, determinism (share of recurrent pairs above the diagonal in lines of ``least`` or more), mean_line, longest."""
    lines = line_lengths(long, threshold).where("kind = 'diagonal'")
    kept, n = F.col("length") >= least, F.col("n")
    points, many = F.sum(F.when(kept, n * F.col("length"))), F.sum(F.when(kept, n))
    return lines.groupBy("series_id").agg(
        (F.coalesce(points, F.lit(0)) / F.sum(n * F.col("length"))).alias("determinism"), F.coalesce(points / many, F.lit(0.0)).alias("mean_line"), F.max("length").alias("longest")
    )


def recurrence_measures(long: DataFrame, threshold: float = 0.7, diagonal: int = 3, vertical: int = 3, white: int = 2) -> DataFrame:
    """Fifteen measures of the recurrence matrix (whole, the main diagonal included) from its line lengths: rr, det,
    adll, ldll, div, edl (diagonals), lam, avll, lvll, evl (verticals), awll, lwll, ewll (white verticals), rdrr (det
    / rr), rld (lam / det). Lines count from the lengths given on; the main diagonal, one line of the whole
    length, counts for adll, ldll and div alone. Null where there is nothing to divide by."""
    sizes = long.groupBy("series_id").agg(F.count("*").alias("size"))
    lines = line_lengths(long, threshold).join(sizes, "series_id")
    n, length, points = F.col("n"), F.col("length"), F.col("n") * F.col("length")

    def of(kind: str, value: Column, least: int = 1) -> Column:
        return F.coalesce(F.sum(F.when((F.col("kind") == kind) & (length >= least), value)), F.lit(0))

    def entropy(kind: str, least: int) -> Column:
        """Of the distribution of lengths: ln N - sum n ln n / N."""
        total = of(kind, n, least)
        return F.when(total > 0, F.ln(total) - of(kind, n * F.ln(n), least) / total).otherwise(0.0)

    longest = {k: F.max(F.when(F.col("kind") == k, length)) for k in ("vertical", "white")}
    size = F.first("size")
    black = of("vertical", points)
    upper, upper_lines = of("diagonal", points, diagonal), of("diagonal", n, diagonal)
    main = F.when(size >= diagonal, 1).otherwise(0)
    out = lines.groupBy("series_id").agg(
        (black / (size * size)).alias("rr"),
        F.try_divide(upper, of("diagonal", points)).alias("det"),
        F.try_divide(2 * upper + main * size, 2 * upper_lines + main).alias("adll"),
        size.alias("ldll"),
        (1 / size).alias("div"),
        entropy("diagonal", diagonal).alias("edl"),
        F.try_divide(of("vertical", points, vertical), black).alias("lam"),
        F.try_divide(of("vertical", points, vertical), of("vertical", n, vertical)).alias("avll"),
        F.coalesce(longest["vertical"], F.lit(1)).alias("lvll"),
        entropy("vertical", vertical).alias("evl"),
        F.try_divide(of("white", points, white), of("white", n, white)).alias("awll"),
        F.coalesce(longest["white"], F.lit(1)).alias("lwll"),
        entropy("white", white).alias("ewll"),
    )
    return out.withColumn("rdrr", F.try_divide("det", "rr")).withColumn("rld", F.try_divide("lam", "det"))


def transition_field(long: DataFrame, bins: int = 4) -> DataFrame:
    """series_id, a, b, p: how often a value of quantile bin a is followed by one of bin b (rows sum to 1)."""
    w = whole_series()
    q = [F.percentile("value", F.lit(i / bins)).over(w) for i in range(1, bins)]
    bin_ = sum((F.when(F.col("value") > x, 1).otherwise(0) for x in q[1:]), F.when(F.col("value") > q[0], 1).otherwise(0))
    rows = long.select("series_id", "t", bin_.cast("long").alias("a"))
    rows = rows.withColumn("b", F.lead("a").over(by_series())).where("b IS NOT NULL")
    counts = rows.groupBy("series_id", "a", "b").agg(F.count("*").alias("k"))
    return counts.select("series_id", "a", "b", (F.col("k") / F.sum("k").over(w.partitionBy("series_id", "a"))).alias("p"))


def angular_field(long: DataFrame, size: int = 6, summed: bool = True) -> DataFrame:
    """series_id, i, j, value: cosines of angle sums (or sines of differences) of the series, scaled to
    [-1, 1] and reduced to ``size`` means."""
    small = piecewise_means(long, size)
    w = whole_series()
    a, b = F.min("value").over(w), F.max("value").over(w)
    x = small.select("series_id", "piece", F.when(b - a < 1e-12, 0.0).otherwise(2 * (F.col("value") - a) / (b - a) - 1).alias("x"))
    y = F.sqrt(F.greatest(1 - F.col("x") * F.col("x"), F.lit(0.0)))
    x = x.withColumn("y", y)
    other = x.select("series_id", F.col("piece").alias("j"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    value = F.col("x") * F.col("x2") - F.col("y") * F.col("y2") if summed else F.col("y") * F.col("x2") - F.col("x") * F.col("y2")
    return x.join(other, "series_id").select("series_id", F.col("piece").alias("i"), "j", value.alias("value"))


def phase_amplitudes(rows: DataFrame, a: str, b: str, c: str) -> DataFrame:
    """alpha, beta (Clarke), amplitude and phase of three-phase values, added to ``rows``."""
    x, y, z = F.col(a), F.col(b), F.col(c)
    out = rows.withColumn("alpha", (2 * x - y - z) / 3).withColumn("beta", (y - z) / F.sqrt(F.lit(3.0)))
    return out.withColumn("amplitude", F.sqrt(F.col("alpha") ** 2 + F.col("beta") ** 2)).withColumn("phase", F.atan2("beta", "alpha"))


def panel_of(long: DataFrame) -> DataFrame:
    return to_panel(long).withColumnRenamed("series_id", "sample_id")


def scale_gamma(panel: DataFrame) -> float:
    """1 / (dimensions * variance of all components), 1 where these don't vary."""
    cells = panel.select(F.explode("values").alias("x")).agg(F.var_pop("x").alias("v")).first()
    dims = panel.agg(F.max(F.size("values")).alias("d")).first()["d"] or 1
    return 1 / (dims * cells["v"]) if cells["v"] and cells["v"] > 1e-12 else 1.0


def kernel(a: Column, b: Column, name: str, gamma: float = 1.0, offset: float = 1.0, degree: int = 3) -> Column:
    """``rbf``, ``laplacian``, ``cosine``, ``linear`` or ``polynomial`` of two arrays."""
    dot = _sum(F.zip_with(a, b, lambda x, y: x * y))
    if name == "rbf":
        return F.exp(-gamma * _sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))
    if name == "laplacian":
        return F.exp(-gamma * distance(a, b, "cityblock"))
    if name == "cosine":
        norms = F.greatest(F.sqrt(_sum(F.transform(a, lambda x: x * x))), F.lit(1e-12)) * F.greatest(F.sqrt(_sum(F.transform(b, lambda x: x * x))), F.lit(1e-12))
        return dot / norms
    if name == "linear":
        return dot
    if name == "polynomial":
        return F.pow(gamma * dot + offset, F.lit(float(degree)))
    raise ValueError(f"unknown kernel {name}")


def kernel_matrix(rows: DataFrame, name: str, gamma: float = 1.0) -> DataFrame:
    """i, j, k over all pairs of a stated set ``rows``, each with itself included."""
    own = rows.select(F.col("sample_id").alias("i"), F.col("sample_id").alias("j"), F.col("values").alias("a"), F.col("values").alias("b"))
    return anchored_pairs(rows, rows).unionByName(own).select("i", "j", kernel(F.col("a"), F.col("b"), name, gamma).alias("k"))


def centred(matrix: DataFrame) -> DataFrame:
    """i, j, k: a symmetric kernel matrix less the means of row and column, plus the mean of all."""
    rows = matrix.groupBy("i").agg(F.avg("k").alias("r"))
    total = matrix.agg(F.avg("k").alias("m"))
    out = matrix.join(rows, "i").join(rows.select(F.col("i").alias("j"), F.col("r").alias("c")), "j").join(F.broadcast(total))
    return out.select("i", "j", (F.col("k") - F.col("r") - F.col("c") + F.col("m")).alias("k"))


def trace_normalised(matrix: DataFrame) -> DataFrame:
    """i, j, k: scaled so that the trace is the number of rows."""
    scale = matrix.where("i = j").agg((F.sum("k") / F.count("*")).alias("s"))
    return matrix.join(F.broadcast(scale)).select("i", "j", (F.col("k") / F.when(F.abs("s") < 1e-12, 1.0).otherwise(F.col("s"))).alias("k"))


def alignment(matrix: DataFrame, targets: DataFrame) -> DataFrame:
    """One row: alignment of a centred kernel with that of the targets (1 where classes agree, else 0; centred)."""
    a = targets.select(F.col("sample_id").alias("i"), F.col("target").alias("ti"))
    b = targets.select(F.col("sample_id").alias("j"), F.col("target").alias("tj"))
    pairs = matrix.join(a, "i").join(b, "j")
    ideal = centred(pairs.select("i", "j", (F.col("ti") == F.col("tj")).cast("double").alias("k"))).withColumnRenamed("k", "y")
    both = centred(matrix).join(ideal, ["i", "j"])
    k, y = F.col("k"), F.col("y")
    return both.agg(F.coalesce(F.try_divide(F.sum(k * y), F.sqrt(F.sum(k * k)) * F.sqrt(F.sum(y * y))), F.lit(0.0)).alias("alignment"))


def simplex_weights(scores: dict[str, float], least: float = 0.0) -> dict[str, float]:
    """Kernel weights: the nearest point of the simplex to the scores; weights under ``least`` as 0, the rest scaled."""
    names, x = list(scores), np.array(list(scores.values()), "float64")
    u = np.sort(x)[::-1]
    top = (np.cumsum(u) - 1) / np.arange(1, len(u) + 1)
    w = np.maximum(x - top[np.flatnonzero(u > top)[-1]], 0)
    w[w < least] = 0
    return dict(zip(names, (w / w.sum() if w.sum() > 0 else np.full(len(w), 1 / len(w))).tolist(), strict=True))


def to_bytes(field: DataFrame, value: str, *keys: str) -> DataFrame:
    """``field`` with the image's value as 0 to 255: by its range within ``keys``; a constant image is 0."""
    w = Window.partitionBy(*keys)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return field.withColumn(value, F.when(high - low < 1e-12, 0).otherwise(F.floor(255 * (F.col(value) - low) / (high - low))).cast("int"))


def covariances(panel: DataFrame) -> DataFrame:
    """sample_id, c, d, cov (c <= d): covariances of the channels of each sample; ``panel``: sample_id, channel, values."""
    cells = panel.select("sample_id", "channel", F.posexplode("values").alias("t", "x"))
    means = cells.groupBy("sample_id", "channel").agg(F.avg("x").alias("m"))
    cells = cells.join(means, ["sample_id", "channel"]).select("sample_id", "t", F.col("channel").alias("c"), (F.col("x") - F.col("m")).alias("x"))
    other = cells.select("sample_id", "t", F.col("c").alias("d"), F.col("x").alias("y"))
    return cells.join(other, ["sample_id", "t"]).where("c <= d").groupBy("sample_id", "c", "d").agg(F.avg(F.col("x") * F.col("y")).alias("cov"))


def log_covariances(panel: DataFrame, shrink: float = 0.1) -> DataFrame:
    """sample_id, v: the matrix logarithm of each sample's covariance matrix, shrunk towards its mean variance: the
    upper triangle by rows, off-diagonal entries times the square root of 2, so that distances of these vectors are
    distances of the matrices. A sample's matrix, channels squared, is one task's."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        n = int(group["d"].max()) + 1
        m = np.zeros((n, n))
        m[group["c"], group["d"]] = m[group["d"], group["c"]] = group["cov"]
        m = (1 - shrink) * m + shrink * max(np.trace(m) / n, 1e-12) * np.eye(n)
        values, vectors = np.linalg.eigh(m)
        logs = (vectors * np.log(np.maximum(values, 1e-12))) @ vectors.T
        upper = np.triu_indices(n)
        return pd.DataFrame({"sample_id": group["sample_id"].iloc[:1], "v": [logs[upper] * np.where(upper[0] == upper[1], 1.0, np.sqrt(2.0))]})

    kind = panel.schema["sample_id"].dataType.simpleString()
    return covariances(panel).groupBy("sample_id").applyInPandas(run, f"sample_id {kind}, v array<double>")


def tangent_features(logs: DataFrame, targets: DataFrame) -> DataFrame:
    """sample_id, tangent (the vector less the mean of all), label, distance: the class of nearest mean in the space of
    logarithms."""
    cells = logs.join(targets, "sample_id").select("sample_id", "target", F.posexplode("v").alias("d", "x"))
    mean = F.array_sort(F.collect_list(F.struct("d", "m")))
    whole = cells.groupBy("d").agg(F.avg("x").alias("m")).agg(F.transform(mean, lambda x: x["m"]).alias("mean"))
    each = cells.groupBy("target", "d").agg(F.avg("x").alias("m")).groupBy(F.col("target").alias("label")).agg(F.transform(mean, lambda x: x["m"]).alias("c"))
    centres = each.agg(F.collect_list(F.struct("label", "c")).alias("centres"))

    def far_from(c: Column) -> Column:
        return F.struct(F.sqrt(_sum(F.zip_with("v", c["c"], lambda x, y: (x - y) * (x - y)))).alias("distance"), c["label"].alias("label"))

    rows = logs.join(F.broadcast(whole)).join(F.broadcast(centres))
    nearest = F.array_min(F.transform("centres", far_from))
    return rows.select("sample_id", F.zip_with("v", "mean", lambda x, y: x - y).alias("tangent"), nearest["label"].alias("label"), nearest["distance"].alias("distance"))
