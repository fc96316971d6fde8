"""Kernels over all rows of a panel by landmarks, weights of several kernels, and a one-class detector.

A kernel matrix of n rows is never formed. Landmark features z (Nystroem) stand for it: K is about Z Z', so that inner
products of centred kernels, with each other and with the targets', are norms of (landmarks x landmarks) sums that one
pass over the rows gives. Null vectors take no part, nulls within one count as 0; rows without a target count for
the kernels and not for their alignment."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronolake.operators.lowrank import block, plain, width_of

#: Most landmarks; what the driver solves has so many rows for each kernel.
MOST_LANDMARKS = 1024


def kernel_block(a: np.ndarray, b: np.ndarray, name: str, gamma: float) -> np.ndarray:
    """Kernel values of the rows of ``a`` with those of ``b``."""
    products = a @ b.T
    if name == "linear":
        return products
    if name == "poly":
        return (gamma * products + 1) ** 2
    squares = np.maximum((a * a).sum(axis=1)[:, None] - 2 * products + (b * b).sum(axis=1)[None, :], 0)
    if name == "rbf":
        return np.exp(-gamma * squares)
    if name == "laplace":
        return np.exp(-gamma * np.sqrt(squares))
    raise ValueError(f"unknown kernel {name}")


def landmarks(panel: DataFrame, n: int = 32, seed: int = 1) -> tuple[list, np.ndarray]:
    """Ids and vectors of the ``n`` rows of least hash."""
    if n > MOST_LANDMARKS:
        raise ValueError(f"at most {MOST_LANDMARKS} landmarks")
    rows = plain(panel)
    width = width_of(rows)
    found = rows.orderBy(F.xxhash64(F.lit(seed), "sample_id"), "sample_id").limit(n).collect()
    return [r["sample_id"] for r in found], block(pd.Series([r["values"] for r in found], dtype=object), width)


def first_landmarks(panel: DataFrame, n: int) -> tuple[list, np.ndarray]:
    """Ids and vectors of the ``n`` rows of least id."""
    rows = plain(panel)
    found = rows.orderBy("sample_id").limit(n).collect()
    return [r["sample_id"] for r in found], block(pd.Series([r["values"] for r in found], dtype=object), width_of(rows))


def landmark_kernel(panel: DataFrame, ids: list, marks: np.ndarray, name: str, gamma: float = 1.0) -> DataFrame:
    """i, j, k: every row with every landmark."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            k = kernel_block(block(batch["values"], marks.shape[1]), marks, name, gamma)
            yield pd.DataFrame({"i": batch["sample_id"].repeat(len(ids)), "j": ids * len(batch), "k": k.ravel()})

    kind = panel.schema["sample_id"].dataType.simpleString()
    return plain(panel).mapInPandas(run, f"i {kind}, j {kind}, k double")


def centred_landmarks(matrix: DataFrame) -> DataFrame:
    """i, j, k: ``landmark_kernel`` less the means of its rows and of its landmarks, plus the mean of all. Row means come
    from a row's own values, landmarks' from an aggregate of bounded size."""
    by_mark = matrix.groupBy("j").agg(F.avg("k").alias("c"))
    total = by_mark.agg(F.avg("c").alias("m"))
    mean = F.avg("k").over(Window.partitionBy("i"))
    rows = matrix.select("i", "j", "k", mean.alias("r")).join(F.broadcast(by_mark), "j").join(F.broadcast(total))
    return rows.select("i", "j", (F.col("k") - F.col("r") - F.col("c") + F.col("m")).alias("k"))


def clipped_root(gram: np.ndarray, least: float = 1e-10) -> np.ndarray:
    """G with G G' the pseudo-inverse of the nearest positive semidefinite matrix: eigenvalues below ``least`` of the
    largest go."""
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    keep = values > least * max(values.max(initial=0.0), 1e-300)
    return vectors[:, keep] / np.sqrt(values[keep])


@dataclass
class KernelProducts:
    """Names of kernels, rows seen, and between all landmark features and class indicators the centred sums of
    products over the rows."""

    names: list[str]
    n: int
    sums: np.ndarray
    parts: list[slice]

    def inner(self, a: int, b: int) -> float:
        """Inner product of two centred kernel matrices; the targets' comes last."""
        return float((self.sums[self.parts[a], self.parts[b]] ** 2).sum())

    def likeness(self, a: int, b: int) -> float:
        own = self.inner(a, a) * self.inner(b, b)
        return self.inner(a, b) / own**0.5 if own > 1e-24 else 0.0

    def complexity(self, a: int) -> float:
        """The trace over the norm: the root of an effective rank."""
        trace, norm = float(np.trace(self.sums[self.parts[a], self.parts[a]])), self.inner(a, a)
        return trace / norm**0.5 if norm > 1e-24 else 0.0


def kernel_products(panel: DataFrame, kernels: dict[str, tuple[str, float]], marks: np.ndarray, whole: bool = True) -> KernelProducts:
    """One pass over all rows that have a target, whose classes are at most ``MOST_LANDMARKS``. ``whole`` false: the
    kernel values with the landmarks are the features as they are (the empirical kernel map)."""
    classes = [r["target"] for r in panel.where("target IS NOT NULL").select("target").distinct().orderBy("target").limit(MOST_LANDMARKS + 1).collect()]
    if len(classes) > MOST_LANDMARKS:
        raise ValueError("more classes than landmarks are allowed")
    roots = {n: clipped_root(kernel_block(marks, marks, *k)) if whole and len(marks) else np.eye(len(marks)) for n, k in kernels.items()}
    sizes = [*(r.shape[1] for r in roots.values()), len(classes)]
    ends = np.cumsum([0, *sizes])
    width = int(ends[-1]) + 1

    def features(batch: pd.DataFrame) -> np.ndarray:
        x = block(batch["values"], marks.shape[1])
        z = [kernel_block(x, marks, *kernels[n]) @ roots[n] for n in kernels]
        own = (batch["target"].to_numpy()[:, None] == np.array(classes)[None, :]).astype("float64")
        return np.hstack([*z, own, np.ones((len(batch), 1))])

    rows = plain(panel, "target").where("target IS NOT NULL").select("values", "target")
    total = _summed(rows, features, width) if classes and len(marks) else np.zeros((width, width))
    n, means = total[-1, -1], total[-1, :-1]
    sums = total[:-1, :-1] - np.outer(means, means) / n if n else total[:-1, :-1]
    return KernelProducts(list(kernels), int(n), sums, [slice(int(a), int(b)) for a, b in zip(ends, ends[1:], strict=False)])


def _summed(rows: DataFrame, features, width: int) -> np.ndarray:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width, width))
        for batch in batches:
            if len(batch):
                z = features(batch)
                total += z.T @ z
        yield pd.DataFrame({"cell": np.arange(width * width), "x": total.ravel()})

    cells = rows.mapInPandas(run, "cell long, x double").groupBy("cell").agg(F.sum("x").alias("x")).toPandas()
    out = np.zeros(width * width)
    out[cells["cell"].to_numpy()] = cells["x"].to_numpy()
    return out.reshape(width, width)


def on_simplex(x: np.ndarray) -> np.ndarray:
    """The nearest point with no negative entries and sum 1."""
    u = np.sort(x)[::-1]
    top = (np.cumsum(u) - 1) / np.arange(1, len(u) + 1)
    return np.maximum(x - top[np.flatnonzero(u > top)[-1]], 0)


def kernel_weights(products: KernelProducts, complexity: float = 0.01, redundancy: float = 0.05, least: float = 0.05, steps: int = 100, rate: float = 0.2) -> pd.DataFrame:
    """kernel, alignment, complexity, redundancy (mean likeness to the others), weight: the weights on the simplex that
    make most of sum(w * (alignment - penalty * complexity)) - penalty * w' R w, R the kernels' likeness to each other
    (0 with themselves), by projected gradient; those below ``least`` go and the rest is scaled."""
    q = len(products.names)
    like = np.array([[products.likeness(a, b) if a != b else 0.0 for b in range(q)] for a in range(q)]).reshape(q, q)
    align = np.array([max(0.0, products.likeness(a, q)) for a in range(q)])
    size = np.array([products.complexity(a) for a in range(q)])
    w = np.full(q, 1 / max(1, q))
    for _ in range(steps if q else 0):
        new = on_simplex(w + rate * (align - complexity * size - 2 * redundancy * like @ w))
        if np.abs(new - w).max() < 1e-9:
            break
        w = new
    if q and (w >= least).any():
        w = np.where(w >= least, w, 0.0)
        w = w / w.sum()
    return pd.DataFrame({"kernel": products.names, "alignment": align, "complexity": size, "redundancy": like.sum(axis=1) / max(1, q - 1), "weight": w})


@dataclass
class OneClass:
    """A hyperplane w * z = rho in random Fourier features z of scaled columns; ``gap``: how far at most its objective is
    from the best."""

    columns: list[str]
    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    w: np.ndarray
    rho: float
    gap: float

    def features(self, batch: pd.DataFrame) -> np.ndarray:
        x = np.nan_to_num((batch[self.columns].to_numpy("float64") - self.mean) / self.scale)
        return np.sqrt(2 / len(self.phases)) * np.cos(x @ self.directions + self.phases)


def one_class(points: DataFrame, columns: list[str], nu: float = 0.05, features: int = 128, rounds: int = 12, seed: int = 9) -> OneClass:
    """A one-class support vector machine with a Gaussian kernel (gamma: one over the number of columns, scaled to
    deviation 1) on all rows. Its dual spreads weight over the rows, at most 1 / (nu * n) each: every round moves w
    towards the mean of the nu * n rows that score least, by the best step between (Frank and Wolfe). A round is a
    quantile and a mean, each by partial aggregates; nothing else leaves the tasks. Nulls count as a column's mean."""
    plain_rows = points.select(*[F.col(c).cast("double").alias(c) for c in columns]).persist()
    try:
        stats = plain_rows.agg(*[f(c).alias(f"{i}_{c}") for c in columns for i, f in enumerate((F.avg, F.stddev_pop))]).first()
        mean = np.array([stats[f"0_{c}"] or 0.0 for c in columns])
        scale = np.array([stats[f"1_{c}"] or 1.0 for c in columns])
        rng = np.random.default_rng(seed)
        model = OneClass(columns, mean, scale, rng.normal(scale=np.sqrt(2 / len(columns)), size=(len(columns), features)), rng.uniform(0, 2 * np.pi, features), np.zeros(features), 0.0, 0.0)
        model.w = _mean_features(plain_rows, model, None)
        for _ in range(rounds):
            model.rho = _quantile(plain_rows, model, nu)
            toward = _mean_features(plain_rows, model, model.rho)
            apart = model.w - toward
            model.gap = float(model.w @ apart)
            size = float(apart @ apart)
            if size < 1e-18 or model.gap <= 1e-9:
                break
            model.w = model.w - min(1.0, max(0.0, model.gap / size)) * apart
        model.rho = _quantile(plain_rows, model, nu)
    finally:
        plain_rows.unpersist()
    return model


def _scores(rows: DataFrame, model: OneClass) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"s": model.features(batch) @ model.w})

    return rows.mapInPandas(run, "s double")


def _quantile(rows: DataFrame, model: OneClass, nu: float) -> float:
    return float(_scores(rows, model).agg(F.percentile_approx("s", F.lit(nu), 10_000)).first()[0] or 0.0)


def _mean_features(rows: DataFrame, model: OneClass, most: float | None) -> np.ndarray:
    """The mean of z over the rows that score ``most`` at most, or over all."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(len(model.w)), 0
        for batch in batches:
            z = model.features(batch)
            z = z if most is None else z[z @ model.w <= most]
            total, n = total + z.sum(axis=0), n + len(z)
        yield pd.DataFrame({"k": np.arange(-1, len(total)), "x": np.r_[float(n), total]})

    sums = rows.mapInPandas(run, "k long, x double").groupBy("k").agg(F.sum("x").alias("x")).toPandas().sort_values("k")["x"].to_numpy()
    return sums[1:] / max(1.0, sums[0]) if len(sums) else np.zeros(len(model.w))


def one_class_scores(points: DataFrame, model: OneClass) -> DataFrame:
    """``points`` with score: rho - w * z, above 0 outside; one pass without a shuffle."""

    @F.pandas_udf("double")
    def score(*series: pd.Series) -> pd.Series:
        return pd.Series(model.rho - model.features(pd.DataFrame(dict(zip(model.columns, series, strict=True)))) @ model.w)

    return points.withColumn("score", score(*[F.col(c).cast("double") for c in model.columns]))
