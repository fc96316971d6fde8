"""Feature tables from generators by name or function, their reduction, normalisers fitted on training rows, and
metrics by name or function.

A generator takes series (long) and gives one row a series; a metric takes two columns and gives an aggregate. Both
can be registered under a name, or passed as they are."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.ml.feature import PCA, StandardScaler, StandardScalerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolake.operators import features

Generator = Callable[[DataFrame], DataFrame]
Metric = Callable[[Column, Column], Column]

GENERATORS: dict[str, Generator] = {
    "basic": features.basic,
    "moments": features.moments,
    "peaks": features.peak_features,
    "sequence": features.sequence_features,
    "entropy": features.entropy,
    "benford": features.benford,
    "all": features.all_features,
}
METRICS: dict[str, Metric] = {
    "mae": lambda y, p: F.avg(F.abs(y - p)),
    "rmse": lambda y, p: F.sqrt(F.avg((y - p) * (y - p))),
    "bias": lambda y, p: F.avg(p - y),
    "accuracy": lambda y, p: F.avg((y == p).cast("double")),
}


def _named(given: str | Callable, known: dict, what: str) -> tuple[str, Callable]:
    if callable(given):
        return getattr(given, "__name__", "custom").strip("<>"), given
    if given not in known:
        raise ValueError(f"unknown {what} {given}; known: {', '.join(sorted(known))}")
    return given, known[given]


def register_generator(name: str, make: Generator) -> None:
    GENERATORS[name] = make


def register_metric(name: str, make: Metric) -> None:
    METRICS[name] = make


def feature_table(long: DataFrame, generators: list[str | Generator]) -> DataFrame:
    """series_id and the columns of all generators, each with its generator's name before it; nulls and NaN as 0. A series
    that a generator leaves out has zeros there. Functions of one name are numbered from the second on."""
    parts, seen = [long.select("series_id").distinct()], {}
    for given in generators:
        name, make = _named(given, GENERATORS, "generator")
        seen[name] = seen.get(name, 0) + 1
        name = name if seen[name] == 1 else f"{name}{seen[name]}"
        found = make(long)
        parts.append(found.select("series_id", *[F.col(c).cast("double").alias(f"{name}_{c}") for c in found.columns if c != "series_id"]))
    both = reduce(lambda a, b: a.join(b, "series_id", "left"), parts)
    return both.select("series_id", *[F.coalesce(F.nanvl(F.col(c), F.lit(0.0)), F.lit(0.0)).alias(c) for c in both.columns if c != "series_id"])


def aligned(table: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``table`` with these columns alone, in this order; those that it lacks are 0."""
    return table.select(key, *[F.col(c) if c in table.columns else F.lit(0.0).alias(c) for c in columns])


@dataclass
class Reduction:
    """Scaling to mean 0 and deviation 1, and the leading principal components of what it gives."""

    key: str
    columns: list[str]
    scaler: StandardScalerModel
    vectors: np.ndarray
    ratios: np.ndarray

    def transform(self, table: DataFrame) -> DataFrame:
        """key, c0, c1, ...: of a table that may lack columns or have more."""
        rows = VectorAssembler(inputCols=self.columns, outputCol="_raw").transform(aligned(table, self.key, self.columns))
        x = vector_to_array("_x")
        rows = self.scaler.transform(rows).select(self.key, x.alias("_x"))
        parts = [F.aggregate(F.zip_with("_x", F.array(*map(F.lit, v)), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b) for v in self.vectors.T.tolist()]
        return rows.select(self.key, *[p.alias(f"c{i}") for i, p in enumerate(parts)])


def reduction(table: DataFrame, key: str, share: float = 0.975, least: float = 0.0) -> Reduction:
    """Fitted by Spark ML on all rows: the fewest components that explain ``share`` of the variance, each more than
    ``least`` of it. A component's largest part is positive."""
    columns = [c for c in table.columns if c != key]
    rows = VectorAssembler(inputCols=columns, outputCol="_raw").transform(table)
    scaler = StandardScaler(inputCol="_raw", outputCol="_x", withMean=True).fit(rows)
    model = PCA(k=len(columns), inputCol="_x", outputCol="_p").fit(scaler.transform(rows))
    ratios, vectors = np.array(model.explainedVariance), model.pc.toArray()
    n = int(np.searchsorted(np.cumsum(ratios), share * ratios.sum() * (1 - 1e-12))) + 1
    n = max(1, min(n, int((ratios > least).sum()) or 1))
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(columns))])
    return Reduction(key, columns, scaler, vectors[:, :n], ratios[:n])


def best_table(tables: dict[str, DataFrame], key: str, least: float = 0.05) -> tuple[str, dict[str, Reduction]]:
    """The table whose components of more than ``least`` of its variance explain most together (the first among equals),
    and all tables' reductions to these."""
    found = {name: reduction(t, key, 1.0, least) for name, t in tables.items()}
    return max(found, key=lambda n: float(found[n].ratios[found[n].ratios > least].sum())), found


def discriminative(table: DataFrame, model: Reduction, level: float = 0.8) -> DataFrame:
    """component, column, correlation: the columns that correlate with a component beyond ``level`` either way; one
    aggregate over the table."""
    rows = table.join(model.transform(table), model.key)
    n = model.vectors.shape[1]
    pairs = [(i, c) for i in range(n) for c in model.columns]
    one = rows.agg(F.array(*[F.struct(F.lit(i).alias("component"), F.lit(c).alias("column"), features.pearson(F.col(c), F.col(f"c{i}")).alias("correlation")) for i, c in pairs]).alias("x"))
    return one.select(F.inline("x")).where(F.abs("correlation") > level)


#: Normalisers: what they need of a column over the training rows, and what they make of its values then.
STEPS: dict[str, tuple[Callable[[Column], list[Column]], Callable[[Column, list[Column]], Column]]] = {
    "standard": (lambda c: [F.avg(c), F.stddev_pop(c)], lambda c, s: (c - s[0]) / F.greatest(s[1], F.lit(1e-6))),
    "min_max": (lambda c: [F.min(c), F.max(c)], lambda c, s: (c - s[0]) / F.greatest(s[1] - s[0], F.lit(1e-6))),
    "robust": (lambda c: [F.percentile(c, F.lit(0.5)), F.percentile(c, F.lit(0.75)) - F.percentile(c, F.lit(0.25))], lambda c, s: (c - s[0]) / F.greatest(s[1], F.lit(1e-6))),
    "log1p": (lambda c: [], lambda c, s: F.when(c.isNotNull(), F.log1p(F.greatest(c, F.lit(0.0))))),
}


@dataclass
class Normaliser:
    """Steps of each modality (the columns that it names), with the numbers that its training rows gave."""

    steps: dict[str, list[tuple[str, dict[str, list[float]]]]]

    def transform(self, table: DataFrame) -> DataFrame:
        for steps in self.steps.values():
            for name, state in steps:
                table = table.withColumns({c: STEPS[name][1](F.col(c).cast("double"), [F.lit(x) for x in s]) for c, s in state.items()})
        return table


def normaliser(train: DataFrame, modalities: dict[str, tuple[list[str], list[str]]]) -> Normaliser:
    """Fits each modality's steps in turn, every one on what the one before makes of the training rows: modality ->
    (columns, steps). A column without training values has 0 in place of what isn't there."""
    done: dict[str, list[tuple[str, dict[str, list[float]]]]] = {}
    for modality, (columns, names) in modalities.items():
        done[modality] = []
        for name in names:
            if name not in STEPS:
                raise ValueError(f"unknown step {name}")
            needs = {c: STEPS[name][0](F.col(c).cast("double")) for c in columns}
            wanted = [x.alias(f"{i}_{k}") for i, (c, xs) in enumerate(needs.items()) for k, x in enumerate(xs)]
            row = Normaliser({modality: done[modality]}).transform(train).agg(*wanted).first() if wanted else {}
            done[modality].append((name, {c: [float(row[f"{i}_{k}"] or 0.0) for k in range(len(xs))] for i, (c, xs) in enumerate(needs.items())}))
    return Normaliser(done)


def evaluated(table: DataFrame, y: str, p: str, metrics: list[str | Metric], keys: list[str] | None = None) -> DataFrame:
    """A column for each metric, by name or function, over ``keys`` (or all rows)."""
    found = [(n, m(F.col(y), F.col(p))) for n, m in (_named(g, METRICS, "metric") for g in metrics)]
    return table.groupBy(*(keys or [])).agg(*[c.alias(n) for n, c in found])
