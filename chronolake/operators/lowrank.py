"""Low-rank models of a table of vectors (sample_id, values): randomised singular values, and sampled rows and columns.

The table is only ever read by row blocks; what tasks hand over, and the driver solves, is (columns x sketch) or
smaller. All vectors have one length (a shorter one counts as padded with zeros); null vectors take no part; nulls
and values that aren't finite count as 0. An empty table gives empty results."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most columns of a table: what the driver solves has so many rows.
MOST_COLUMNS = 16_384


def plain(table: DataFrame, *carried: str) -> DataFrame:
    clean = F.transform("values", lambda x: F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), x.cast("double")).otherwise(0.0))
    return table.where(F.col("values").isNotNull()).select("sample_id", clean.alias("values"), *carried)


def width_of(table: DataFrame) -> int:
    width = int(table.agg(F.max(F.size("values"))).first()[0] or 0)
    if width > MOST_COLUMNS:
        raise ValueError(f"more than {MOST_COLUMNS} columns")
    return width


def block(column: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(column), width))
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def summed(table: DataFrame, make: Callable[[np.ndarray], np.ndarray], width: int, shape: tuple[int, int]) -> np.ndarray:
    """The sum over row blocks of ``make(block)``, a matrix of ``shape``: each task adds up its blocks, and cells meet in
    an aggregate."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(shape)
        for batch in batches:
            if len(batch):
                total += make(block(batch["values"], width))
        yield pd.DataFrame({"cell": np.arange(total.size), "x": total.ravel()})

    cells = table.select("values").mapInPandas(run, "cell long, x double").groupBy("cell").agg(F.sum("x").alias("x")).toPandas()
    out = np.zeros(shape[0] * shape[1])
    out[cells["cell"].to_numpy()] = cells["x"].to_numpy()
    return out.reshape(shape)


@dataclass
class Svd:
    """Singular values, largest first, and right vectors (as rows) of a table of ``width`` columns."""

    values: np.ndarray
    vectors: np.ndarray
    norm: float

    @property
    def stable_rank(self) -> float:
        """The squared norm of the table over its largest squared singular value."""
        return self.norm / float(self.values[0] ** 2) if len(self.values) and self.values[0] > 0 else 0.0


def randomised_svd(table: DataFrame, rank: int, more: int = 8, rounds: int = 3, seed: int = 5) -> Svd:
    """Range finder with power iteration: a random sketch of ``rank`` + ``more`` directions goes through the table's
    products ``rounds`` times, each time one pass and an orthonormal basis of (columns x sketch); then the table's
    products on that basis are solved."""
    rows = plain(table)
    width = width_of(rows)
    k = min(rank + more, width)
    if not k:
        return Svd(np.empty(0), np.empty((0, 0)), 0.0)
    z = np.linalg.qr(np.random.default_rng(seed).normal(size=(width, k)))[0]
    for _ in range(rounds):
        z = np.linalg.qr(summed(rows, lambda a, z=z: a.T @ (a @ z), width, (width, k)))[0]
    gram = summed(rows, lambda a: np.vstack([(a @ z).T @ (a @ z), np.r_[(a * a).sum(), np.zeros(k - 1)]]), width, (k + 1, k))
    squares, turns = np.linalg.eigh((gram[:k] + gram[:k].T) / 2)
    vectors = (z @ turns[:, ::-1]).T[:rank]
    vectors = vectors * np.sign(vectors[np.arange(len(vectors)), np.abs(vectors).argmax(axis=1)])[:, None]
    return Svd(np.sqrt(np.maximum(squares[::-1], 0))[:rank], vectors, float(gram[k, 0]))


def sketched_rank(n: int, tolerance: float = 0.5) -> int:
    """Directions that keep the distances of ``n`` points within ``tolerance`` (Johnson and Lindenstrauss), at most n."""
    if n < 2:
        return n
    return min(n, int(4 * np.log(n) / (tolerance**2 / 2 - tolerance**3 / 3)))


def left_scores(table: DataFrame, svd: Svd) -> DataFrame:
    """sample_id, component, score: each row on the right vectors; one pass, no shuffle."""
    width = svd.vectors.shape[1] if svd.vectors.size else 0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            scores = block(batch["values"], width) @ svd.vectors.T
            yield pd.DataFrame({"sample_id": batch["sample_id"].repeat(scores.shape[1]), "component": np.tile(np.arange(scores.shape[1]), len(batch)), "score": scores.ravel()})

    kind = table.schema["sample_id"].dataType.simpleString()
    return plain(table).mapInPandas(run, f"sample_id {kind}, component long, score double")


@dataclass
class Cur:
    """Sampled columns (their places), sampled rows (their ids, and their values as a matrix), and the pseudo-inverse of
    where they cross."""

    columns: list[int]
    rows: list
    values: np.ndarray
    middle: np.ndarray


def cur(table: DataFrame, n_rows: int, n_columns: int, seed: int = 7) -> Cur:
    """Rows and columns drawn without replacement, in proportion to their squared norms: each has the key -ln(u) / norm,
    u a hash of its id, and those of least key are taken, so that one pass draws and no task gathers the table. What
    comes to the driver is the sampled rows. Rows and columns of norm 0 are never drawn."""
    rows = plain(table)
    width = width_of(rows)
    norm = F.aggregate("values", F.lit(0.0), lambda a, x: a + x * x)
    u = (F.pmod(F.xxhash64(F.lit(seed), "sample_id"), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    keyed = rows.select("sample_id", "values", (-F.ln(u) / F.when(norm > 0, norm)).alias("key")).where(F.col("key").isNotNull())
    drawn = keyed.orderBy("key", "sample_id").limit(n_rows).collect()
    by_column = {r["j"]: r["s"] for r in rows.select(F.posexplode("values").alias("j", "x")).groupBy("j").agg(F.sum(F.col("x") * F.col("x")).alias("s")).where("s > 0").collect()}
    chance = np.random.default_rng(seed).exponential(size=width)
    columns = sorted(sorted(by_column, key=lambda j: (chance[j] / by_column[j], j))[:n_columns])
    values = block(pd.Series([r["values"] for r in drawn], dtype=object), width)
    return Cur(columns, [r["sample_id"] for r in drawn], values, np.linalg.pinv(values[:, columns]) if drawn and columns else np.zeros((len(columns), len(drawn))))


def cur_errors(table: DataFrame, model: Cur) -> DataFrame:
    """sample_id, norm, error: each row's squared norm, and that of what columns x middle x rows leaves of it."""
    width = model.values.shape[1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = block(batch["values"], width)
            rest = x - x[:, model.columns] @ model.middle @ model.values
            yield batch[["sample_id"]].assign(norm=(x * x).sum(axis=1), error=(rest * rest).sum(axis=1))

    kind = table.schema["sample_id"].dataType.simpleString()
    return plain(table).mapInPandas(run, f"sample_id {kind}, norm double, error double")
