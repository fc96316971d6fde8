"""Approximate nearest neighbours by cosine: inverted lists, product-quantised residuals, exact reranking.

Fit, on a bounded sample (``SAMPLE_ROWS`` rows with the smallest hash of their id): coarse centroids by
spherical k-means, codebooks for each slice of the residuals, and the number of lists a query must
visit so that ``TARGET_RECALL`` of the sample's true neighbours are found.

Index: every row is filed under its nearest centroid with the code of its residual and the length of
what the code leaves out. Search: each query visits its nearest lists; there a table of inner products
of the query's slices with the codebooks (asymmetric: the query isn't quantised) gives each row's
score from its code, correct to within the length left out. Rows that these bounds show can't be among
the list's k best are skipped, the others are scored exactly, in double precision on the original
vectors; a ranked window over the lists' results gives the k best. There is no cap on candidates: where
many rows look alike to the codes, all are reranked.

Lists are split into blocks of bounded size, as are the queries that visit a list, so a list that holds
a third of all rows is many tasks. What is broadcast is bounded by the parameters below.

Defined cases: vectors that are null, zero, or hold null or non-finite components, and rows without an
id take no part; rows that repeat id and vector are kept as one with a number, yet each asks and each answers; a
query's candidates are all rows but itself, other rows of its id included, and rows of one id ask apart; vectors
are scaled by powers of two, so that no component is too large or small; shorter vectors are padded with zeros; fewer candidates than k: all that were found; an
empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolake.llm.common import Scratch, k_means, squared
from chronolake.llm.vectors import best, matrix, top_of, usable

#: Rows that centroids and codebooks are fitted on.
SAMPLE_ROWS = 16_384
#: Most inverted lists, whatever the number of rows.
MOST_LISTS = 4_096
SLICES, CODES = 16, 256
TARGET_RECALL = 0.97
#: Most rows, and most queries, that meet in one task's block.
BLOCK_ROWS, BLOCK_QUERIES = 8_192, 1_024
STEP = 64


@dataclass
class Coder:
    """Coarse centroids (unit length), codebooks by slice, and how many lists a query visits."""

    centroids: np.ndarray
    books: np.ndarray
    visits: int

    @property
    def dims(self) -> int:
        return self.books.shape[0] * self.books.shape[2]

    def lists(self, unit: np.ndarray, n: int) -> np.ndarray:
        """The n nearest lists of each vector, nearest first."""
        near = -(unit @ self.centroids.T)
        if n == 1:
            return near.argmin(axis=1)[:, None]
        return np.argsort(near, axis=1, kind="stable")[:, :n]

    def encode(self, unit: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals, and the length of what they leave out."""
        rest = unit - self.centroids[lists]
        codes, left = np.empty((len(unit), len(self.books)), "uint8"), np.zeros(len(unit))
        for m, part in enumerate(np.split(rest, len(self.books), axis=1)):
            far = squared(part, self.books[m])
            codes[:, m] = far.argmin(axis=1)
            left += ((part - self.books[m][codes[:, m]]) ** 2).sum(axis=1)
        return codes, np.sqrt(left)


def scaled(data: np.ndarray) -> np.ndarray:
    """Each row times the power of two that brings its largest component near 1: its cosines stay as they are,
    and no square overflows or vanishes."""
    return np.ldexp(data, -np.frexp(np.abs(data).max(axis=1, keepdims=True))[1])


def unit_rows(data: np.ndarray) -> np.ndarray:
    data = scaled(data)
    return data / np.sqrt((data * data).sum(axis=1, keepdims=True))


def fit(sample: np.ndarray, n_rows: int, k: int, seed: int = 11) -> Coder:
    """A coder for ``n_rows`` rows from a sample of unit vectors (its columns a multiple of SLICES)."""
    n_lists = max(1, min(MOST_LISTS, len(sample), int(math.sqrt(n_rows) / 2)))
    centroids = k_means(sample, n_lists, 8, seed, True)
    rest = sample - centroids[(sample @ centroids.T).argmax(axis=1)]
    books = np.stack([k_means(part, CODES, 6, seed + m, False) for m, part in enumerate(np.split(rest, SLICES, axis=1))])
    coder = Coder(centroids, books, n_lists)
    asked = sample[:256]
    scores = asked @ sample.T
    np.fill_diagonal(scores[:, : len(asked)], -2)
    true = np.argsort(-scores, axis=1)[:, : min(k, len(sample) - 1)]
    home = coder.lists(sample, 1)[:, 0]
    order = coder.lists(asked, n_lists)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(n_lists)[None, :].repeat(len(asked), 0), axis=1)
    needed = np.take_along_axis(place, home[true], axis=1)
    if needed.size:
        coder.visits = min(n_lists, int(np.quantile(needed, TARGET_RECALL, method="higher")) + 1)
    return coder


def nearest(table: DataFrame, queries_of: str, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of the rows that satisfy ``queries_of``."""
    spark = table.sparkSession
    rows = usable(table, zero_too=False)
    shape = rows.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("d")).first()
    if not shape["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims = -(-shape["d"] // SLICES) * SLICES
    sample = rows.orderBy(F.xxhash64("vec_id", "embedding")).limit(SAMPLE_ROWS).toPandas()
    coder = fit(unit_rows(matrix(sample["embedding"], dims, "float64")), shape["n"], k)
    shared = spark.sparkContext.broadcast(coder)

    def file(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = shared.value
        for batch in batches:
            if len(batch):
                unit = unit_rows(matrix(batch["embedding"], dims, "float64"))
                home = coder.lists(unit, 1)[:, 0]
                codes, left = coder.encode(unit, home)
                yield batch.assign(list_id=home.astype("int32"), code=[c.tobytes() for c in codes], left_out=left)

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = shared.value
        for batch in batches:
            if len(batch):
                lists = coder.lists(unit_rows(matrix(batch["embedding"], dims, "float64")), coder.visits)
                yield batch.assign(list_id=list(lists.astype("int32")))

    element = table.schema["embedding"].dataType.simpleString()
    scratch = Scratch(spark)
    filed = scratch.store(rows.mapInPandas(file, f"vec_id long, row long, times long, embedding {element}, list_id int, code binary, left_out double"), "filed")
    visits = rows.where(queries_of).mapInPandas(visit, f"vec_id long, row long, times long, embedding {element}, list_id array<int>")
    visits = scratch.store(visits, "visits").withColumn("list_id", F.explode("list_id"))

    # blocks: counts by list are bounded by MOST_LISTS
    sizes = filed.groupBy("list_id").agg(F.count("*").alias("n"))
    asked = visits.groupBy("list_id").agg(F.count("*").alias("q"))
    blocks = F.broadcast(
        sizes.join(asked, "list_id").select(
            "list_id", F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("nr"), F.ceil(F.col("q") / BLOCK_QUERIES).cast("int").alias("nq")
        )
    )

    def dealt(n: str) -> F.Column:
        return F.pmod(F.xxhash64("row"), F.col(n)).cast("int")

    def every(n: str) -> F.Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    left = filed.join(blocks, "list_id").withColumn("r", dealt("nr")).withColumn("q", every("nq")).drop("nr", "nq")
    right = visits.join(blocks, "list_id").withColumn("q", dealt("nq")).withColumn("r", every("nr")).drop("nr", "nq")

    def search(block: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(block) and len(asked):
            coder = shared.value
            ids, own, times, data = block["vec_id"].to_numpy(), block["row"].to_numpy(), block["times"].to_numpy(), scaled(matrix(block["embedding"], dims, "float64"))
            codes = np.frombuffer(b"".join(block["code"]), "uint8").reshape(len(ids), -1)
            slack = block["left_out"].to_numpy() + 1e-9
            norms = np.sqrt((data * data).sum(axis=1))
            centroid = coder.centroids[int(block["list_id"].iloc[0])]
            names, rows_of, wanted = asked["vec_id"].to_numpy(), asked["row"].to_numpy(), scaled(matrix(asked["embedding"], dims, "float64"))
            asked_times = asked["times"].to_numpy()
            units = unit_rows(wanted)
            for at in range(0, len(names), STEP):
                part = units[at : at + STEP]
                guess = np.repeat((part @ centroid)[:, None], len(ids), axis=1)
                for m, slices in enumerate(np.split(part, len(coder.books), axis=1)):
                    guess += (slices @ coder.books[m].T)[:, codes[:, m]]
                for i, name in enumerate(names[at : at + STEP]):
                    places = np.flatnonzero((own != rows_of[at + i]) | (times > 1))
                    if len(places) > k:
                        low = guess[i, places] - slack[places]
                        bar = np.partition(low, len(low) - k)[len(low) - k]
                        places = places[guess[i, places] + slack[places] >= bar]
                    query = wanted[at + i]
                    scores = (data[places] * query).sum(axis=1) / (norms[places] * math.sqrt((query * query).sum()))
                    top = top_of(scores, ids[places], k)
                    hit = places[top]
                    found = {"query_id": name, "query_row": rows_of[at + i], "asked": asked_times[at + i], "vec_id": ids[hit], "score": scores[top], "times": times[hit] - (own[hit] == rows_of[at + i])}
                    out.append(pd.DataFrame(found))
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in ("query_id", "query_row", "asked", "vec_id", "score", "times")})

    keys = ["list_id", "r", "q"]
    hits = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(search, "query_id long, query_row long, asked long, vec_id long, score double, times long")
    return scratch.finish(best(hits, k), "nearest")
