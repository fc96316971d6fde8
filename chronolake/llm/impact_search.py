"""Exact top-k inner products over an impact-ordered index, score at a time.

Components are integers, floor(1024 * x). Rows are dealt into blocks. A block's postings (row, value), one
for each component that isn't zero, lie in lists by quantised impact and dimension: segment b holds the
lists of the components with 2**b <= |x| < 2**(b+1). Queries (in blocks as well) go through the segments
by descending impact; a list adds its values, times the queries' component in its dimension, to the
scores of its rows, and is passed over where no query has that component. After each segment a row's
score is known up to |query| * |what is left of the row| (Cauchy-Schwarz, with the norms of the remainders
kept in the index), and up to what floating point may have rounded off. Rows whose upper bound lies below the k-th highest lower bound are out; processing
stops when the bounds prove that few rows can still be members, and those alone are scored exactly, in
integers. Each block gives k rows a query; these meet in one ranked window.

Every query meets every block by an equi-join on the block pair: a stated set of queries against all
rows in blocks of bounded size.

Defined cases: null vectors, or ones with null or non-finite components or with one whose integer is no long,
and rows without an id take no part; a score beyond a long counts as the nearest long; rows that repeat id and
vector are kept as one with a number, yet each asks and each answers; a query's candidates are all rows but
itself, other rows of its id included, and rows of one id ask apart; shorter vectors are padded with zeros; fewer candidates than k: all of them; an empty table gives
an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolake.llm.vectors import best, matrix, top_of, usable

SCALE = 1024
#: Most rows and queries in a block.
BLOCK_ROWS, BLOCK_QUERIES = 16_384, 2_048
#: Queries that are scored together in a block.
STEP = 128
_LONG = 1 << 63
#: Processing stops once the possible members are this few, on average, for each wanted row.
FEW = 8


def quantised(table: DataFrame) -> DataFrame:
    """vec_id, row, times and the integer vector."""
    scaled = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE))
    fits = F.forall("embedding", lambda x: F.abs(x.cast("double") * SCALE) < float(_LONG))
    return usable(table, zero_too=True).where(fits).select("vec_id", "row", "times", scaled.alias("vector"))


class ImpactBlock:
    """A block's posting lists in segments by descending impact, with the norms of what follows each."""

    def __init__(self, rows: np.ndarray):
        self.n = len(rows)
        place, dim = np.nonzero(rows)
        value = rows[place, dim].astype("float64")
        bits = np.frexp(np.abs(value))[1]
        order = np.lexsort((dim, -bits))  # rows stay in order within a list
        self.place, self.value, dim, bits = place[order], value[order], dim[order], bits[order]
        starts = np.flatnonzero(np.r_[True, (dim[1:] != dim[:-1]) | (bits[1:] != bits[:-1])]) if len(dim) else np.empty(0, int)
        self.segments: list[list[tuple[int, int, int]]] = []  # of lists: dimension, first and last posting
        last = None
        for low, high in zip(starts.tolist(), [*starts[1:].tolist(), len(dim)], strict=False):
            if bits[low] != last:
                self.segments.append([])
                last = bits[low]
            self.segments[-1].append((int(dim[low]), low, high))
        # From the last segment to the first: sums of squares only grow, and are right but for rounding.
        self.rounding = (rows.shape[1] + 8) * 2.0**-52
        rest, self.left = np.zeros(self.n), []
        for lists in reversed(self.segments):
            self.left.append(np.sqrt(rest) * (1 + self.rounding))
            for _, low, high in lists:
                rest[self.place[low:high]] += self.value[low:high] ** 2
        self.left.reverse()
        self.norms = np.sqrt(rest) * (1 + self.rounding)

    def possible(self, queries: np.ndarray, k: int, own: np.ndarray | None = None) -> list[np.ndarray]:
        """For each query, places of the rows that may be among its k best: proven to hold them all.

        ``own``: by query and row, rows that are no candidates of the query."""
        wide = queries.astype("float64")
        norms = np.sqrt((wide * wide).sum(axis=1)) * (1 + self.rounding)
        known = np.zeros((self.n, len(queries)))
        own = np.zeros((len(queries), self.n), bool) if own is None else own
        may = ~own
        for segment, left in zip(self.segments, self.left, strict=False):
            for dim, low, high in segment:
                if wide[:, dim].any():
                    known[self.place[low:high]] += self.value[low:high, None] * wide[:, dim]
            if self.n <= k:
                continue
            score, slack = known.T, norms[:, None] * (left + self.rounding * self.norms)[None, :] + 0.5
            low, high = (np.clip(x, -_LONG, _LONG) for x in (score - slack, score + slack))  # as the scores are
            least = np.partition(np.where(own, -np.inf, low), self.n - k, axis=1)[:, self.n - k]
            may = (high >= least[:, None]) & ~own
            if may.sum() <= FEW * k * len(queries):
                break
        return [np.flatnonzero(m) for m in may]


def exact_scores(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Integer inner products; those beyond a long as the nearest long."""
    reach = [max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0 for x in (rows, query)]
    if reach[0] * reach[1] * len(query) < _LONG:
        return rows @ query
    return np.array([min(max(x, -_LONG), _LONG - 1) for x in rows.astype(object) @ query.astype(object)], "int64")


def top_k(table: DataFrame, queries_of: str, k: int) -> DataFrame:
    """query_id, rank, vec_id, score of the rows that satisfy the SQL condition ``queries_of``."""
    rows = quantised(table)
    queries = rows.where(queries_of)
    shape = rows.agg(F.count("*").alias("n"), F.count_if(F.expr(queries_of)).alias("q"), F.max(F.size("vector")).alias("d")).first()
    dims = int(shape["d"] or 0)
    cores = table.sparkSession.sparkContext.defaultParallelism
    per_block = min(BLOCK_ROWS, max(1024, shape["n"] // (2 * cores)))
    row_blocks, query_blocks = max(1, -(-shape["n"] // per_block)), max(1, -(-shape["q"] // BLOCK_QUERIES))

    def dealt(n: int) -> F.Column:
        return F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")

    left = rows.withColumn("r", dealt(row_blocks)).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    right = queries.withColumn("q", dealt(query_blocks)).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))))
    kinds = dict.fromkeys(["query_id", "query_row", "asked", "vec_id", "score", "times"], "int64")

    def run(block: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(block) and len(asked):
            ids, names, times, data = block["vec_id"].to_numpy(), block["row"].to_numpy(), block["times"].to_numpy(), matrix(block["vector"], dims, "int64")
            index = ImpactBlock(data)
            for at in range(0, len(asked), STEP):
                part = asked.iloc[at : at + STEP]
                wanted, own = matrix(part["vector"], dims, "int64"), part["row"].to_numpy()
                found = index.possible(wanted, k, (own[:, None] == names[None, :]) & (times == 1)[None, :])
                for name, row, asked_times, query, places in zip(part["vec_id"], own, part["times"], wanted, found, strict=True):
                    scores = exact_scores(data[places], query)
                    top = top_of(scores, ids[places], k)
                    hit = places[top]
                    out.append(pd.DataFrame({"query_id": name, "query_row": row, "asked": asked_times, "vec_id": ids[hit], "score": scores[top], "times": times[hit] - (names[hit] == row)}))
        return pd.concat(out).astype(kinds) if out else pd.DataFrame({c: [] for c in kinds}).astype(kinds)

    hits = left.groupBy("r", "q").cogroup(right.groupBy("r", "q")).applyInPandas(run, ", ".join(f"{c} long" for c in kinds))
    return best(hits, k)


ORACLE = """
WITH d AS (
  SELECT vec_id, embedding FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS n, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM d
), scored AS (
  SELECT q.n, q.vec_id AS query_id, r.vec_id, CAST(list_sum(list_transform(list_zip(q.x, r.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v r ON q.n <> r.n WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS INT) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
