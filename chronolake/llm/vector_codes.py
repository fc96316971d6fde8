"""Product codes of integer vectors, by weighted Lloyd rounds over the distinct parts of each position.

1. Components become integers, floor(scale * x); vectors are cut into equal consecutive parts.
2. Equal parts of a position are one row with a weight (aggregated before the shuffle) and stored: a part that
   a third of all vectors share costs one row in every round.
3. Each round gives every distinct part to the nearest entry of its position's codebook (integer squared
   distance, ties to the lower index). Tasks hand over weighted sums, ``parts`` x ``entries`` rows each; only the
   codebooks, whose size the parameters bound, come to the driver.
4. The last assignment of the distinct parts, with their errors, is stored and joined back to the parts of all
   vectors; both sides of that join come from exchanges of their own, so that Spark can split a hot part.

Sums and distances are exact: 64-bit integers where a bound proves that they fit, else Python's integers.

Defined cases: null vectors, or ones with null or non-finite components, take no part; components beyond a long
count as the nearest long; an error that is no long is null, and so is a sum of errors that holds one; rows
without vec_id are coded and come last in the order that starts the codebooks; rows of one id come in the order
of their vectors; repeated rows all count and all return; fewer rows than ``entries`` give that many entries;
vectors shorter than the longest are padded with zeros, and all up to a multiple of ``parts``; an empty table
gives an empty result; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolake.llm.common import Scratch

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
_LONG = 1 << 63

#: A codebook for each part position: entries as rows of integers.
Books = list[list[list[int]]]


def integer_rows(table: DataFrame, scale: int = SCALE) -> DataFrame:
    """row (a number of its own), vec_id, label, vector (integers) of the rows that take part. To be stored, as
    a recomputation may number rows anew."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    rows = table.select("vec_id", "label", "embedding").where(F.col("embedding").isNotNull() & finite)
    return rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", whole.alias("vector"))


def _pieces(parts: int, width: int) -> Column:
    padded = F.concat("vector", F.array_repeat(F.lit(0).cast("long"), parts * width - F.size("vector")))
    return F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.slice(padded, p * width + 1, width))


def _largest(data: np.ndarray) -> int:
    return max(abs(int(data.max())), abs(int(data.min()))) if data.size else 0


def nearest(data: np.ndarray, book: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry for each row of ``data``, ties to the lower one, and its squared distance."""
    reach = _largest(data) + max((abs(c) for entry in book for c in entry), default=0)
    kind = "int64" if data.shape[1] * reach * reach < _LONG else object
    wide, index, least = data.astype(kind), np.zeros(len(data), "int64"), None
    for i, entry in enumerate(book):
        apart = wide - np.array(entry, kind)
        distance = (apart * apart).sum(axis=1)
        if least is None:
            least = distance
        else:
            closer = (distance < least).astype(bool)
            index[closer], least[closer] = i, distance[closer]
    return index, least


def _weighted_sums(data: np.ndarray, weight: np.ndarray, index: np.ndarray, entries: int) -> tuple[list[int], np.ndarray]:
    """Weight of each entry's rows, and the weighted sums of their components."""
    kind = "int64" if int(weight.sum()) * max(_largest(data), 1) < _LONG else object
    sums, counts = np.zeros((entries, data.shape[1]), kind), np.zeros(entries, "int64")
    np.add.at(sums, index, data.astype(kind) * weight.astype(kind)[:, None])
    np.add.at(counts, index, weight)
    return counts.tolist(), sums.astype(object)


def _by_position(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray, np.ndarray]]:
    """Of each batch and each position in it: the places of its rows, and their parts as a matrix."""
    for batch in batches:
        data = batch["part"].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)
        at = batch["at"].to_numpy()
        for position in np.unique(at).tolist():
            places = np.flatnonzero(at == position)
            yield batch, position, places, data[places]


def _moved(distinct: DataFrame, books: Books, width: int) -> Books:
    """One round: each entry becomes the floored mean of its parts; unused ones stay."""
    entries = len(books[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [[0] * entries for _ in books]
        sums = [np.zeros((entries, width), object) for _ in books]
        for batch, at, places, data in _by_position(batches, width):
            index, _ = nearest(data, books[at])
            n, more = _weighted_sums(data, batch["weight"].to_numpy()[places], index, entries)
            counts[at] = [a + b for a, b in zip(counts[at], n, strict=True)]
            sums[at] = sums[at] + more
        rows = [(a, e, counts[a][e], [Decimal(int(x)) for x in sums[a][e]]) for a in range(len(books)) for e in range(entries) if counts[a][e]]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.decimal128(38, 0))]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["at", "entry", "n", "sums"])

    partial = distinct.mapInArrow(run, "at int, entry int, n long, sums array<decimal(38,0)>")
    # A part without components has its weight alone.
    whole = partial.select("at", "entry", "n", F.posexplode_outer("sums").alias("dim", "s")).groupBy("at", "entry", "dim").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    moved = [[list(entry) for entry in book] for book in books]
    for at, entry, dim, n, s in whole.collect():  # parts x entries x width rows
        if dim is not None:
            moved[at][entry][dim] = int(s) // n
    return moved


def _assigned(distinct: DataFrame, books: Books, width: int) -> DataFrame:
    """at, part, entry, error (null where it is no long) of the distinct parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, at, places, data in _by_position(batches, width):
            index, distance = nearest(data, books[at])
            errors = [x if x < _LONG else None for x in distance.tolist()]
            own = batch.select(["at", "part"]).take(pa.array(places))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(index, pa.int32()), pa.array(errors, pa.int64())], ["at", "part", "entry", "error"])

    return distinct.mapInArrow(run, "at int, part array<long>, entry int, error long")


def encode(table: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, Books]:
    """vec_id, label, codes (an index for each part), error of every row that takes part, stored; the codebooks."""
    spark = table.sparkSession
    scratch = Scratch(spark)
    rows = scratch.store(integer_rows(table, scale), "vectors")
    width = -(-int(rows.agg(F.max(F.size("vector"))).first()[0] or 0) // parts)
    cut = rows.select("row", "vec_id", "label", F.posexplode(_pieces(parts, width)).alias("at", "part"))
    distinct = scratch.store(cut.groupBy("at", "part").agg(F.count("*").alias("weight")), "distinct-parts")
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").select(_pieces(parts, width).alias("p")).limit(entries).collect()
    books: Books = [[list(r["p"][at]) for r in first] for at in range(parts)]
    for _ in range(rounds if first else 0):
        books = _moved(distinct, books, width)
    assigned = scratch.store(_assigned(distinct, books, width), "assigned-parts")
    index = [F.max(F.when(F.col("at") == p, F.col("entry"))).alias(f"e{p}") for p in range(parts)]
    whole = cut.join(assigned, ["at", "part"]).groupBy("row", "vec_id", "label").agg(*index, F.sum(F.col("error").cast("decimal(38,0)")).alias("error"), F.count("error").alias("known"))
    return scratch.finish(whole.select("vec_id", "label", F.array(*[f"e{p}" for p in range(parts)]).alias("codes"), _long("error", F.col("known") == parts)), "codes"), books


def _long(name: str, known: Column) -> Column:
    """The sum ``name`` as a long; null where a part of it is unknown, or where it is none."""
    return F.when(known & (F.col(name) <= _LONG - 1), F.col(name)).cast("long").alias(name)


def decode(codes: DataFrame, books: Books, scale: int = SCALE) -> DataFrame:
    """``codes`` and approximation: the vectors that the codes stand for, in the middle of their integers."""
    known = F.array(*[F.array(*[F.array(*[F.lit((c + 0.5) / scale) for c in entry]) for entry in book]) for book in books])
    return codes.withColumn("approximation", F.flatten(F.zip_with(known, "codes", lambda book, i: F.element_at(book, i + 1))))


def code_digests(table: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every row that takes part."""
    found, books = encode(table)
    scratch = Scratch(table.sparkSession)
    labels = found.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("label_error"), (F.count("*") == F.count("error")).alias("known"))
    labels = scratch.store(labels.select(F.col("label").alias("of"), _long("label_error", F.col("known"))), "label-errors")
    digest = hashlib.sha256(",".join(str(c) for book in books for entry in book for c in entry).encode()).hexdigest()
    code = F.array_join(F.transform("codes", lambda i: F.lpad(F.lower(F.hex(i)), 2, "0")), "")
    joined = found.join(labels, F.col("label").eqNullSafe(F.col("of")))
    return scratch.finish(joined.select("vec_id", code.alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256")), "vector-codes")


def oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """DuckDB SQL for ``code_digests``, a common table for each round; for vectors of one length that ``parts`` divides."""

    def assigned(book: str, more: str = "") -> str:
        return f"""(SELECT pos, part, min(d * {entries} + entry) % {entries} AS entry, min(d * {entries} + entry) // {entries} AS error{more} FROM (
    SELECT p.pos, p.part, b.entry, list_sum(list_transform(list_zip(p.part, b.part), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
    FROM parts p JOIN {book} b ON p.pos = b.pos) GROUP BY pos, part)"""

    tables = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS n, vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"cut AS MATERIALIZED (SELECT n, vec_id, label, pos, x[pos * (len(x) // {parts}) + 1 : (pos + 1) * (len(x) // {parts})] AS part FROM v, range({parts}) r(pos))",
        "parts AS MATERIALIZED (SELECT pos, part, count(*) AS weight FROM cut GROUP BY pos, part)",
        f"b0 AS MATERIALIZED (SELECT pos, n - 1 AS entry, part FROM cut WHERE n <= {entries})",
    ]
    for i in range(rounds):
        tables.append(
            f"""b{i + 1} AS MATERIALIZED (
  WITH s AS (SELECT a.pos, a.entry, generate_subscripts(a.part, 1) AS dim, unnest(a.part) * p.weight AS x, p.weight FROM {assigned(f"b{i}")} a JOIN parts p USING (pos, part)),
  t AS (SELECT pos, entry, dim, sum(x)::BIGINT AS x, sum(weight)::BIGINT AS w FROM s GROUP BY ALL),
  m AS (SELECT pos, entry, list((x - ((x % w) + w) % w) // w ORDER BY dim) AS part FROM t GROUP BY pos, entry)
  SELECT b.pos, b.entry, coalesce(m.part, b.part) AS part FROM b{i} b LEFT JOIN m USING (pos, entry))"""
        )
    last = f"b{rounds}"
    tables += [
        f"coded AS MATERIALIZED (SELECT c.n, c.vec_id, c.label, string_agg(printf('%02x', a.entry), '' ORDER BY c.pos) AS code, sum(a.error)::BIGINT AS error FROM cut c JOIN {assigned(last)} a USING (pos, part) GROUP BY c.n, c.vec_id, c.label)",
        f"sha AS (SELECT sha256(string_agg(array_to_string(part, ','), ',' ORDER BY pos, entry)) AS codebooks_sha256 FROM {last})",
    ]
    return "WITH " + ",\n".join(tables) + "\nSELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM coded, sha"


ORACLE = oracle()
