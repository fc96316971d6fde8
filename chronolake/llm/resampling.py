"""Importance resampling towards a target distribution, over a stored sparse matrix of counts.

1. Counts. Texts become bags of hashed features: runs of 1 to ``n`` consecutive words, in ``buckets`` buckets by
   crc32. The document-by-bucket matrix is stored in blocks of compressed sparse rows: a block is one table row
   with its documents' ids, row pointers, bucket numbers and counts, at most ``CELLS`` cells and one document more.
   Blocks are read ``AT_ONCE`` at a time, so that a task's memory doesn't grow with the blocks that it reads.
2. Distributions. Column sums of the blocks, of the corpus and of the target: each task adds its blocks up and
   hands over ``buckets`` rows at most. The ``buckets`` gains alone come to the driver.
3. Weights. The product of each block with the gains, floored means by document: no shuffle.
4. Draw. A document's score is its weight plus Gumbel noise from a hash of its id, so the highest scores are a
   draw without replacement. Scores are whole numbers in a range that the formula bounds (some 10**5 values);
   their counts give the lowest score that is drawn and how many lie above each score. Ranks within a score come
   from a window over that score; the noise spreads even equal weights so that no score holds more than 0.04 % of
   the ids. Rows that repeat id and counts are one row with a number until ranks are dealt.

Defined cases: a null text has no words; documents without features weigh 0; a null id counts as the empty text
in the hash and comes last among ties; rows that repeat an id have the same noise, and are drawn one by one, the
fewer features first among ties; an empty corpus gives an empty result; an empty target has T = t = 0; a very
long text is one row of its block, of ``buckets`` cells at most; further columns are not read.
"""

from __future__ import annotations

import contextlib
import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from chronolake.llm.common import Scratch, settings

BUCKETS, RUNS, SALT, LEAST_WORDS, SHARE = 10_000, 1, 2024, 20, 10
#: Cells of a block after which it is closed.
CELLS = 1 << 13
#: Blocks that a task reads at once, from its table and into Python: 600,000 cells at most with all buckets in use.
AT_ONCE = 32
#: Words that are hashed at once: bounds the list that a very long text makes.
CHUNK = 1 << 16

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z are lower-cased; every byte of a character beyond ASCII is one of these.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def features(data: bytes, n: int = RUNS, buckets: int = BUCKETS) -> tuple[int, Counter]:
    """Number of words of a text in UTF-8, and its features' counts by bucket."""
    counts: Counter = Counter()
    memo: dict[bytes, int] = {}
    words, last, held = 0, [], []

    def close() -> None:
        runs = [held]
        runs += [[b" ".join((last + held)[i : i + k]) for i in range(max(0, len(last) - k + 1), len(last) + len(held) - k + 1)] for k in range(2, n + 1)]
        for run in runs:
            for feature, times in Counter(run).items():
                if (bucket := memo.get(feature)) is None:
                    bucket = memo[feature] = crc32(feature) % buckets
                counts[bucket] += times
        if len(memo) > 4 * CHUNK:
            memo.clear()

    for match in _WORD.finditer(data.translate(_LOWER)):
        held.append(match.group())
        if len(held) == CHUNK:
            close()
            words, last, held = words + len(held), (last + held)[len(last) + len(held) - n + 1 :], []
    close()
    return words + len(held), counts


def count_blocks(table: DataFrame, key: str, n: int = RUNS, buckets: int = BUCKETS) -> DataFrame:
    """The matrix of a table's texts: ids, words, rows (pointers), columns, counts of each block."""
    kind = table.schema[key].dataType
    kinds = {"words": pa.int64(), "rows": pa.int32(), "columns": pa.int32(), "counts": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, words, rows, columns, counts, id_kind = [], [], [0], [], [], None

        def block() -> pa.RecordBatch:
            arrays = [pa.array([ids], pa.list_(id_kind))]
            arrays += [pa.array([np.asarray(x, k.to_pandas_dtype())], pa.list_(k)) for x, k in zip((words, rows, columns, counts), kinds.values(), strict=True)]
            return pa.RecordBatch.from_arrays(arrays, ["ids", *kinds])

        for batch in batches:
            id_kind = batch.schema.field("id").type
            for at in range(batch.num_rows):
                found, bag = features(batch["data"][at].as_py() or b"", n, buckets)
                ids.append(batch["id"][at].as_py())
                words.append(found)
                columns.extend(bag.keys())
                counts.extend(bag.values())
                rows.append(len(columns))
                if len(columns) >= CELLS or len(ids) >= CELLS:
                    yield block()
                    ids, words, rows, columns, counts = [], [], [0], [], []
        if ids:
            yield block()

    read = table.select(F.col(key).alias("id"), F.col("text").cast("binary").alias("data"))
    return read.mapInArrow(run, f"ids array<{kind.simpleString()}>, words array<long>, rows array<int>, columns array<int>, counts array<long>")


def _few(blocks: DataFrame) -> contextlib.AbstractContextManager[None]:
    """While ``blocks`` are read. Left alone, Spark takes 4096 rows of a table and 10,000 of a batch at once: all of a task's."""
    return settings(blocks.sparkSession, {"spark.sql.parquet.columnarReaderBatchSize": str(AT_ONCE), "spark.sql.execution.arrow.maxRecordsPerBatch": str(AT_ONCE)})


def _lists(batch: pa.RecordBatch, names: tuple[str, ...]) -> Iterator[tuple[np.ndarray, ...]]:
    for at in range(batch.num_rows):
        yield tuple(batch[c][at].values.to_numpy(zero_copy_only=False) for c in names)


def column_sums(blocks: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Counts by bucket over all blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, "int64")
        for batch in batches:
            for columns, counts in _lists(batch, ("columns", "counts")):
                np.add.at(sums, columns, counts)
        full = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(sums[full])], ["bucket", "n"])

    whole = np.zeros(buckets, "int64")
    with _few(blocks):
        for bucket, n in blocks.select("columns", "counts").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n")).collect():
            whole[bucket] = n
    return whole


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the smoothed target's share over the smoothed corpus's share) of each bucket."""
    s, t, buckets = float(corpus.sum()), float(target.sum()), len(corpus)
    return np.array([math.floor(1000 * math.log((b + 1.0) * (s + buckets) / ((a + 1.0) * (t + buckets)))) for a, b in zip(corpus.tolist(), target.tolist(), strict=True)], "int64")


def noise(doc_id: str, salt: int = SALT) -> int:
    """floor(1000 * Gumbel noise) from a hash of the id."""
    h = int(hashlib.sha256(f"{salt}:{doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weights(blocks: DataFrame, gain: np.ndarray, salt: int = SALT) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of every document in ``blocks``."""
    kind = blocks.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, (words, rows, columns, counts) in enumerate(_lists(batch, ("words", "rows", "columns", "counts"))):
                sums = np.zeros((2, len(columns) + 1), "int64")
                np.cumsum(counts, out=sums[0, 1:])
                np.cumsum(counts * gain[columns], out=sums[1, 1:])
                n, product = sums[:, rows[1:]] - sums[:, rows[:-1]]
                weight = np.where(n > 0, product // np.maximum(n, 1), 0)
                ids = batch["ids"][at].values
                score = weight + np.array([noise("" if i is None else str(i), salt) for i in ids.to_pylist()], "int64")
                yield pa.RecordBatch.from_arrays([ids, *map(pa.array, (words, n, weight, score))], ["doc_id", "n_words", "n_features", "weight", "score"])

    return blocks.mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long, score long")


def draw(scored: DataFrame, least_words: int = LEAST_WORDS, share: int = SHARE) -> DataFrame:
    """``scored``, a stored table, with rank: 1, 2, 3... for the ``share`` percent (floored) of the documents of
    ``least_words`` or more that have the highest scores; null for the others."""
    fits = F.col("n_words") >= least_words
    counts = sorted(((r["score"], r["n"]) for r in scored.where(fits).groupBy("score").agg(F.count("*").alias("n")).collect()), reverse=True)
    wanted = share * sum(n for _, n in counts) // 100
    above, offsets = 0, []
    for score, n in counts:
        if above < wanted:
            offsets.append((score, above))
        above += n
    none = F.lit(None).cast("long").alias("rank")
    if not offsets:
        return scored.withColumn("rank", none)
    lowest = offsets[-1][0]
    before = F.broadcast(scored.sparkSession.createDataFrame(offsets, "score long, above long"))  # a row for each score
    keys = ["doc_id", "n_words", "n_features", "weight", "score"]
    same = scored.where(fits & (F.col("score") >= lowest)).groupBy(*keys).agg(F.count("*").alias("n")).join(before, "score")
    order = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "n_features", "n_words").rowsBetween(Window.unboundedPreceding, 0)
    first = F.col("above") + F.sum("n").over(order) - F.col("n") + 1
    ranked = same.withColumn("first", first).select(*keys, F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("rank"))
    drawn = ranked.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    return drawn.unionByName(scored.where(~(fits & (F.col("score") >= lowest))).select(*keys, none))


def resampled(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document; ``target`` has item_id and text."""
    scratch = Scratch(docs.sparkSession)
    corpus = scratch.store(count_blocks(docs, "doc_id"), "count-blocks")
    aim = scratch.store(count_blocks(target, "item_id"), "target-blocks")
    gain = gains(column_sums(corpus), column_sums(aim))
    with _few(corpus):
        scored = scratch.store(weights(corpus, gain), "weights")
    return scratch.finish(draw(scored).drop("n_words"), "resampled")
