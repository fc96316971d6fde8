"""A regression forest over all pairs of rows with anchors, without a table of the pairs.

It grows as Spark ML's does: binary trees of ``DEPTH`` levels, split candidates at quantiles of a sample, every pair in
every tree a Poisson number of times, at each node a third of the features, the split that leaves least variance. But
a pair's features are made from its two vectors in each level's pass, ``PAIRS`` at a time, and are never stored or
shuffled: blocks of rows meet blocks of anchors, and hand over sums by node, feature and bin. Work is levels times
trees times pairs, as many as there are; disk is blocks and sums. Draws are hashes of ids, so that neither partitions
nor blocks matter. Null vectors take no part, nor in learning null targets; nulls within a vector count as 0."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolake.operators.lowrank import block, plain, width_of

DEPTH, BINS = 5, 32
#: Rows and anchors in a block, about; pairs that are taken at once; rows and anchors whose pairs give split candidates.
ROWS, ANCHORS, PAIRS, SAMPLE = 4096, 512, 1 << 15, 128
#: Poisson numbers of mean 1 by 16 bits.
_TIMES = np.searchsorted(np.cumsum([np.exp(-1.0) / np.prod(np.arange(1.0, k + 1)) for k in range(12)]), (np.arange(1 << 16) + 0.5) / (1 << 16)).astype("float64")


@dataclass
class Forest:
    """For each tree, by heap number of the node: feature, the last bin that goes left, value; ``cuts`` between a feature's bins."""

    kinds: list[tuple[str, int]]
    cuts: list[np.ndarray]
    feature: np.ndarray
    last: np.ndarray
    value: np.ndarray

    def nodes(self, tree: int, codes: np.ndarray, pairs: np.ndarray, levels: int) -> np.ndarray:
        """Where ``pairs`` stand after so many levels: numbers within the level. ``codes``: features x pairs."""
        at, cells = np.zeros(len(pairs), "int64"), codes.reshape(-1)
        for level in range(levels):
            heap = at + (1 << level) - 1
            at = 2 * at + (cells.take(self.feature[tree].take(heap) * codes.shape[1] + pairs) > self.last[tree].take(heap))
        return at


def kinds_of(mode: str, width: int) -> list[tuple[str, int]]:
    """Features of ``learn.pair_features``: of the row, of the anchor, their differences or the sizes of these."""
    apart = [("size" if mode == "concat_absdiff" else "apart", c) for c in range(width)]
    return apart if mode == "diff_only" else [*(("row", c) for c in range(width)), *(("anchor", c) for c in range(width)), *apart]


def _values(kind: str, rows: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Anchors x rows: one feature of all their pairs."""
    if kind in ("row", "anchor"):
        return np.broadcast_to(rows[None, :] if kind == "row" else marks[:, None], (len(marks), len(rows)))
    apart = rows[None, :] - marks[:, None]
    return np.abs(apart) if kind == "size" else apart


def _codes(forest: Forest, rows: np.ndarray, ranked: np.ndarray, ranks: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Features x (anchors x rows): the bin of each, the number of cuts below it. Differences from an anchor lie in the
    order of the rows, so that the cuts are looked up among them."""
    out = np.empty((len(forest.kinds), len(marks), len(rows)), "uint8")
    for x, ((kind, c), cuts) in enumerate(zip(forest.kinds, forest.cuts, strict=True)):
        if kind != "apart":
            out[x] = np.searchsorted(cuts, _values(kind, rows[:, c], marks[:, c]))
            continue
        bins, ends = np.arange(len(cuts) + 1, dtype="uint8"), np.zeros(len(cuts) + 2, "int64")
        ends[-1] = len(rows)
        for at, mark in enumerate(marks[:, c]):
            ends[1:-1] = (ranked[c] - mark).searchsorted(cuts, "right")
            bins.repeat(ends[1:] - ends[:-1]).take(ranks[c], out=out[x, at], mode="clip")
    return out.reshape(len(forest.kinds), -1)


def _times(own: np.ndarray, others: np.ndarray, trees: int) -> Iterator[np.ndarray]:
    """For each tree how often it takes each pair, from the hashes of its anchor and its row."""
    with np.errstate(over="ignore"):
        for tree in range(trees):
            if tree % 4 == 0:
                h = (own[:, None] * np.uint64(0x9E3779B97F4A7C15) + others[None, :] + np.uint64(tree)).ravel()
                h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                h = h ^ (h >> np.uint64(31))
            yield _TIMES[(h >> np.uint64(16 * (tree % 4))) & np.uint64(0xFFFF)]


def _blocks(rows: DataFrame, anchors: DataFrame) -> tuple[int, int]:
    """Numbers of blocks of anchors and of rows."""
    cores, n = rows.sparkSession.sparkContext.defaultParallelism, rows.count()
    return -(-anchors.count() // ANCHORS) or 1, max(-(-n // ROWS), min(2 * cores, -(-n // 256))) or 1


def _meeting(rows: DataFrame, anchors: DataFrame, blocks: tuple[int, int], make: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], kind: str) -> DataFrame:
    """``make`` of each block of anchors with each block of rows."""
    left_blocks, right_blocks = blocks

    def dealt(table: DataFrame, own: str, blocks: int, other: str, others: int) -> DataFrame:
        h = F.pmod(F.xxhash64(F.lit("block"), "sample_id"), F.lit(blocks)).cast("int")
        both = table.select("*", h.alias(own), F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other))
        both = both.select(*[F.col(c).alias(c) for c in ("p", "q", *table.columns)])  # else both sides share columns of one table
        return both.repartition(min(2 * left_blocks * right_blocks, 4096), "p", "q")  # else tasks are put together by size

    left, right = dealt(anchors, "p", left_blocks, "q", right_blocks), dealt(rows, "q", right_blocks, "p", left_blocks)
    both = lambda a, b: make(a, b) if len(a) and len(b) else pd.DataFrame()
    return left.groupBy("p", "q").cogroup(right.groupBy("p", "q")).applyInPandas(both, kind)


def _prepared(table: DataFrame, *carried: str) -> DataFrame:
    found = plain(table, *carried).withColumn("h", F.xxhash64("sample_id"))
    for c in carried:
        found = found.where(F.col(c).isNotNull()).withColumn(c, F.col(c).cast("double"))
    return found


def _parts(forest: Forest, marks: pd.DataFrame, rows: pd.DataFrame, width: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """A few anchors at a time: which, the bins of their pairs with all rows, and whether a pair has two ids."""
    a, b = block(marks["values"], width), block(rows["values"], width)
    ranks, step = np.argsort(np.argsort(b.T, kind="stable")), max(1, PAIRS // max(1, len(b)))
    ranked = np.sort(b.T)
    for at in range(0, len(a) if len(b) else 0, step):
        part = slice(at, at + step)
        yield part, _codes(forest, b, ranked, ranks, a[part]), (marks["sample_id"].to_numpy()[part, None] != rows["sample_id"].to_numpy()[None, :]).ravel()


def fit(train: DataFrame, anchors: DataFrame, mode: str, trees: int, seed: int = 1) -> Forest:
    """Learns target(row) - target(anchor) from all pairs of ``train`` with ``anchors`` (sample_id, values, target) whose ids differ."""
    rows, marks = _prepared(train, "target"), _prepared(anchors, "target")
    width = max(width_of(rows), width_of(marks))
    kinds = kinds_of(mode, width)
    some = [block(pd.Series([r["values"] for r in t.orderBy("h", "sample_id").limit(SAMPLE).collect()], dtype=object), width) for t in (rows, marks)]
    cuts = [np.unique(np.quantile(v, np.arange(1, BINS) / BINS)) if (v := _values(kind, some[0][:, c], some[1][:, c])).size else np.empty(0) for kind, c in kinds]
    heap = (1 << DEPTH) - 1
    forest = Forest(kinds, cuts, np.zeros((trees, heap), "int64"), np.full((trees, heap), BINS, "int64"), np.zeros((trees, 1 << DEPTH)))
    blocks = _blocks(rows, marks)
    rng, most = np.random.default_rng(seed), max(1, -(-len(kinds) // 3))
    for level in range(DEPTH if len(kinds) else 0):
        asked = np.array([[rng.permutation(len(kinds))[:most] for _ in range(1 << level)] for _ in range(trees)])
        for tree, node, x, last, left, right in _level(rows, marks, blocks, forest, asked, level, width).collect():
            at = node + (1 << level) - 1
            if x is not None:
                forest.feature[tree, at], forest.last[tree, at] = x, last
            if level == DEPTH - 1:
                forest.value[tree, 2 * node : 2 * node + 2] = left, right
    return forest


def _level(rows: DataFrame, marks: DataFrame, blocks: tuple[int, int], forest: Forest, asked: np.ndarray, level: int, width: int) -> DataFrame:
    """tree, node, feature (null: none parts the node), last, left, right: the best split of each node, and its sides' means."""
    trees, many, most = asked.shape

    def sums(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros((trees, many, 2, most, BINS))
        own, others = (t["h"].to_numpy("int64").view("uint64") for t in (left, right))
        for part, codes, apart in _parts(forest, left, right, width):
            y = (right["target"].to_numpy()[None, :] - left["target"].to_numpy()[part, None]).ravel()
            for tree, times in enumerate(_times(own[part], others, trees)):
                taken = np.flatnonzero(times * apart)
                at = forest.nodes(tree, codes, taken, level)
                order = np.argsort(at.astype("uint8"), kind="stable")
                ends = np.searchsorted(at[order], np.arange(many + 1))
                for node in np.flatnonzero(np.diff(ends)):
                    which = taken[order[ends[node] : ends[node + 1]]]
                    n, s = times[which], times[which] * y[which]
                    for k, x in enumerate(asked[tree, node]):
                        bins = codes[x].take(which).astype("int64")
                        total[tree, node, 0, k] += np.bincount(bins, n, BINS)
                        total[tree, node, 1, k] += np.bincount(bins, s, BINS)
        full = np.argwhere(total[:, :, 0, 0].sum(axis=-1) > 0)
        return pd.DataFrame({"tree": full[:, 0], "node": full[:, 1], "n": [total[t, k, 0].ravel() for t, k in full], "s": [total[t, k, 1].ravel() for t, k in full]})

    def best(group: pd.DataFrame) -> pd.DataFrame:
        n, s = (np.sum(group[c].to_list(), axis=0).reshape(most, BINS).cumsum(axis=1) for c in "ns")
        whole = s[0, -1] / n[0, -1]
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where((n > 0) & (n < n[:, -1:]), s * s / n + (s[:, -1:] - s) ** 2 / (n[:, -1:] - n) - s[:, -1:] ** 2 / n[:, -1:], 0.0)
        k, last = np.unravel_index(gain.argmax(), gain.shape)
        tree, node = int(group["tree"].iloc[0]), int(group["node"].iloc[0])
        if gain[k, last] <= 0:
            return pd.DataFrame({"tree": [tree], "node": [node], "feature": pd.array([None], "Int64"), "last": [0], "left": [whole], "right": [whole]})
        rest = (s[k, -1] - s[k, last]) / (n[k, -1] - n[k, last])
        return pd.DataFrame({"tree": [tree], "node": [node], "feature": pd.array([int(asked[tree, node, k])], "Int64"), "last": [int(last)], "left": [s[k, last] / n[k, last]], "right": [rest]})

    cells = _meeting(rows, marks, blocks, sums, "tree long, node long, n array<double>, s array<double>")
    return cells.groupBy("tree", "node").applyInPandas(best, "tree long, node long, feature long, last long, left double, right double")


def predict(forest: Forest, rows: DataFrame, anchors: DataFrame) -> DataFrame:
    """sample_id, y of ``rows`` (sample_id, values): the mean over the anchors of other ids of their target and the forest's difference."""
    asked, marks = _prepared(rows), _prepared(anchors, "target")
    width = max((c + 1 for _, c in forest.kinds), default=0)
    kind = rows.schema["sample_id"].dataType.simpleString()

    def sums(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        n, s = np.zeros(len(right), "int64"), np.zeros(len(right))
        for part, codes, apart in _parts(forest, left, right, width):
            pairs = np.arange(codes.shape[1])
            y = np.mean([forest.value[t].take(forest.nodes(t, codes, pairs, DEPTH)) for t in range(len(forest.value))], axis=0)
            both = (y.reshape(-1, len(right)) + left["target"].to_numpy()[part, None]) * apart.reshape(-1, len(right))
            n, s = n + apart.reshape(-1, len(right)).sum(axis=0), s + both.sum(axis=0)
        return pd.DataFrame({"sample_id": right["sample_id"], "n": n, "s": s})

    mean: Column = F.sum("s") / F.sum("n")
    return _meeting(asked, marks, _blocks(asked, marks), sums, f"sample_id {kind}, n long, s double").where("n > 0").groupBy("sample_id").agg(mean.alias("y"))
