"""The forest over pairs against a plain one that holds all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolake.operators import learn, pair_forest


def table(spark, ids, values, target):
    return spark.createDataFrame([(int(i), [float(x) for x in v], float(y)) for i, v, y in zip(ids, values, target, strict=True)], "sample_id long, values array<double>, target double")


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    values = np.round(rng.normal(size=(220, 4)), 2)
    target = 2 * values[:, 1] + np.where(values[:, 2] > 0, 3, 0)
    return values, target, table(spark, range(220), values, target)


def plain_forest(values, target, train, anchors, hashes, mode, trees):
    """All pairs as a matrix; cuts, draws and ties as in ``pair_forest``."""
    pairs = [(i, j) for i in anchors for j in train if i != j]
    of = {"diff_only": lambda a, b: b - a, "concat_diff": lambda a, b: np.r_[b, a, b - a], "concat_absdiff": lambda a, b: np.r_[b, a, abs(b - a)]}[mode]
    x = np.array([of(values[i], values[j]) for i, j in pairs])
    y = np.array([target[j] - target[i] for i, j in pairs])
    some = [sorted(ids, key=lambda i: (hashes[i], i))[: pair_forest.SAMPLE] for ids in (train, anchors)]
    own = np.array([of(values[i], values[j]) for i in some[1] for j in some[0]])
    cuts = [np.unique(np.quantile(own[:, c], np.arange(1, 32) / 32)) for c in range(x.shape[1])]
    unsigned = lambda ids: np.array([hashes[i] for i in ids], "int64").view("uint64")
    drawn = list(pair_forest._times(unsigned(anchors), unsigned(train), trees))
    keep = np.array([i != j for i in anchors for j in train])
    rng, most, grown = np.random.default_rng(1), -(-x.shape[1] // 3), [{} for _ in range(trees)]
    at = np.zeros((trees, len(y)), "int64")
    for level in range(pair_forest.DEPTH):
        asked = [[rng.permutation(x.shape[1])[:most] for _ in range(1 << level)] for _ in range(trees)]
        for t in range(trees):
            w = drawn[t][keep]
            for node in range(1 << level):
                here = (at[t] == node) & (w > 0)
                best = (1e-9, None, None)
                for c in asked[t][node] if here.any() else []:
                    for cut in cuts[c]:
                        left, right = here & (x[:, c] <= cut), here & (x[:, c] > cut)
                        if left.any() and right.any():
                            gain = sum((w[s] @ y[s]) ** 2 / w[s].sum() for s in (left, right)) - (w[here] @ y[here]) ** 2 / w[here].sum()
                            if gain > best[0] + 1e-7:
                                best = (gain, c, cut)
                grown[t][level, node] = best[1:]
            split = [grown[t][level, n] for n in range(1 << level)]
            at[t] = [2 * n + (split[n][0] is not None and v[split[n][0]] > split[n][1]) for n, v in zip(at[t], x, strict=True)]
    leaves = [{n: np.average(y[at[t] == n], weights=w[at[t] == n]) for n in set(at[t].tolist()) if w[at[t] == n].any()} for t, w in enumerate(d[keep] for d in drawn)]

    def ask(a, b):
        v, out = of(a, b), []
        for t in range(trees):
            n = 0
            for level in range(pair_forest.DEPTH):
                c, cut = grown[t][level, n]
                n = 2 * n + (c is not None and v[c] > cut)
            out.append(leaves[t].get(n, 0.0))
        return float(np.mean(out))

    return ask


@pytest.mark.parametrize("mode", ["diff_only", "concat_diff", "concat_absdiff"])
def test_is_the_forest_of_all_pairs(spark, data, monkeypatch, mode):
    monkeypatch.setattr(pair_forest, "ANCHORS", 5)
    monkeypatch.setattr(pair_forest, "ROWS", 40)
    monkeypatch.setattr(pair_forest, "PAIRS", 90)
    values, target, rows = data
    hashes = {r.sample_id: r.h for r in rows.select("sample_id", F.xxhash64("sample_id").alias("h")).collect()}
    train, anchors = rows.where("sample_id < 150"), rows.where("sample_id < 12")
    got = {r.sample_id: r.y for r in learn.pairwise_values(train, rows.where("sample_id >= 5 AND sample_id < 220").drop("target"), anchors, mode, 3).collect()}
    ask = plain_forest(values, target, list(range(150)), list(range(12)), hashes, mode, 3)
    assert sorted(got) == list(range(5, 220))
    for j in (5, 11, 12, 150, 180, 219):
        own = [i for i in range(12) if i != j]
        assert got[j] == pytest.approx(np.mean([target[i] + ask(values[i], values[j]) for i in own]), abs=1e-9)


def test_odd_tables(spark, data):
    rows = data[2]
    odd = spark.createDataFrame([(900, None, 1.0), (901, [1.0, None, 2.0, 0.0], None), (902, [0.0] * 4, 2.0)], "sample_id long, values array<double>, target double")
    got = learn.pairwise_values(rows.unionByName(odd), odd.drop("target"), rows.where("sample_id < 9").unionByName(odd), "concat_diff", 2)
    assert sorted(r.sample_id for r in got.collect()) == [901, 902]
    assert learn.pairwise_values(rows, rows.limit(0), rows.limit(3), "diff_only", 2).count() == 0
    assert learn.pairwise_values(rows, rows, rows.limit(0), "diff_only", 2).count() == 0
    same = table(spark, range(30), np.zeros((30, 2)), np.zeros(30))
    assert {r.y for r in learn.pairwise_values(same, same, same.where("sample_id < 4"), "diff_only", 2).collect()} == {0.0}


def test_pairs_are_never_rows(spark, data, monkeypatch):
    """What a level's pass hands over is sums by node; no plan has the features of pairs."""
    seen, frame = [], type(spark.range(0))
    plain = frame.collect
    monkeypatch.setattr(frame, "collect", lambda self: (seen.append(self._jdf.queryExecution().toString()), plain(self))[1])
    rows = data[2]
    pair_forest.fit(rows, rows.where("sample_id < 20"), "diff_only", 2)
    assert any("FlatMapCoGroupsInPandas" in p for p in seen) and not any("zip_with" in p or "Join" in p for p in seen)
