"""Kernels of anchors with all rows, taken block by block."""

import math

import numpy as np
import pytest

from chronolake.operators import matrix


@pytest.mark.parametrize("blocks", [(256, 16_384), (3, 7)])
def test_against_plain_sums(spark, monkeypatch, blocks):
    monkeypatch.setattr(matrix, "BLOCK_ANCHORS", blocks[0])
    monkeypatch.setattr(matrix, "BLOCK_ROWS", blocks[1])
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(size=5)]) for i in range(60)]
    rows += [(60, None), (61, [1.0, None, 2.0, 3.0, 4.0]), (62, [1.0, 2.0]), (63, [2.0, 0.5]), (64, []), (65, []), (7, [0.0] * 5), (66, [math.nan] * 5)]
    panel = spark.createDataFrame(rows, "sample_id long, values array<double>").repartition(3)
    got = {}
    for r in matrix.kernel_family(panel, panel.where("sample_id % 6 = 0 OR sample_id IN (7, 61, 63)")).collect():
        got.setdefault((r.i, r.j), []).append((r.linear, r.polynomial, r.laplacian))
    true = {}
    for i, a in rows:
        for j, b in rows:
            if i != j and (i % 6 == 0 or i in (7, 61, 63)):
                plain = a is not None and b is not None and len(a) == len(b) and None not in a and None not in b
                dot, apart = (sum(x * y for x, y in zip(a, b, strict=True)), sum(abs(x - y) for x, y in zip(a, b, strict=True))) if plain else (0, 0)
                true.setdefault((i, j), []).append((dot, (dot + 1) ** 3, math.exp(-0.1 * apart)) if plain else (None, None, None))
    assert got.keys() == true.keys()
    key = lambda t: repr([None if x is None else round(x, 9) + 0.0 for x in t])
    for pair, values in true.items():
        assert sorted(map(key, got[pair])) == sorted(map(key, values))


def test_pairs_are_taken_by_blocks(spark):
    """One row for each pair with both vectors, and functions called by component, took most of the time."""
    from chronolake.plans.catalogue import QUERIES

    plan = QUERIES["kernel_family"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "zip_with" not in plan and "Join" not in plan
