import math
from collections import Counter

import numpy as np
import pytest

from chronolake.llm import ann_search, impact_search


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(6, 20))
    out = [(i, (centres[i % 6] + rng.normal(size=20) * 0.6).tolist()) for i in range(700)]
    out += [(1000 + i, out[i][1]) for i in range(0, 200, 10)]  # equal vectors: ties
    out += [(2000 + i, centres[0].tolist()) for i in range(300)]  # a third in one place
    odd = [(3000, None), (3050, [0.0] * 20), (3100, [None] + [1.0] * 19), (3150, [math.nan] * 20), (3200, [math.inf] * 20), (3250, [1.0] * 7), (None, [1.0] * 20)]
    return out + odd + [out[3], out[50]]


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, query_id string, score int")


def clean(rows, zero_too):
    good = [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and (zero_too or any(v))]
    return [(i, np.asarray(v + [0.0] * (20 - len(v)), "float32").astype("float64")) for i, v in good]


def brute(vectors, every, k, score):
    for place, (q, own) in enumerate(vectors):
        if q % every == 0:
            ranked = sorted((-score(own, v), i) for n, (i, v) in enumerate(vectors) if n != place)
            yield from ((q, n + 1, i, -s) for n, (s, i) in enumerate(ranked[:k]))


def test_exact_top_k(spark, rows):
    out = impact_search.top_k(table(spark, rows), "vec_id % 50 = 0", 10).collect()
    whole = [(i, np.floor(1024 * v).astype("int64")) for i, v in clean(rows, True)]
    assert sorted(map(tuple, out)) == sorted(brute(whole, 50, 10, lambda a, b: int(a @ b)))


def test_exact_top_k_small(spark):
    few = table(spark, [(0, [1.0, -0.5]), (50, [0.25, 0.25]), (7, [0.0, 0.0])])
    out = impact_search.top_k(few, "vec_id % 50 = 0", 10).collect()
    assert sorted(map(tuple, out)) == [(0, 1, 50, 131072), (0, 2, 7, 0), (50, 1, 0, 131072), (50, 2, 7, 0)]
    assert impact_search.top_k(few.limit(0), "vec_id % 50 = 0", 10).count() == 0


@pytest.mark.parametrize("size", [1.0, 3e4, 3e5, 9e5, 9e7, 1e12, 9e14, 1e16])
def test_exact_top_k_of_any_magnitude(spark, size):
    """Components that are no long leave their row out; scores beyond a long are the nearest long."""
    rng = np.random.default_rng(12)
    rows = [(i, (rng.uniform(-size, size, 8) * (rng.random(8) < 0.9)).tolist()) for i in range(400)]
    rows += [(400, [1.0] * 8), (401, [size] + [0.0] * 7), (402, [-size] * 8), (500, [size] * 8)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if all(abs(1024 * x) < 2**63 for x in v)]
    inside = lambda a, b: min(max(sum(x * y for x, y in zip(a, b, strict=True)), -(2**63)), 2**63 - 1)
    got = sorted(map(tuple, impact_search.top_k(table, "vec_id % 100 = 0", 10).collect()))
    assert got == sorted(brute(whole, 100, 10, inside)) and len(got) >= 10


def test_nearest_of_any_magnitude(spark):
    rng = np.random.default_rng(13)
    base = rng.normal(size=(300, 8))
    for size in (1e-200, 1.0, 1e200):
        table = spark.createDataFrame([(i, (v * size).tolist()) for i, v in enumerate(base)], "vec_id long, embedding array<double>")
        unit = base / np.sqrt((base * base).sum(axis=1, keepdims=True))
        true = {(q, n, i, round(-s, 9)) for q, n, i, s in brute(list(enumerate(unit)), 50, 5, lambda a, b: float(a @ b))}
        got = {(q, n, i, round(s, 9)) for q, n, i, s in map(tuple, ann_search.nearest(table, "vec_id % 50 = 0", 5).collect())}
        true = {(q, n, i, round(abs(s), 9)) for q, n, i, s in true}
        assert len(got) == len(true) == 30 and len(got & true) >= 27


def test_proof_holds_the_true_members():
    rng = np.random.default_rng(2)
    data = rng.integers(-900, 900, (3000, 24)) * (rng.random((3000, 24)) < 0.2)
    asked = data[:40]
    found = impact_search.ImpactBlock(data).possible(asked, 10)
    scores = asked @ data.T
    for places, row in zip(found, scores, strict=True):
        assert set(np.flatnonzero(row > np.sort(row)[-10])) <= set(places.tolist())
    assert sum(map(len, found)) < 40 * 3000 / 4  # it did stop early


def test_nearest_neighbours(spark, rows):
    out = ann_search.nearest(table(spark, rows), "vec_id % 50 = 0", 5).collect()
    vectors = clean(rows, False)
    cosine = lambda a, b: float((a * b).sum() / (math.sqrt((a * a).sum()) * math.sqrt((b * b).sum())))
    true = list(brute(vectors, 50, 5, cosine))
    by_id = dict(vectors)
    for q, _, i, s in map(tuple, out):
        assert (q != i or q == 50) and abs(s - cosine(by_id[q], by_id[i])) < 1e-12
    hits = sum(any(abs(t[3] - r.score) < 1e-9 and t[0] == r.query_id and t[1] == r["rank"] for r in out) for t in true)
    assert hits >= 0.9 * len(true)
    ties = [(r.query_id, r["rank"], r.vec_id) for r in out if r.query_id == 2000]
    assert ties == [(2000, n + 1, 2001 + n) for n in range(5)]
    assert ann_search.nearest(table(spark, rows).limit(0), "vec_id % 50 = 0", 5).count() == 0


def test_rows_of_one_id_ask_apart(spark):
    """Each row is a query of its own, and all other rows are candidates, those of its id and its own copies too."""
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=20).tolist()) for i in range(1, 400)]
    rows += [(0, (np.ones(20) * (50 + i)).tolist()) for i in range(30)] + [(0, rows[7][1]), (0, rows[7][1])]  # one id, many vectors, one twice
    distinct = [(i, np.asarray(v, "float32").astype("float64")) for i, v in rows]
    exact = [np.floor(v * 1024).astype("int64") for _, v in distinct]
    cosine = [v / math.sqrt((v * v).sum()) for _, v in distinct]
    for search, data in ((impact_search.top_k, exact), (ann_search.nearest, cosine)):
        true = Counter()
        for q, (i, _) in enumerate(distinct):
            if i == 0:
                best = sorted((-float(data[q] @ x), j) for n, ((j, _), x) in enumerate(zip(distinct, data, strict=True)) if n != q)[:3]
                true.update((0, n + 1, j, round(-s, 6)) for n, (s, j) in enumerate(best))
        got = Counter((r.query_id, r["rank"], r.vec_id, round(float(r.score), 6)) for r in search(table(spark, rows), "vec_id = 0", 3).collect())
        if search is impact_search.top_k:
            assert got == true
        else:  # approximate: scores of the 31 long parallel vectors are 1 but for rounding
            assert sum(got.values()) == 3 * 32 and sum((Counter((a, b, d) for a, b, _, d in got.elements()) & Counter((a, b, d) for a, b, _, d in true.elements())).values()) >= 0.9 * 96
