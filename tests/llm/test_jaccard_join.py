import os
import random

import pytest

from chronolake.llm import jaccard_join
from chronolake.llm.common import Scratch
from chronolake.llm.components import components


def grams(text):
    words = (text or "").lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def brute(rows):
    sets = [grams(t) for _, t in rows]
    linked = [[j for j, b in enumerate(sets) if j != i and (a == b or len(a & b) >= 0.8 * len(a | b))] for i, a in enumerate(sets)]
    group = {}
    for i in range(len(rows)):
        if i not in group:
            todo, seen = [i], {i}
            while todo:
                for j in linked[todo.pop()]:
                    if j not in seen:
                        seen.add(j)
                        todo.append(j)
            ids = [rows[j][0] for j in seen if rows[j][0] is not None]
            group |= dict.fromkeys(seen, min(ids, default=None))
    return [(rows[i][0], group[i], len(linked[i])) for i in range(len(rows))]


def rows_():
    rng = random.Random(6)
    prose = lambda n: " ".join("w%d" % rng.randrange(3000) for _ in range(n))
    texts = [prose(rng.randrange(1, 200)) for _ in range(60)]
    for size, edits in ((40, 4), (12, 2), (3, 1), (2, 1)):
        base = prose(150).split()
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randrange(edits + 1)):
                w[rng.randrange(len(w))] = "e%d" % rng.randrange(9999)
            texts.append(" ".join(w))
    passage = prose(60)
    texts += [f"{prose(40)} {passage} {prose(30)}" for _ in range(20)]
    texts += [texts[0]] * 9 + [texts[0].upper(), "a b c d", "A b  c d", "a b c", "", None, "  ", "x " * 4000, "x " * 5000, "漢 字 é è ç"]
    rows = list(enumerate(texts))
    return rows + [rows[3], (None, texts[4]), (None, "no id at all here now")]


@pytest.mark.parametrize(("tile", "wide"), [(256, 4096), (7, 4096), (5, 8)])
def test_against_brute_force(spark, monkeypatch, tile, wide):
    monkeypatch.setattr(jaccard_join, "TILE", tile)
    monkeypatch.setattr(jaccard_join, "WIDE", wide)
    rows = rows_()
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, c string, n int")
    key = lambda r: tuple(-1 if x is None else x for x in r)
    got = sorted(map(tuple, jaccard_join.links_by_document(docs.repartition(3)).collect()), key=key)
    assert got == sorted(brute(rows), key=key)


def test_one_of_each_group_stays(spark):
    rows = rows_()
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, c string, n int")
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    groups = {(g if g is not None else "none", ) for _, g, _ in brute(rows)}
    assert kept.count() == len(groups)
    assert {r.doc_id for r in kept.collect()} == {g for _, g, _ in brute(rows)}
    assert jaccard_join.keep_one(docs.limit(0)).count() == 0


def test_bands_reach_the_recall():
    bands = jaccard_join.bands_for(0.8, 8, 0.999)
    assert 1 - (1 - 0.8**8) ** bands >= 0.999 > 1 - (1 - 0.8**8) ** (bands - 1)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 300), (250, 300)]
    scratch = Scratch(spark)
    out = components(spark.createDataFrame(edges, "a long, b long"), scratch, "t")
    got = {r.node: r.root for r in out.collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 200: 200, 250: 200, 300: 200}
    (path,) = scratch.inner
    assert os.path.isdir(path)
    scratch.clear()
    assert not os.path.isdir(path) and not scratch.inner


def test_large_components_give_the_pairs_of_small_ones(spark, monkeypatch):
    """With few bands many pairs have none in common; which pairs are verified doesn't depend on ``WIDE``."""
    monkeypatch.setattr(jaccard_join, "bands_for", lambda *_: 3)
    docs = spark.createDataFrame(rows_(), "doc_id long, text string")
    key = lambda r: tuple(-1 if x is None else x for x in r)
    found = []
    for wide in (4096, 4):
        monkeypatch.setattr(jaccard_join, "WIDE", wide)
        found.append(sorted(map(tuple, jaccard_join.links_by_document(docs).collect()), key=key))
    assert found[0] == found[1] != sorted(brute(rows_()), key=key)
