import hashlib
import random
import re
from collections import Counter

import duckdb
import pytest

from chronolake.llm import passage_trees
from chronolake.llm.passage_trees import GRAM


def brute(docs, window=20):
    """Rows of the contract; documents of one id come in the order that the library gives them."""
    words = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for _, t in docs]
    whole = {}
    for n, (i, t) in enumerate(docs):
        whole.setdefault((i, t), n)  # rows that repeat both are one document
    order = sorted(whole.values(), key=lambda n: (docs[n][0] is None, docs[n][0] or 0))
    seen, gone = set(), {}
    for n in order:
        own = words[n]
        marks = [False] * len(own)
        for at in range(len(own) - window + 1):
            key = tuple(own[at : at + window])
            if key in seen:
                marks[at : at + window] = [True] * window
            seen.add(key)
        gone[docs[n]] = marks
    for (i, t), own in zip(docs, words, strict=True):
        kept = [w for w, g in zip(own, gone[i, t], strict=True) if not g]
        yield i, len(own), len(own) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()


def texts():
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdeéü漢.") for _ in range(rng.randrange(2, 7))) for _ in range(300)]
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    base, passages = prose(200), [prose(25), prose(60), prose(20), prose(19)]
    out = [prose(rng.randrange(1, 150)) for _ in range(30)] + [base] * 25
    for _ in range(30):  # near copies
        near = list(base)
        for _ in range(rng.randrange(1, 6)):
            near[rng.randrange(len(near))] = "edit" + str(rng.random())
        out.append(near)
    out += [prose(rng.randrange(30)) + passages[i % 4] + prose(rng.randrange(30)) for i in range(40)]
    out += [["z"] * 90, ["a", "b"] * 45, base[:60] + base[:60], base[7:80], prose(3) * 30]
    glued = [rng.choice([" ", "\n", "\t ", "\x0b", "\x0c\r"]).join(t) for t in out] + [None, "", " \n", None, " x y " * 30]
    return glued


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(8)
    rows = [(i, t) for i, t in enumerate(texts())]
    rng.shuffle(rows)
    rows = [(n, t) for n, (_, t) in enumerate(rows)]
    return rows + [rows[3], rows[3], rows[40]] + [(None, rows[11][1]), (None, None)]


@pytest.mark.parametrize("most", [4096, 2])
def test_against_brute_force(spark, monkeypatch, docs, most):
    monkeypatch.setattr(passage_trees, "MOST", most)
    table = spark.createDataFrame([(t, i, "x", 1) for i, t in docs], "text string, doc_id long, k string, n_words int")
    got = Counter(map(tuple, passage_trees.removal_digests(table.repartition(5)).collect()))
    assert got == Counter(brute(docs))


def test_texts_and_columns_are_kept(spark):
    long = " ".join(f"w{i}" for i in range(30))
    rows = [(5, long + "  tail", "en", "p"), (9, "head \n" + long, None, "q"), (None, None, "fr", "r"), (2, "a  b\n", "de", "s")]
    table = spark.createDataFrame(rows, "id long, text string, removed string, none string").withColumnRenamed("id", "doc_id").drop("removed")
    out = {r.none: r for r in passage_trees.remove_passages(table).collect()}
    assert out["p"].text == long + "  tail" and out["q"].text == "head" and out["r"].text is None and out["s"].text == "a  b\n"
    assert [tuple(x) for x in out["q"].removed] == [(1, 31)] and out["p"].removed == []
    assert passage_trees.remove_passages(table.limit(0)).count() == 0
    empty = passage_trees.removal_digests(table.limit(0))
    assert empty.count() == 0 and empty.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]


def test_maximal_repeats_equal_brute_force():
    rng = random.Random(5)
    for _ in range(200):
        given = [("".join(rng.choice("ab") for _ in range(rng.randrange(7))), "".join(rng.choice("ab") for _ in range(rng.randrange(7)))) for _ in range(rng.randrange(1, 12))]
        true = set()
        for i, (left, right) in enumerate(given):
            for a in range(len(left) + 1):
                for b in range(len(right) + 1):
                    own = [j for j, (x, y) in enumerate(given) if x[:a] == left[:a] and y[:b] == right[:b] and len(x) >= a and len(y) >= b]
                    before = {given[j][0][a] if len(given[j][0]) > a else j for j in own}
                    after = {given[j][1][b] if len(given[j][1]) > b else j for j in own}
                    if a + b >= 4 and len(own) > 1 and len(before) > 1 and len(after) > 1:
                        true.add((a, b, frozenset(own)))
                        assert i in own
        got = [(a, b, frozenset(own)) for a, b, own in passage_trees.maximal_repeats(*zip(*given, strict=True), 4)]
        assert len(got) == len(set(got)) and set(got) == true


def test_chunks_agree_with_the_whole(monkeypatch):
    data = " ".join(t for t in texts()[:90] if t).encode()
    n = len(data.split())
    whole = {(a, h) for _, _, anchors, hashes, _ in passage_trees.segments(data) for a, h in zip(anchors.tolist(), hashes.tolist(), strict=True)}
    monkeypatch.setattr(passage_trees, "CHUNK", 333)
    passage_trees._powers.cache_clear()
    parts = [s for s in passage_trees.segments(data)]
    assert len(parts) > 10
    starts = [w for first, last, *_ in parts for a, b in zip(first.tolist(), last.tolist(), strict=True) for w in range(a, b + 1)]
    assert starts == list(range(n - 20 + 1))
    assert {(a, h) for _, _, anchors, hashes, _ in parts for a, h in zip(anchors.tolist(), hashes.tolist(), strict=True)} == whole
    for first, last, anchors, _, _ in parts:
        assert ((anchors >= last) & (anchors + GRAM <= first + 20)).all()
    monkeypatch.undo()
    passage_trees._powers.cache_clear()


def test_sql_agrees(spark):
    source = "/root/testdata/sf0.001/documents.parquet"
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{source}'")
    true = Counter(duckdb.sql(passage_trees.ORACLE).fetchall())
    assert Counter(map(tuple, passage_trees.removal_digests(spark.read.parquet(source)).collect())) == true
