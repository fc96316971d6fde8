import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from chronolake.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def bag(text, n=1, buckets=10_000):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lowered)
    runs = [" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]
    return len(words), Counter(crc32(r.encode()) % buckets for r in runs)


def brute(docs, target):
    bags = [bag(t) for _, t in docs]
    corpus, aim = Counter(), Counter()
    for _, b in bags:
        corpus.update(b)
    for t in target:
        aim.update(bag(t)[1])
    s, t = sum(corpus.values()), sum(aim.values())
    gain = [math.floor(1000 * math.log((aim[b] + 1.0) * (s + 10000.0) / ((corpus[b] + 1.0) * (t + 10000.0)))) for b in range(10000)]
    rows = []
    for (i, _), (words, b) in zip(docs, bags, strict=True):
        n = sum(b.values())
        weight = sum(gain[k] * c for k, c in b.items()) // n if n else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, n, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words))
    fits = sorted((-r[3], r[0] is None, r[0] or 0, r[1]) for r in rows if r[4] >= 20)
    drawn = {}
    for rank, key in enumerate(fits[: 10 * len(fits) // 100], 1):
        drawn.setdefault(key, []).append(rank)
    out = []
    for i, n, weight, score, words in rows:
        ranks = drawn.get((-score, i is None, i or 0, n), []) if words >= 20 else []
        out.append((i, n, weight, score, ranks.pop(0) if ranks else None))
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(2)
    words = ["".join(rng.choice("abcXYZ019éß漢") for _ in range(rng.randrange(1, 6))) for _ in range(900)]
    prose = lambda n: "".join(rng.choice(words) + rng.choice([" ", ", ", "\n", "-"]) for _ in range(n))
    same = prose(60)
    docs = [(i, prose(rng.randrange(1, 120))) for i in range(600)] + [(i, same) for i in range(1000, 1300)]
    docs += [(7, docs[7][1])] * 40 + [(8, same)] * 30 + [(None, same), (None, None), (2000, None), (2001, ""), (2002, ". ,"), (2003, prose(30_000))]
    return docs, [prose(50) for _ in range(30)] + [None, ""]


def frames(spark, texts, parts=4):
    docs = spark.createDataFrame([(t, i, 5, "q") for i, t in texts[0]], "text string, doc_id long, score int, ids string").repartition(parts)
    return docs, spark.createDataFrame([(i, t) for i, t in enumerate(texts[1])], "item_id long, text string")


@pytest.mark.parametrize("cells", [1 << 17, 50])
def test_against_brute_force(spark, texts, monkeypatch, cells):
    monkeypatch.setattr(resampling, "CELLS", cells)
    got = Counter(map(tuple, resampling.resampled(*frames(spark, texts)).collect()))
    assert got == Counter(brute(*texts))
    ranks = sorted(r[4] for r in got.elements() if r[4])
    assert ranks == list(range(1, len(ranks) + 1)) and len(ranks) > 50


def test_blocks_hold_the_matrix(spark, texts):
    docs, _ = frames(spark, texts, 2)
    seen = Counter()
    for b in resampling.count_blocks(docs, "doc_id", n=3, buckets=50).collect():
        for at, i in enumerate(b.ids):
            low, high = b["rows"][at], b["rows"][at + 1]
            seen[i, b.words[at], tuple(sorted(zip(b["columns"][low:high], b["counts"][low:high], strict=True)))] += 1
    true = Counter()
    for i, t in texts[0]:
        words, counts = bag(t, 3, 50)
        true[i, words, tuple(sorted(counts.items()))] += 1
    assert seen == true


def test_chunks_of_long_texts(monkeypatch):
    rng = random.Random(5)
    for _ in range(40):
        text = " ".join(rng.choice("abcd") for _ in range(rng.randrange(40)))
        n = rng.randrange(1, 5)
        monkeypatch.setattr(resampling, "CHUNK", rng.randrange(max(1, n - 1), 9))
        assert resampling.features(text.encode(), n, 97) == bag(text, n, 97)


def test_empty_tables(spark, texts):
    docs, target = frames(spark, texts)
    assert resampling.resampled(docs.limit(0), target).count() == 0
    got = Counter(map(tuple, resampling.resampled(docs, target.limit(0)).collect()))
    assert got == Counter(brute(texts[0], []))
    few = [(i, t) for i, t in texts[0][:9]]
    assert {r["rank"] for r in resampling.resampled(frames(spark, (few, []))[0], target).collect()} == {None}


def test_draw_follows_weights(spark):
    """Two kinds of documents, one worth ln 4 more: it is drawn about four times as often."""
    rows = [(i, 30, 30, (i % 2) * 1386, (i % 2) * 1386 + resampling.noise(str(i))) for i in range(40_000)]
    scored = spark.createDataFrame(rows, "doc_id long, n_words long, n_features long, weight long, score long")
    kinds = np.array([r.weight > 0 for r in resampling.draw(scored, share=2).where("rank is not null").collect()])
    assert len(kinds) == 800 and 0.75 < kinds.mean() < 0.85


def test_tasks_read_few_blocks_at_once(spark, texts, monkeypatch):
    monkeypatch.setattr(resampling, "CELLS", 50)
    frame = type(spark.range(0))
    plain = frame.mapInArrow

    def noting(self, run, schema, *more, **named):
        def few(batches):
            for batch in batches:
                assert "columns" not in batch.schema.names or batch.num_rows <= 64
                yield batch

        return plain(self, lambda batches: run(few(batches)), schema, *more, **named)

    docs, target = frames(spark, texts, 2)
    assert resampling.count_blocks(docs, "doc_id").count() > 500
    names = ("spark.sql.parquet.columnarReaderBatchSize", "spark.sql.execution.arrow.maxRecordsPerBatch")
    before = [spark.conf.get(k) for k in names]
    monkeypatch.setattr(frame, "mapInArrow", noting)
    assert resampling.resampled(docs, target).count() == len(texts[0])
    assert [spark.conf.get(k) for k in names] == before
