import hashlib
import math
import random
from collections import Counter, defaultdict

import duckdb
import pytest

from chronolake.llm import vector_codes


def brute(rows, parts=8, entries=16, rounds=6, scale=4096):
    """The contract's rows in plain Python integers; rows are (id, vector, label)."""
    kept = [(i, [math.floor(scale * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, v, _ in kept), default=0) // parts)
    kept = [(i, v + [0] * (parts * width - len(v)), lab) for i, v, lab in kept]
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    first = sorted(range(len(kept)), key=lambda r: (kept[r][0] is None, kept[r][0] or 0, kept[r][1]))[:entries]
    books = [[cut[r][p] for r in first] for p in range(parts)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds if first else 0):
        for p in range(parts):
            own = defaultdict(list)
            for row in cut:
                own[nearest(row[p], books[p])[1]].append(row[p])
            books[p] = [[sum(c) // len(own[k]) for c in zip(*own[k], strict=True)] if own[k] else e for k, e in enumerate(books[p])]
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    out, labels = [], Counter()
    for (i, _, lab), row in zip(kept, cut, strict=True):
        found = [nearest(part, book) for part, book in zip(row, books, strict=True)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), lab))
        labels[lab] += out[-1][2]
    return [(i, code, error, labels[lab], sha) for i, code, error, lab in out]


def table(spark, rows, kind="float"):
    return spark.createDataFrame([(v, i, lab, "x", 1) for i, v, lab in rows], f"embedding array<{kind}>, vec_id long, label int, code string, row int")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    grid = lambda: [rng.randrange(-64, 65) / 64 for _ in range(16)]  # noqa: E731, exact as floats
    centres = [grid() for _ in range(20)]
    out = [(i, [c + rng.randrange(-6, 7) / 128 for c in rng.choice(centres)], rng.choice([0, 1, 2, None])) for i in range(400)]
    out += [(1000 + i, centres[0], 1) for i in range(200)]  # a third in one place
    odd = [(3000, None, 1), (3001, [None] + [1.0] * 15, 1), (3002, [math.nan] * 16, 2), (3003, [math.inf] * 16, 2), (3004, [0.5] * 5, 3), (3005, [], None), (None, centres[1], 3)]
    rng.shuffle(out)
    return out + odd + [out[5], out[5], (out[5][0], centres[2], 0)]


def test_against_brute_force(spark, rows):
    got = Counter(map(tuple, vector_codes.code_digests(table(spark, rows).repartition(5)).collect()))
    assert got == Counter(brute(rows))


def test_few_rows_and_none(spark):
    few = [(i, [float(i)] * 8, None) for i in range(5)] + [(2, [2.0] * 8, 1)]
    assert Counter(map(tuple, vector_codes.code_digests(table(spark, few)).collect())) == Counter(brute(few))
    empty = vector_codes.code_digests(table(spark, few).limit(0))
    assert empty.count() == 0 and empty.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert vector_codes.code_digests(table(spark, [(1, [], 1)])).first().code == "00" * 8


@pytest.mark.parametrize("size", [3e4, 3e5, 1e9, 1e14])
def test_large_components(spark, size):
    """Exact at every size: errors that are no long are null, codes and codebooks stay right."""
    rng = random.Random(6)
    rows = [(i, [rng.uniform(-size, size) for _ in range(16)], i % 2) for i in range(60)]
    fits = lambda x: x if x < 1 << 63 else None
    true = brute(rows)
    known = all(fits(r[2]) is not None for r in true)
    for r in vector_codes.code_digests(table(spark, rows, "double")).collect():
        _, code, error, label_error, sha = true[r.vec_id]
        assert (r.code, r.error, r.codebooks_sha256) == (code, fits(error), sha)
        assert r.label_error == (fits(label_error) if known else None) or not known


def test_decoded_vectors_are_near(spark, rows):
    codes, books = vector_codes.encode(table(spark, rows[:300]), rounds=3)
    by_id = {r.vec_id: r for r in vector_codes.decode(codes, books).collect()}
    vectors = {i: v for i, v, _ in rows[:300]}
    for i, r in by_id.items():
        apart = sum((4096 * (a - b)) ** 2 for a, b in zip(vectors[i], r.approximation, strict=True))
        assert abs(apart - r.error) <= 16 * (4 * math.sqrt(r.error) + 4)


def test_sql_agrees(spark, tmp_path):
    source = "/root/testdata/sf0.001/embeddings.parquet"
    duckdb.sql(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{source}'")
    true = Counter(duckdb.sql(vector_codes.ORACLE).fetchall())
    assert Counter(map(tuple, vector_codes.code_digests(spark.read.parquet(source)).collect())) == true
