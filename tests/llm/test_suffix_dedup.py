import hashlib
import random
from collections import Counter

import pytest

from chronolake.llm import suffix_dedup
from chronolake.llm.suffix_dedup import LENGTH


def brute(texts, LENGTH=LENGTH):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + LENGTH] for d in data for i in range(len(d) - LENGTH + 1))
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - LENGTH + 1):
            if seen[d[i : i + LENGTH]] > 1:
                gone[i : i + LENGTH] = b"\1" * LENGTH
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        yield len(d), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(d, gone, strict=True) if not g)).hexdigest()


def texts():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdeéü漢") for _ in range(rng.randrange(2, 7))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = prose(500)
    out = [prose(rng.randrange(1, 400)) for _ in range(40)] + [base, base, base]
    for _ in range(25):  # near copies
        w = base.split(" ")
        for _ in range(rng.randrange(1, 6)):
            w[rng.randrange(len(w))] = "edit" + str(rng.random())
        out.append(" ".join(w))
    passages = [prose(90), prose(120), "x" * 400, "y" * 399]
    for i in range(30):
        out.append(prose(rng.randrange(30)) + " " + passages[i % 4] + " " + prose(rng.randrange(30)))
    out += ["z" * 3000, "ab" * 700, None, "", None, passages[0], base[:450] + base[:450], base[7:430], "a" * 400, "a" * 401]
    return out


@pytest.mark.parametrize("hot", [512, 3])
def test_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "CHUNK", 1 << 19 if hot == 512 else 1500)
    suffix_dedup._powers.cache_clear()
    rows = texts()
    docs = spark.createDataFrame([(i % 110, t, 1, "k") for i, t in enumerate(rows)], "doc_id long, text string, n_bytes int, k1 string")
    got = Counter(tuple(r) for r in suffix_dedup.removal_digests(docs.repartition(5)).collect())
    shared = [n for _, n, _, _ in brute(rows, suffix_dedup.PASSAGE)]
    assert got == Counter((i % 110, *b, n) for (i, b), n in zip(enumerate(brute(rows)), shared, strict=True))


@pytest.mark.parametrize("hot", [512, 3])
def test_groups_hold_all_occurrences(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, size int")
    data = {i: (t or "").encode() for i, t in rows}
    groups = {}
    for r in suffix_dedup.repeat_groups(docs.repartition(3), 200).collect():
        groups.setdefault((r.repeat, r["size"]), []).append((r.doc_id, r.start))
    under = {i: bytearray(len(d)) for i, d in data.items()}
    for (_, size), places in groups.items():
        (string,) = {data[i][at : at + size] for i, at in places}
        assert len(string) == size >= 200
        true = []
        for i, d in data.items():
            at = d.find(string)
            while at >= 0:
                true.append((i, at))
                under[i][at : at + size] = b"\1" * size
                at = d.find(string, at + 1)
        assert sorted(places) == sorted(true) and len(true) > 1
    assert [sum(u) for u in under.values()] == [n for _, n, _, _ in brute([t for _, t in rows], 200)]


def test_maximal_repeats_equal_brute_force():
    rng = random.Random(5)
    for _ in range(200):
        fragments = {"".join(rng.choice("ab") for _ in range(rng.randrange(7))) + "#" + "".join(rng.choice("ab") for _ in range(rng.randrange(7))) for _ in range(rng.randrange(1, 12))}
        given = [(f.encode(), f.index("#")) for f in sorted(fragments)]
        holders = {}
        for i, (f, at) in enumerate(given):
            for left in range(at + 1):
                for right in range(1, len(f) - at + 1):
                    holders.setdefault((left, f[at - left : at + right]), set()).add(i)
        true = set()
        for (left, string), own in holders.items():
            right = len(string) - left
            before = {given[i][0][given[i][1] - left - 1 : given[i][1] - left] if given[i][1] > left else i for i in own}
            after = {given[i][0][given[i][1] + right : given[i][1] + right + 1] or i for i in own}
            if len(string) >= 4 and len(own) > 1 and len(before) > 1 and len(after) > 1:
                true.add((left, right, frozenset(own)))
        got = [(left, right, frozenset(own)) for left, right, own in suffix_dedup.maximal_repeats(given, 4)]
        assert len(got) == len(set(got)) and set(got) == true


def test_chunks_agree_with_the_whole(monkeypatch):
    data = " ".join(texts()[40:60]).encode()
    whole = {(h, p) for _, _, p, h in suffix_dedup.segments(data)}
    starts = [s for a, b, _, _ in suffix_dedup.segments(data) for s in range(a, b + 1)]
    assert starts == list(range(len(data) - LENGTH + 1))
    monkeypatch.setattr(suffix_dedup, "CHUNK", 777)
    suffix_dedup._powers.cache_clear()
    assert {(h, p) for _, _, p, h in suffix_dedup.segments(data)} == whole
    monkeypatch.undo()
    suffix_dedup._powers.cache_clear()


def test_extensions_are_the_longest():
    rng = random.Random(9)
    for _ in range(60):
        n = rng.randrange(1, 14)
        fragments = [("".join(rng.choice("ab") for _ in range(rng.randrange(8))) + "#" + "".join(rng.choice("ab") for _ in range(rng.randrange(8)))) for _ in range(n)]
        given = [(f.encode(), f.index("#")) for f in fragments]
        for i, pairs in enumerate(suffix_dedup.extensions(given, 4)):
            got = {(d, r) for left, right in pairs for d in range(left + 1) for r in range(right + 1) if d + r >= 4}
            true = set()
            for j, (f, o) in enumerate(given):
                if i != j:
                    left = suffix_dedup.common_prefix(given[i][0][: given[i][1]][::-1], f[:o][::-1])
                    right = suffix_dedup.common_prefix(given[i][0][given[i][1] :], f[o:])
                    true |= {(d, r) for d in range(left + 1) for r in range(right + 1) if d + r >= 4}
            assert got == true


def test_texts_without_repeats_stay(spark):
    rows = [(1, "é" * 300, "en", None), (2, "é" * 300 + "b", "fr", 4), (3, None, None, None), (None, "short", "de", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, removed string, n_chars long").drop("removed")
    out = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs).collect()}
    assert out[1].text == "" and out[2].text == "b" and out[3].text is None and out[None].text == "short"
    assert [tuple(x) for x in out[2].removed] == [(0, 600)] and out[None].n_chars == 5
    assert suffix_dedup.remove_repeats(docs.limit(0)).count() == 0
