import hashlib
import math
import random
import zlib

import numpy as np

from chronolake.llm import language_id

SYLLABLES = {
    "aa": ["ka", "lo", "mi", "tes"],
    "ab": ["ka", "lo", "mi", "rup"],
    "ba": ["zwö", "fix", "grt", "sol"],
    "bb": ["zwö", "fix", "grt", "ñan"],
}


def rows(n=400, seed=1):
    rng = random.Random(seed)
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        words = ["".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(20, 80))]
        yield i, " ".join(words).capitalize() + ".", lang, "s"


def table(spark, data):
    return spark.createDataFrame(data, "doc_id long, text string, lang string, score string")


def test_held_out_accuracy_and_odd_rows(spark):
    data = list(rows())
    odd = [(1000, None, "aa", None), (1001, "", "aa", None), (1002, "12 ?! …", "ab", None), (1003, "KA LO 7 " * 20_000, None, "x"), (None, "zwö fix ñan ñan", None, None), data[0]]
    out = language_id.predictions(table(spark, data + odd)).collect()
    assert len(out) == len(data) + len(odd)
    by_id = {r.doc_id: r for r in out}
    for i in (1000, 1001, 1002):
        assert (by_id[i].lang_pred, by_id[i].score) == ("und", 0.0)
    assert by_id[1003].lang_pred in ("aa", "ab") and by_id[None].lang_pred == "bb"
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0) for r in out)
    tested = [by_id[i].lang_pred == lang for i, _, lang, _ in data if by_id[i].held_out]
    assert sum(tested) >= 0.97 * len(tested) > 40


def test_families_hold_the_languages_that_are_alike():
    data = list(rows())
    model = language_id.fit(np.stack([language_id.features(t) for _, t, _, _ in data]), [x for _, _, x, _ in data])
    assert sorted(model.families) == [["aa", "ab"], ["ba", "bb"]]


def test_few_languages_and_rows(spark):
    one = [(i, "la la", "xx", None) for i in range(1, 9)] + [(50, None, None, None)]
    assert {(r.lang_pred, r.score) for r in language_id.predictions(table(spark, one)).collect()} == {("xx", 1.0), ("und", 0.0)}
    none = [(i, "la la", None, None) for i in range(3)]
    assert {r.lang_pred for r in language_id.predictions(table(spark, none)).collect()} == {"und"}
    assert language_id.predictions(table(spark, one).limit(0)).count() == 0


def test_stage_keeps_what_has_a_language(spark):
    data = list(rows(120)) + [(1000, None, "aa", None), (1001, "12", "aa", None)]
    rng = random.Random(4)
    data += [(2000 + i, "".join(rng.choice("bcdhjnpqvw ") for _ in range(300)), None, None) for i in range(5)]
    data += [(3000, "съешь же ещё этих мягких булок да выпей чаю " * 3, None, None)]
    kept = language_id.keep_identified(table(spark, data))
    assert kept.columns == ["doc_id", "text", "lang", "score"]
    assert sorted(r.doc_id for r in kept.collect()) == list(range(120))


def test_predictions_equal_a_plain_reading_of_the_method(spark):
    """One text at a time: its n-grams counted in a dict, the family of highest value, votes of pairs."""
    data = list(rows(150, 3))
    docs = table(spark, data)
    model = language_id.learn(docs)
    learned = [(language_id.features(t), x) for i, t, x, _ in data if zlib.crc32(str(i).encode()) % 5]
    again = language_id.fit(*_in_order(learned))
    assert again.families == model.families and np.allclose(again.of_family, model.of_family, atol=1e-4)
    told = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predictions(docs, model).collect()}
    for i, text, _, _ in data[:40]:
        x = plain_features(text)
        values = [float(np.dot(w[:-1], x) + w[-1]) for w in model.of_family]
        sure = [1 / (1 + math.exp(-4 * v)) for v in values]
        family = max(range(len(values)), key=lambda f: values[f])
        names = model.families[family]
        votes, certain = dict.fromkeys(names, 0), dict.fromkeys(names, 0.0)
        for (a, b), w in zip(model.pairs[family], model.of_pairs[family], strict=True):
            p = 1 / (1 + math.exp(-4 * float(np.dot(w[:-1], x) + w[-1])))
            votes[names[a if p >= 0.5 else b]] += 1
            certain[names[a]] += p / (len(names) - 1)
            certain[names[b]] += (1 - p) / (len(names) - 1)
        best = max(names, key=lambda n: (votes[n] + certain[n] / 2))
        score = sure[family] / sum(sure) * (certain[best] if len(names) > 1 else 1)
        assert told[i][0] == best and abs(told[i][1] - score) < 1e-3


def _in_order(learned):
    learned = sorted(learned, key=lambda r: (r[1], hashlib.blake2b(r[0].tobytes(), digest_size=16).digest()))
    return np.stack([x for x, _ in learned]), [n for _, n in learned]


def plain_features(text):
    """Counts of hashed n-grams, by a loop over places."""
    data = b" " + b" ".join("".join(c.lower() if "A" <= c <= "Z" else c if c.isalpha() or ord(c) >= 128 else " " for c in text).encode().split()) + b" "
    counts = np.zeros(language_id.BUCKETS)
    for n in range(language_id.ORDERS):
        for at in range(len(data) - n):
            x = 0
            for k in range(n + 1):
                x = x + data[at] + 1 if k == 0 else x ^ (data[at + k] * language_id._MULTIPLIERS[k] & 0xFFFFFFFF)
                x = x * 0x01000193 & 0xFFFFFFFF
                x ^= x >> 15
            counts[((x * 0x2C1B3C6D) & 0xFFFFFFFF) >> 20] += 1
    return np.sqrt(counts / counts.sum())


def test_a_language_of_repeats_and_more_languages_than_the_sample(spark, monkeypatch):
    monkeypatch.setattr(language_id, "SAMPLE", 2)
    data = [(1, "zwö fix grt", "rep", "s")] * 3000 + [(2, "ka lo mi", "aa", "s")] * 2 + [(3, "x", "bb", "s")]
    assert language_id.learn(table(spark, data)).families == [["aa", "rep"]]


def test_groups_by_average_likeness():
    rng = np.random.default_rng(3)
    for _ in range(30):
        n = int(rng.integers(1, 12))
        profile = rng.random((n, 5))
        profile /= np.sqrt((profile * profile).sum(axis=1, keepdims=True))
        true = [[i] for i in range(n)]
        while len(true) > (n + 1) // 2:
            i, j = max(((i, j) for i in range(len(true)) for j in range(i + 1, len(true))), key=lambda p: np.mean(profile[true[p[0]]] @ profile[true[p[1]]].T))
            true[i] += true.pop(j)
        assert sorted(map(sorted, language_id.grouped(profile, (n + 1) // 2))) == sorted(map(sorted, true))


def test_more_languages_than_are_learned(spark):
    """5000 languages of a text each: the 4000 that sort first are learned, and nothing breaks."""
    letters = "abcdefghij"
    rows = [(i, " ".join([letters[int(d)] * 3 for d in f"{i:05d}"] * 2), f"l{i:05d}") for i in range(6300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").where(language_id.fold(language_id.F.col("doc_id")) != 0)
    assert docs.count() > 5000
    model = language_id.learn(docs)
    assert sum(map(len, model.families)) == 4000
    out = language_id.predictions(docs.orderBy("lang").limit(200), model).collect()
    assert len(out) == 200 and all(0 <= r.score <= 1 and r.lang_pred.startswith("l") for r in out)
