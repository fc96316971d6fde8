import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from chronolake.llm import maxent_lm


def rows_(n=400):
    rng = random.Random(12)
    words = {k: ["".join(rng.choice(s) for _ in range(rng.randrange(1, 6))) for _ in range(150)] for k, s in (("a", "abcde"), ("b", "vwxyz"))}
    out = []
    for i in range(n):
        w = words[rng.choice("ab")]
        out.append((i, " ".join(w[min(int(rng.expovariate(0.05)), 149)] for _ in range(rng.randrange(1, 60)))))
    out += [(900, None), (901, ""), (902, " \t\n\x0b\x0c\r"), (903, "Été ÉTÉ x a\x1cb\x85c  "), (904, "abc " * 30_000), (None, "abc de"), out[3], (905, out[3][1])]
    return out


def brute(rows):
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = [[*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower)), None] for _, t in rows]
    c = Counter(w for (i, _), ws in zip(rows, tokens, strict=True) if not held(i) for w in ws)
    total = sum(c.values())
    for (i, _), ws in zip(rows, tokens, strict=True):
        yield i, held(i), len(ws), sum(c[w] > 0 for w in ws), total, sum(math.log10((c[w] + 0.5) / (total + 0.5 * (len(c) + 1))) for w in ws)


@pytest.mark.parametrize("head", [1 << 21, 60])
def test_base_scores_and_gain(spark, monkeypatch, head):
    monkeypatch.setattr(maxent_lm, "HEAD_WORDS", head)
    rows = rows_()
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, word string, n int")
    out = maxent_lm.scores(docs.repartition(3)).toPandas()
    true = sorted(brute(rows), key=lambda r: (-1 if r[0] is None else r[0], r[5]))
    got = out.assign(doc_id=out["doc_id"].fillna(-1)).sort_values(["doc_id", "base_score"])
    for r, t in zip(got.itertuples(), true, strict=True):
        assert (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (-1 if t[0] is None else t[0], *t[1:5])
        assert r.base_score == pytest.approx(t[5], rel=1e-9)
    ordinary = got[(got["doc_id"] >= 0) & (got["doc_id"] < 400) & got["held_out"]]
    assert ordinary["score"].sum() > 0.95 * ordinary["base_score"].sum()  # both are negative
    assert np.isfinite(out["score"]).all() and (out["score"] < 0).all()
    same = out[out["doc_id"].isin([3, 905])]["score"]
    assert len(same) == 3 and same.nunique() == 1


def learned(spark, n=120):
    rows = rows_(n)[:n]
    keyed = maxent_lm._keyed(spark.createDataFrame(rows, "doc_id long, text string"))
    model, rest = maxent_lm.learn(keyed)
    counts = Counter()
    for (_, t), k in zip(rows, keyed.collect(), strict=True):
        if not k.held_out:
            counts.update(maxent_lm.words_of(t.encode()))
    return model, rest, counts


def plain_log10(model, counts, words):
    """log10 probability of each word of a text and of its end, from the model's tables, one at a time."""
    hashes = {w: int(maxent_lm.word_hashes([w])[0]) for w in words}
    slots = dict(zip(model.hashes.tolist(), model.slots.tolist(), strict=True))
    classes = [int(model.classes[maxent_lm.ending(w)]) for w in words] + [maxent_lm.END_CLASS]
    for at, (word, cls) in enumerate(zip([*words, None], classes, strict=True)):
        def back(k, at=at):
            if at < k:
                return model.features, maxent_lm.START_CLASS, maxent_lm.WITHIN
            h = (hashes[words[at - k]] & 0x7FFFFFFF) % model.features
            return h, classes[at - k], h % maxent_lm.WITHIN

        (one, c1, r1), (two, c2, r2) = back(1), back(2)
        rows = [one, model.features + 1 + two, 2 * (model.features + 1) + c1 * (maxent_lm.CLASSES + 1) + c2, -1]
        x = [sum(float(model.weights[r, c]) for r in rows) for c in range(maxent_lm.CLASSES)]
        out = x[cls] - math.log(sum(map(math.exp, x)))
        kinds = zip(model.extras, (c1, r1, r2), strict=True)
        tables = [e[v * maxent_lm.CLASSES + cls] for e, v in kinds]
        y = [float(model.base[cls, k]) + sum(float(t[k]) for t in tables) for k in range(model.n_slots + 1)]
        slot = 0 if word is None else slots.get(hashes[word], model.n_slots)
        out += y[slot] - math.log(sum(math.exp(v) for v in y if v > -1e300))
        if slot == model.n_slots:
            out += math.log(counts[word] + 0.5) - math.log(model.tail_mass[cls])
        yield out / math.log(10)


def test_scores_equal_a_plain_reading_of_the_model(spark, monkeypatch):
    monkeypatch.setattr(maxent_lm, "SLOTS", 3)  # so that many words share their class's last item
    model, _, counts = learned(spark)
    assert model.mix.shape == (3, maxent_lm.CLASSES) and (model.mix != 0.5).any()
    reader = maxent_lm.Reader(model)
    texts = [t.encode() for _, t in rows_()[:30]] + [b"never seen before", b"", rows_()[3][1].encode()]
    other, sizes, _, _, found = maxent_lm.batch_scores(model, reader, texts)
    for text, rare, n, score in zip(texts, other, sizes, found, strict=True):
        words = maxent_lm.words_of(text)
        rest = sum(k * math.log10(counts[w] + 0.5) for w, k in rare.items())
        assert n == len(words) + 1 and score + rest == pytest.approx(sum(plain_log10(model, counts, words)), abs=1e-3)


def test_probabilities_sum_to_one(spark):
    model, _, counts = learned(spark)
    known = sorted(counts)
    for context in ([], [known[0]], [known[5], known[9]], [b"never-seen", known[2]]):
        of = lambda word, context=context: 10 ** list(plain_log10(model, counts, [*context, word]))[len(context)]
        total = 10 ** list(plain_log10(model, counts, context))[-1] + sum(map(of, known))
        # one unseen word of every class; the end's class has none
        new = {}
        for i in range(20_000):
            word = b"?%d" % i
            new.setdefault(int(model.classes[maxent_lm.ending(word)]), word)
        total += sum(of(w) for w in new.values())
        assert len(new) == maxent_lm.END_CLASS and total == pytest.approx(1, abs=1e-4)


def test_hashed_features_reach_the_words(spark):
    """Two words of one class whose use depends on the word before alone."""
    pairs = [("left", "xxing"), ("right", "yying")]
    rows = [(i, " ".join(" ".join(pairs[(i * 7 + k * k) % 2]) for k in range(30))) for i in range(300)]
    keyed = maxent_lm._keyed(spark.createDataFrame(rows, "doc_id long, text string"))
    model, _ = maxent_lm.learn(keyed)
    assert model.classes[maxent_lm.ending(b"xxing")] == model.classes[maxent_lm.ending(b"yying")]
    reader = maxent_lm.Reader(model)
    told = maxent_lm.batch_scores(model, reader, [b"left xxing", b"left yying", b"right yying", b"right xxing"])[-1]
    assert told[0] > told[1] + 1 and told[2] > told[3] + 1


def test_small_tables(spark):
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1][:2]
    none = spark.createDataFrame([(held[0], "a  B "), (held[1], None)], "doc_id long, text string")
    out = sorted(map(tuple, maxent_lm.scores(none).collect()))
    assert out == [(held[0], True, 3, 0, 0, 0.0, 0.0), (held[1], True, 1, 0, 0, 0.0, 0.0)]
    assert maxent_lm.scores(none.limit(0)).count() == 0


def test_the_context_model_is_whole_and_grows_with_the_corpus(spark, monkeypatch):
    assert maxent_lm.CLASSES >= 64 and maxent_lm.SLOTS >= 64
    monkeypatch.setattr(maxent_lm, "SLOTS", 2)
    monkeypatch.setattr(maxent_lm, "FEATURES", 32)
    monkeypatch.setattr(maxent_lm, "OFTEN", 0)
    docs = spark.createDataFrame(rows_()[:400], "doc_id long, text string")
    model, _ = maxent_lm.learn(maxent_lm._keyed(docs))
    words = model.train_words - 1
    assert words <= model.features < 2 * words and model.n_slots * maxent_lm.END_CLASS >= words
    assert model.weights.shape == (maxent_lm.n_rows(model.features), maxent_lm.CLASSES)
    out = maxent_lm.scores(docs).where("held_out").toPandas()
    assert out["score"].sum() > 0.95 * out["base_score"].sum()  # both are negative
    assert maxent_lm.sizes_of({-1: 10**9}) == (32, 2)
    assert maxent_lm.sizes_of({20: 10**9}) == (maxent_lm.MOST_FEATURES, maxent_lm.MOST_SLOTS)


def test_texts_are_split_by_arrow_as_one_by_one():
    rng = random.Random(3)
    texts = [bytes(rng.choice(b" \t\x0b\x1c\x00aB\xc3\x89\xff") for _ in range(rng.randrange(40))) for _ in range(300)] + [b"", b"  "]
    for some in (texts, [b""], [b" \r"]):
        distinct, codes, sizes = maxent_lm.split(some)
        words = [w for t in some for w in maxent_lm.words_of(t)]
        assert distinct.take(codes).to_pylist() == words and sizes.tolist() == [len(maxent_lm.words_of(t)) for t in some]
        assert maxent_lm.endings(distinct).tolist() == [maxent_lm.ending(w) for w in distinct.to_pylist()]
    hashes = maxent_lm.word_hashes(maxent_lm.split(texts)[0].to_pylist())
    assert len(set(hashes.tolist())) == len(set(w for t in texts for w in maxent_lm.words_of(t)))


def test_slices_hold_all_texts_within_their_bounds(monkeypatch):
    monkeypatch.setattr(maxent_lm, "BATCH", 3)
    monkeypatch.setattr(maxent_lm, "BATCH_BYTES", 10)
    texts = [b"x" * n for n in (1, 1, 1, 1, 9, 2, 30, 0, 10, 0, 0)]
    parts = [texts[p] for p in maxent_lm.slices(texts)]
    assert sum(parts, []) == texts and list(maxent_lm.slices([])) == []
    assert all(len(p) <= 3 and (len(p) == 1 or sum(map(len, p)) <= 10) for p in parts)


def test_rows_of_a_minibatch_are_summed_in_chains():
    rng = np.random.default_rng(1)
    p = rng.normal(size=(5000, 4)).astype("float32")
    for keys in (rng.zipf(1.3, 5000) % 900, np.full(5000, 7), np.arange(5000), np.arange(1)):
        order = np.argsort(keys, kind="stable")
        at, sums = maxent_lm._summed(p, order, keys[order])
        true = np.zeros((5000, 4))
        np.add.at(true, keys, p[: len(keys)])
        assert sorted(at) == sorted(set(keys.tolist())) and np.allclose(sums, true[at], atol=1e-3)


@pytest.mark.parametrize("size", [1, 60])
def test_softmax_by_products_of_powers(size):
    rng = np.random.default_rng(2)
    logs = [size * rng.uniform(-1, 1, (30, 9)).astype("float32") for _ in range(3)]
    logs[0][:, 4] = -np.inf
    rows, which = rng.integers(0, 30, (3, 1500)), rng.choice([0, 3, 8], 1500)
    soft = maxent_lm.Softmax(logs)
    assert soft.powers[0].dtype == ("float32" if size == 1 else "float64")
    x = sum(t[r].astype("float64") for t, r in zip(logs, rows, strict=True))
    true = x[np.arange(1500), which] - np.logaddexp.reduce(x, axis=1)
    assert np.allclose(soft.log_share(rows, which), true, atol=1e-4)


def test_slopes_take_equal_contexts_once(spark, monkeypatch):
    model, _, _ = learned(spark)
    model.mix = np.full((3, maxent_lm.CLASSES), 0.5)
    rng, n = np.random.default_rng(4), 3000
    classes, values = rng.integers(0, 3, n), np.stack([rng.integers(0, 4, n) for _ in maxent_lm.VALUES])
    slot = np.array([np.flatnonzero(np.isfinite(model.base[c]))[0] for c in classes])
    met, seen, plain = np.ravel_multi_index((classes, *values), (maxent_lm.CLASSES, *maxent_lm.VALUES)), [], maxent_lm._add_distinct
    monkeypatch.setattr(maxent_lm, "_add_distinct", lambda s, m, part, times: (seen.extend(part.tolist()), plain(s, m, part, times)))
    slopes = np.zeros(12 * maxent_lm.CLASSES)
    maxent_lm._add_own(slopes, model, values, classes, slot)
    maxent_lm._add_slopes(slopes, model, met)
    assert seen == sorted(set(met.tolist())) and len(seen) < 200
    true = np.zeros((4, 3, maxent_lm.CLASSES))
    for t, c in enumerate(classes):
        e = np.stack([x[v * maxent_lm.CLASSES + c] for x, v in zip(model.extras, values[:, t], strict=True)]).astype("float64")
        p = np.exp(model.base[c] + e.sum(axis=0) / 2)
        p /= p.sum()
        true[0, :, c] += e[:, slot[t]] - e @ p
        true[1:, :, c] += (e * p) @ e.T - np.outer(e @ p, e @ p)
    assert np.allclose(slopes, true.ravel(), atol=1e-2)
