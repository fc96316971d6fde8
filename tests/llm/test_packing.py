import random
import sys
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from chronolake.llm import packing

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def expected_pieces(rows):
    peer = Tokenizer.from_file(VOCABULARY)
    peer.encode_special_tokens = True
    for doc_id, text in rows:
        ids = peer.encode(text or "", add_special_tokens=False).ids + [0]
        for at in range(0, len(ids), 2048):
            part = ids[at : at + 2048]
            yield doc_id, at // 2048, at, len(part), zlib.crc32(np.asarray(part, "<u4").tobytes())


def test_pieces_and_places(spark):
    words = ["Straße", "naïve,", "don't", "x1y22", "漢字", "é", " a b", "<|endoftext|>", "THE", "…", "a\x1cb"]
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(rng.choice(words, rng.integers(1, 60))) + "\n\t z") for i in range(200)]
    rows += [(900, None), (901, ""), (902, "word " * 9000), (903, "q" * 30_000), (5, rows[5][1]), (None, "null id")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, length int")
    out = packing.pack_documents(docs, VOCABULARY, with_ids=True).toPandas()
    key = lambda r: tuple(-1 if x is None or x != x else int(x) for x in r)
    got = sorted(map(key, out[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False)))
    assert got == sorted(map(key, expected_pieces(rows)))
    for _, bin_rows in out.sort_values("offset").groupby("sequence_id"):
        assert bin_rows["offset"].tolist() == [0, *bin_rows["length"].cumsum()[:-1]]
        assert bin_rows["length"].sum() <= 2048
    assert out["sequence_id"].nunique() <= -(-out["length"].sum() // 2048) + 1
    assert all(len(i) == n for i, n in zip(out["ids"], out["length"], strict=True))
    assert packing.pack_documents(docs.limit(0), VOCABULARY).count() == 0


def test_words_of_all_letters():
    peer, tokenizer = Tokenizer.from_file(VOCABULARY), packing.WordTokenizer(VOCABULARY)
    rng, letters = random.Random(5), [c for c in map(chr, range(sys.maxunicode + 1)) if c.isalpha()]
    texts = [" ".join(f"{c} x{c}y. {c}," for c in letters[at : at + 50]) for at in range(0, len(letters), 50)]
    texts += ["İstanbul is a city", "क़लम, ড়", "".join(tokenizer.broken) + "!"]
    texts += [" ".join("".join(rng.choices(letters, k=rng.randrange(1, 6))) + rng.choice([".", "", "?!"]) for _ in range(30)) for _ in range(200)]
    for at in range(0, len(texts), 300):
        part = texts[at : at + 300]
        true = peer.encode_batch(part, add_special_tokens=False)
        assert [np.frombuffer(x, "<u4").tolist() for x in tokenizer.encode(part)] == [x.ids for x in true]
    assert len(tokenizer.broken) == 60


def test_the_memo_is_bounded(monkeypatch):
    monkeypatch.setattr(packing, "MEMO_BYTES", 20_000)
    peer, tokenizer, rng = Tokenizer.from_file(VOCABULARY), packing.WordTokenizer(VOCABULARY), random.Random(6)
    for _ in range(40):
        part = [" ".join("w" + "abcdefgh"[rng.randrange(8)] * rng.randrange(1, 4) + str(rng.randrange(400)) for _ in range(40)) for _ in range(4)]
        assert [np.frombuffer(x, "<u4").tolist() for x in tokenizer.encode(part)] == [x.ids for x in peer.encode_batch(part, add_special_tokens=False)]
        assert len(tokenizer.memo) < 700 and len(tokenizer.older) < 700


def test_few_bins_beyond_the_least():
    rng = np.random.default_rng(4)
    lengths = np.minimum(rng.lognormal(6.3, 1, 16_384).astype(int) + 1, 2048)
    runs = [sorted(lengths[at : at + packing.ARRIVALS].tolist(), reverse=True) for at in range(0, len(lengths), packing.ARRIVALS)]
    used = max(b for b, _ in packing.best_fit([n for run in runs for n in run], open_bins=packing.OPEN_BINS)) + 1
    assert used <= 1.005 * lengths.sum() / 2048 + 1


def test_bounded_open_bins_close_the_fullest():
    lengths = np.random.default_rng(1).integers(1, 2049, 4000).tolist()
    for open_bins in (1, 4, 4096):
        used = {}
        for (bin_id, offset), length in zip(packing.best_fit(lengths, open_bins=open_bins), lengths, strict=True):
            assert used.get(bin_id, 0) == offset
            used[bin_id] = offset + length
        assert max(used.values()) <= 2048
    # the bin with 900 places left closes when a third is opened
    assert packing.best_fit([1148, 1000, 1500, 500, 900], open_bins=2) == [(0, 0), (1, 0), (2, 0), (2, 1500), (1, 1000)]


def test_hundreds_of_thousands_of_words_are_looked_up_once(monkeypatch):
    tokenizer, asked = packing.WordTokenizer(VOCABULARY), []
    monkeypatch.setattr(tokenizer, "_ids", lambda words: asked.extend(words) or [[1]] * len(words))
    texts = [" ".join(map(str, range(at, at + 10_000))) for at in range(0, 400_000, 10_000)]
    for text in texts:
        tokenizer.encode([text])
    before = len(asked)
    assert before >= 400_000
    for text in texts:
        assert tokenizer.encode([text]) == [b"\1\0\0\0" * 10_000]
    assert len(asked) == before
