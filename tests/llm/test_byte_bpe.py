import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from chronolake.llm import byte_bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def peer():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(5)
    alphabet = "abcdefgh ABC 0123 éèüßñ 漢字 \n\t'st 're!?$%&-_ 🙂"
    yield from ["", " ", "a", "it's we'll", "a" * 5000, "ab" * 3000, "漢" * 700, "\n\n\n x", "<|endoftext|>"]
    for _ in range(150):
        yield "".join(rng.choice(alphabet) for _ in range(rng.randrange(200)))
    yield "".join(rng.choice("abcde") for _ in range(20_000))  # one very long pre-token


def test_ids_equal_the_peer_library(peer):
    bpe = byte_bpe.load(PATH, public_tokenizers.PATTERN)
    for text in texts():
        ids = bpe.encode(text)
        assert ids == peer.encode_ordinary(text)
        assert bpe.decode(ids) == text.encode()


def test_queue_drains_in_rank_then_position_order():
    queue, rng = byte_bpe.RankQueue(50_256), random.Random(1)
    items = [(rng.randrange(50_256), rng.randrange(1000)) for _ in range(3000)]
    for rank, position in items:
        queue.push(rank, position)
    assert [queue.pop() for _ in items] == sorted(items)
    assert queue.pop() is None and not queue.root and not queue.buckets


def test_table(spark, peer):
    rows = [(1, "Hello wörld", "x"), (2, None, "y"), (None, "", None), (1, "Hello wörld", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = byte_bpe.encode_digests(docs, PATH, public_tokenizers.PATTERN).collect()
    expected = []
    for doc_id, text, _ in rows:
        ids = peer.encode_ordinary(text or "")
        sha = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        expected.append((doc_id, len(ids), sha, hashlib.sha256((text or "").encode()).hexdigest()))
    key = lambda r: (r[0] or 0, r[1], r[2])
    assert sorted(map(tuple, out), key=key) == sorted(expected, key=key)
    whole = byte_bpe.encode_decode(docs, PATH, public_tokenizers.PATTERN).collect()
    assert {r.decoded.decode() for r in whole} == {"Hello wörld", ""}
    assert byte_bpe.encode_digests(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_half_a_million_pre_tokens_are_merged_once(monkeypatch):
    bpe = byte_bpe.ByteBpe({bytes([i]): i for i in range(256)}, r"\w+")
    merged = []
    monkeypatch.setattr(bpe, "merge", lambda piece: merged.append(piece) or [1])
    texts = [" ".join(map(str, range(at, at + 11_000))) for at in range(0, 550_000, 11_000)]
    for text in texts + texts:
        bpe.encode(text)
    assert len(merged) == len(set(merged)) == 550_000
    assert bpe.said([1, 20, 3]) == b"1,20,3" and bpe.said([]) == b""
