"""Byte-level BPE by rank: encoding with a hierarchical-bitmap rank queue, and decoding.

``encode_decode`` maps every text to its ids in one pass over the input: no shuffle, no state beyond
the rank table and a bounded memo of pre-tokens in each Python worker.

Defined cases: a null or empty text has no ids; text that is not valid Unicode was already replaced by
Spark's string reader; repeated rows give repeated results; an empty table gives an empty result;
further columns of the input are ignored; a rank file with ranks above 65,535 is a ValueError; a very long text is
split and merged pre-token by pre-token.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pre-tokens in each of the two generations of a worker's memo. By a count of the words between white space of 48,000
#: texts, 250,000 would forget half as many again before they come back.
MEMO_ENTRIES = 600_000
#: Longer pre-tokens are merged each time and never kept.
MEMO_BYTES = 64


class RankQueue:
    """A priority queue of merge ranks for linked-list positions.

    Each rank owns a bucket: a position, or a heap of several (equal ranks merge from the left). A leaf
    word has a bit for each of 256 ranks whose bucket holds something, the root word a bit for each leaf
    word that isn't zero; the next rank is found by two find-first-set steps. The queue drains with each
    pre-token and is used again.
    """

    def __init__(self, n_ranks: int):
        self.leaf = [0] * ((n_ranks >> 8) + 1)
        self.root = 0
        self.buckets: dict[int, int | list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.buckets[rank] = position
            self.leaf[rank >> 8] |= BITS[rank & 255]
            self.root |= BITS[rank >> 8]
        elif type(bucket) is int:
            self.buckets[rank] = [bucket, position] if bucket < position else [position, bucket]
        else:
            heappush(bucket, position)

    def pop(self) -> tuple[int, int] | None:
        """The least rank and its leftmost position."""
        root = self.root
        if not root:
            return None
        top = (root & -root).bit_length() - 1
        word = self.leaf[top]
        low = word & -word
        rank = (top << 8) + low.bit_length() - 1
        bucket = self.buckets[rank]
        if type(bucket) is not int:
            position = heappop(bucket)
            if len(bucket) == 1:
                self.buckets[rank] = bucket[0]
            return rank, position
        del self.buckets[rank]
        self.leaf[top] = word = word ^ low
        if not word:
            self.root = root ^ BITS[top]
        return rank, bucket


#: Single bits; 256 leaf words of 256 ranks are the most a queue can have.
BITS = [1 << i for i in range(256)]


class ByteBpe:
    """Ranks of a rank file, with the pattern that splits text before the merges."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        if max(ranks.values()) >= len(BITS) ** 2:
            raise ValueError(f"ranks above {len(BITS) ** 2 - 1} don't fit the queue of ranks")
        self.ranks = ranks
        self.words = {i: b for b, i in ranks.items()}
        self.decimals = {i: str(i) for i in self.words}
        self.split = regex.compile(pattern).findall
        self.queue = RankQueue(max(ranks.values()) + 1)
        self.memo: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token: a token itself if the table has it whole, else by lowest rank first."""
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        after = list(range(1, n + 1))  # where the part that starts here ends
        before = list(range(-1, n - 1))  # where the part that ends here starts
        paired: list[int | None] = [None] * n  # rank of the part here joined with the next; None: no pair
        # push and pop of the queue, written out: they are most of the work
        queue = self.queue
        buckets, leaf, root, share, get = queue.buckets, queue.leaf, 0, queue.push, ranks.get
        for i in range(n - 1):
            rank = get(piece[i : i + 2])
            if rank is not None:
                paired[i] = rank
                if rank in buckets:
                    share(rank, i)
                else:
                    buckets[rank] = i
                    leaf[rank >> 8] |= BITS[rank & 255]
                    root |= BITS[rank >> 8]
        while root:
            top = (root & -root).bit_length() - 1
            word = leaf[top]
            low = word & -word
            rank = (top << 8) + low.bit_length() - 1
            i = buckets[rank]
            if type(i) is int:
                del buckets[rank]
                leaf[top] = word = word ^ low
                if not word:
                    root ^= BITS[top]
            else:
                bucket = i
                i = heappop(bucket)
                if len(bucket) == 1:
                    buckets[rank] = bucket[0]
            if paired[i] != rank:  # stale: one of its parts was merged meanwhile
                continue
            gone = after[i]
            end = after[gone]
            after[i] = end
            paired[gone] = None
            if end < n:
                before[end] = i
                rank = paired[i] = get(piece[i : after[end]])
                if rank is not None:
                    if rank in buckets:
                        share(rank, i)
                    else:
                        buckets[rank] = i
                        leaf[rank >> 8] |= BITS[rank & 255]
                        root |= BITS[rank >> 8]
            else:
                paired[i] = None
            j = before[i]
            if j >= 0:
                rank = get(piece[j:end])
                if rank != paired[j]:
                    paired[j] = rank
                    if rank is not None:
                        if rank in buckets:
                            share(rank, j)
                        else:
                            buckets[rank] = j
                            leaf[rank >> 8] |= BITS[rank & 255]
                            root |= BITS[rank >> 8]
        ids, i = [], 0
        while i < n:
            ids.append(ranks[piece[i : after[i]]])
            i = after[i]
        return ids

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        memo = self.memo
        for token in self.split(text):
            known = memo.get(token)
            if known is None:
                known = self.older.get(token) or tuple(self.merge(token.encode("utf-8")))
                if len(token) <= MEMO_BYTES:
                    if len(memo) >= MEMO_ENTRIES:  # what isn't used again goes with its generation
                        self.older = memo
                        memo = self.memo = {}
                    memo[token] = known
            ids += known
        return ids

    def said(self, ids: list[int]) -> bytes:
        """Decimal ids joined by commas."""
        return ",".join(map(self.decimals.__getitem__, ids)).encode()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.words.__getitem__, ids))


@lru_cache(maxsize=2)
def load(path: str, pattern: str) -> ByteBpe:
    """Reads a rank file once in each worker."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    return ByteBpe(ranks, pattern)


def encode_decode(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """doc_id, ids (array of int), decoded (binary) of every row's whole text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = load(rank_file, pattern)
        for batch in batches:
            ids = [bpe.encode(t) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "ids": ids, "decoded": [bpe.decode(i) for i in ids]})

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInPandas(run, f"doc_id {kind}, ids array<int>, decoded binary")


def encode_digests(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """As ``encode_decode``, with digests made where the ids are instead of the ids and bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = load(rank_file, pattern)
        for batch in batches:
            counts, of_ids, of_bytes = [], [], []
            for text in batch["text"]:
                ids = bpe.encode(text)
                counts.append(len(ids))
                of_ids.append(hashlib.sha256(bpe.said(ids)).hexdigest())
                of_bytes.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_tokens": counts, "ids_sha256": of_ids, "decoded_sha256": of_bytes})

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInPandas(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
