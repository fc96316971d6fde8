"""Best-fit packing of token pieces into sequences of bounded length.

1. ``token_pieces`` tokenises each whole text once and cuts what is longer than a sequence.
2. ``pack_pieces`` deals the pieces at random (seeded) into groups of about ``GROUP_PIECES`` and packs each group
   by bounded-space best fit as the pieces arrive, ``ARRIVALS`` at a time, the longest of these first: at
   most ``open_bins`` bins are open, filed in a bitset by their free space; a piece goes to the open bin
   that it leaves fullest, and where there is no room to open another bin the fullest closes first. A bin
   without free space closes at once.

Groups hold the same number of pieces whatever the size of the corpus or of any source, so tasks grow
in number and not in length; what a group wastes is less than a bin or two.

Defined cases: a null or empty text is one piece holding only the end id; a document longer than a
sequence is cut into full pieces and a last shorter one; repeated rows are packed as often as they
come; an empty table gives an empty result; further input columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolake.llm.common import claim, materialise

SEQUENCE = 2048
#: Appended to each document.
END_ID = 0
#: Pieces in a group that one call packs.
GROUP_PIECES = 16_384
#: Bins open at once in a group, and pieces that arrive together, longest first.
OPEN_BINS, ARRIVALS = 512, 1024
#: Bytes, as reckoned, of each of the two generations of a worker's memo of words. Much of the time goes into words that
#: were forgotten before they came back: with 32 MB more than half of it.
MEMO_BYTES = 144 << 20
#: What an entry of the memo takes beside the characters and ids that it holds.
ENTRY_BYTES = 160
#: Texts whose unknown words are looked up together.
TEXTS = 256
_BLANK = re.compile(r"[\n\r\t]")


class WordTokenizer:
    """The tokenizer, with a memo of the words between blanks, bounded in bytes, in two generations.

    No token of this vocabulary spans white space, so a text's ids are those of its words in turn. A word
    that isn't known is taken apart first: punctuation after letters is a token of its own, and case is
    ignored, so most such words need no call of the tokenizer. This holds for letters that the tokenizer
    reads as letters; some are normalised to a letter and a mark, and words with these are encoded whole,
    one by one."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.bytes = 0
        tokens = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(tokens.values()) + 1, bool)  # tokens that end a word
        self.ends[[i for t, i in tokens.items() if t.endswith("</w>")]] = True
        self.tried: set[str] = set()
        self.broken: set[str] = set()  # letters that the tokenizer doesn't read as letters

    def _ids(self, words: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _try(self, letters: set[str]) -> None:
        """Notes which letters don't stay letters between two others once they are normalised."""
        for c in letters:
            self.tried.add(c)
            ends = self.ends[self._ids([f"x{c}x"])[0]]
            if c.isalpha() and not (ends[-1] and ends.sum() == 1):
                self.broken.add(c)

    def _parts(self, word: str) -> tuple[tuple[str, bool], ...]:
        """What a word's ids are put together from, and whether each is a run of letters."""
        stem = word.rstrip(".,;:!?")
        if not stem.isalpha() or not self.broken.isdisjoint(stem):
            return ((word, False),)
        if stem.isascii():
            stem = stem.lower()
        return ((stem, True), (word[len(stem) :], False)) if len(stem) < len(word) else ((stem, True),)

    def _learn(self, words: list[str]) -> None:
        memo, older = self.memo, self.older
        if new := set("".join(words)) - self.tried:
            self._try(new)
        before, parts, fresh = len(memo), {}, {}
        for word in words:
            known = older.get(word)
            if known is not None:
                memo[word] = known
                continue
            parts[word] = found = self._parts(word)
            for x, letters in found:
                if x not in memo:
                    known = older.get(x)
                    if known is None:
                        fresh[x] = letters
                    else:
                        memo[x] = known
        # runs of letters are read as one text: each ends with the next token that ends a word
        runs = [x for x, letters in fresh.items() if letters]
        ids = np.asarray(self._ids([" ".join(runs)])[0], dtype="<u4")
        ends = np.flatnonzero(self.ends[ids])
        if len(ends) == len(runs):
            data, at = ids.tobytes(), 0
            for word, end in zip(runs, (4 * ends + 4).tolist(), strict=True):
                memo[word] = data[at:end]
                at = end
        todo = [x for x in fresh if x not in memo]
        for word, found in zip(todo, self._ids(todo), strict=True):
            memo[word] = np.asarray(found, dtype="<u4").tobytes()
        for word, found in parts.items():
            if word not in memo:
                memo[word] = b"".join([memo[x] for x, _ in found])
        added = list(islice(reversed(memo), len(memo) - before))
        self.bytes += ENTRY_BYTES * len(added) + sum(map(len, added)) + sum(map(len, map(memo.__getitem__, added)))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit words."""
        words = [_BLANK.sub(" ", t).split(" ") for t in texts]
        if self.bytes > MEMO_BYTES:  # what isn't used again goes with its generation
            self.older, self.memo, self.bytes = self.memo, {}, 0
        fresh = [w for w in set().union(*words) if w not in self.memo]
        if fresh:
            self._learn(fresh)
        known = self.memo.__getitem__
        return [b"".join(map(known, ws)) for ws in words]


@lru_cache(maxsize=1)
def word_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def token_pieces(docs: DataFrame, vocabulary: str, sequence: int = SEQUENCE, with_ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if ``with_ids``, ids (array of int) of each piece."""
    end = np.asarray([END_ID], dtype="<u4").tobytes()
    kinds = {"piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64()}
    if with_ids:
        kinds["ids"] = pa.list_(pa.int32())

    def pieces_of(ids: bytes) -> Iterator[tuple]:
        data = ids + end
        for at in range(0, len(data), 4 * sequence):
            part = data[at : at + 4 * sequence]
            row = (at // (4 * sequence), at // 4, len(part) // 4, zlib.crc32(part))
            yield (*row, np.frombuffer(part, dtype="<u4").astype("int32")) if with_ids else row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("packing", word_tokenizer.cache_clear)
        encode = word_tokenizer(vocabulary).encode
        for batch in batches:
            for low in range(0, batch.num_rows, TEXTS):
                part = batch.slice(low, TEXTS)
                owners, rows = [], []
                for at, ids in enumerate(encode(part["text"].to_pylist())):
                    before = len(rows)
                    rows += pieces_of(ids)
                    owners += [at] * (len(rows) - before)
                columns = [pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds.values(), strict=True)]
                yield pa.RecordBatch.from_arrays([part["doc_id"].take(pa.array(owners)), *columns], ["doc_id", *kinds])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, schema)


def best_fit(lengths: list[int], sequence: int = SEQUENCE, open_bins: int = OPEN_BINS) -> list[tuple[int, int]]:
    """(bin, offset) of each piece, in the order given; no more than ``open_bins`` bins are open at once."""
    by_free: list[list[int]] = [[] for _ in range(sequence + 1)]
    free_bits = 0  # bit f: some open bin has f places free
    n_open = n_bins = 0
    out = []
    for length in lengths:
        fits = free_bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            bin_id = by_free[free].pop()
            if not by_free[free]:
                free_bits ^= 1 << free
        else:
            if n_open == open_bins:  # the fullest closes
                fullest = (free_bits & -free_bits).bit_length() - 1
                by_free[fullest].pop()
                if not by_free[fullest]:
                    free_bits ^= 1 << fullest
                n_open -= 1
            free, bin_id = sequence, n_bins
            n_bins += 1
            n_open += 1
        out.append((bin_id, sequence - free))
        left = free - length
        if left:
            by_free[left].append(bin_id)
            free_bits |= 1 << left
        else:
            n_open -= 1
    return out


def pack_pieces(pieces: DataFrame, sequence: int = SEQUENCE, open_bins: int = OPEN_BINS, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """``pieces`` (with a long column length, from 1 to ``sequence``) with sequence_id and offset.

    ``pieces`` should be a stored table: it is counted, then read once more. Pieces are dealt by a
    seeded random number, which a stored table repeats when a lost task runs again, as a hash of their
    columns would send repeated rows to one group."""
    groups = max(1, -(-pieces.count() // group_pieces))
    columns = pieces.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        arrival = np.arange(len(group)) // ARRIVALS
        group = group.iloc[np.lexsort((-group["length"].to_numpy(), arrival))]
        placed = best_fit(group["length"].tolist(), sequence, open_bins)
        base = int(key[0]) << 32
        return group[columns].assign(sequence_id=[base + b for b, _ in placed], offset=[o for _, o in placed])

    spread = F.floor(F.rand(7) * groups)
    return pieces.withColumn("_group", spread).groupBy("_group").applyInPandas(run, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: str, with_ids: bool = False) -> DataFrame:
    """Pieces of all ``docs`` with their places; tokenised once, the pieces stored before they are dealt."""
    return pack_pieces(materialise(token_pieces(docs, vocabulary, SEQUENCE, with_ids), "pieces"))
