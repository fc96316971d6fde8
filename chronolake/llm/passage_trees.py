"""Removal of repeated passages of words, by suffix trees over prefix partitions.

A window of ``window`` consecutive words is a copy if its word sequence also starts earlier: in a document that
comes before, or before it in its own. Every word that a copy covers goes; the first of its kind stays.

1. Suffixes. Every window elects an anchor: its rightmost gram (of ``GRAM`` words) of least hash. Equal windows
   elect the same gram at the same place, so it is enough to compare the suffixes that start at anchors, about
   one for eight words, each with the words to its left that its windows reach. The run of windows that share an
   anchor is a segment; segments whose anchor's gram starts no other one are unique and end here.
2. Leaves. Equal segments (128 bits of hash) are one leaf with a number and a first place, counted before the
   shuffle: all windows of its other places are copies. Copies of whole documents end here, however many.
3. Groups. A gram with at most ``MOST`` leaves is a group of its own. The leaves of more frequent grams are taken
   apart into their windows, as suffixes from the window's first word; these are grouped by prefixes of 5, 10 or
   15 words, the shortest that begin at most ``MOST`` of them. What a whole window's prefix doesn't split is one
   node without a branch: its first place is an aggregate.
4. Trees. A task builds each group's suffix tree from the top down: members that share a path split by their next
   word. An internal node of depth d has the right extension of its members; a second tree over what stands to
   their left parts them again, and each of its nodes whose depth and d together reach the window, and which
   holds more than one branch, is a maximal repeat with all its members. All but the earliest lose it.

Defined cases: null is a text without words; shorter texts than a window keep all; documents come by doc_id,
nulls last, those of one id by a hash of their text; rows that repeat id and text are one document and share its
result; a very long text is read by word offsets, its words in chunks; an empty table gives an empty result;
further columns are carried by ``remove_passages`` alone.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolake.llm.common import Scratch, claim

WINDOW = 20
#: Words of the grams from which windows elect their anchors.
GRAM = 6
#: Suffixes that one task's tree holds.
MOST = 4096
#: Prefix lengths, in words, that part the windows of more frequent grams.
PREFIXES = (5, 10, 15)
#: Words that are read at once, and texts.
CHUNK, TEXTS = 1 << 19, 256
#: Words whose hashes are remembered, each of at most 64 bytes.
WORDS = 1 << 19
_LOW = np.uint64((1 << 20) - 1)
_BASE = 0x9E3779B97F4A7C15


def word_bounds(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words [^\\x20\\x09-\\x0D]+ start and end in a text's bytes."""
    raw = np.frombuffer(data, "uint8")
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = (raw != 32) & ((raw < 9) | (raw > 13))
    turns = np.flatnonzero(inside[1:] != inside[:-1])
    return turns[::2], turns[1::2]


class _Hashes(dict):
    """64-bit hashes of words."""

    def __missing__(self, word: bytes) -> int:
        found = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(word) <= 64:
            if len(self) >= WORDS:
                self.clear()
            self[word] = found
        return found


_memo = _Hashes()


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    n = 2 * CHUNK
    up, down = np.full(n, _BASE, "uint64"), np.full(n, pow(_BASE, -1, 1 << 64), "uint64")
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _runs(sums: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed hashes of the runs of words [first, end)."""
    x = (sums[end] - sums[first]) * _powers()[1][first]
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def segments(data: bytes, window: int = WINDOW) -> Iterator[tuple[np.ndarray, ...]]:
    """(first window, last window, anchor, hash of the anchor's gram, hash of all words) of the runs of windows
    that share an anchor, a chunk of the text at a time."""
    starts, ends = word_bounds(data)
    wide = window - GRAM + 1
    for at in range(0, len(starts) - window + 1, CHUNK):
        to = min(len(starts), at + CHUNK + window - 1)
        words = data[starts[at] : ends[to - 1]].split()
        hashes = np.fromiter(map(_memo.__getitem__, words), "uint64", len(words))
        sums = np.zeros(len(words) + 1, "uint64")
        np.cumsum(hashes * _powers()[0][: len(words)], out=sums[1:])
        place = np.arange(len(words) - GRAM + 1)
        grams = _runs(sums, place, place + GRAM)
        least, span = (grams & ~_LOW) | (_LOW - place.astype("uint64")), 1
        while 2 * span <= wide:
            least, span = np.minimum(least[:-span], least[span:]), 2 * span
        n = len(words) - window + 1
        anchors = (_LOW - (np.minimum(least[:n], least[wide - span : wide - span + n]) & _LOW)).astype("int64")
        first = np.flatnonzero(np.r_[True, anchors[1:] != anchors[:-1]])
        last = np.r_[first[1:] - 1, n - 1]
        own = anchors[first]
        yield first + at, last + at, own + at, grams[own].astype("int64"), _runs(sums, first, last + window).astype("int64")


def internal_nodes(suffixes: Sequence[Sequence[bytes]], members: list[int]) -> Iterator[tuple[int, list[list[int]]]]:
    """(depth, members of each branch) of the internal nodes of the suffixes' tree, built from the top down; a
    suffix that ends is a branch of its own."""
    pending = [(0, members)] if len(members) > 1 else []
    while pending:
        depth, members = pending.pop()
        while True:
            branches: dict[object, list[int]] = defaultdict(list)
            for i in members:
                own = suffixes[i]
                branches[own[depth] if depth < len(own) else i].append(i)
            if len(branches) > 1:
                break
            depth += 1
        yield depth, list(branches.values())
        pending += [(depth + 1, b) for b in branches.values() if len(b) > 1]


def maximal_repeats(lefts: Sequence[Sequence[bytes]], rights: Sequence[Sequence[bytes]], window: int = WINDOW) -> Iterator[tuple[int, int, list[int]]]:
    """(words to the left, words to the right, members) of the maximal repeats of ``window`` words or more around
    the anchors at which ``rights`` start; ``lefts`` read backwards from there."""
    reach = max(map(len, lefts), default=0)
    for right, branches in internal_nodes(rights, list(range(len(rights)))):
        if right + reach < window:
            continue
        branch = {i: n for n, members in enumerate(branches) for i in members}
        for left, sides in internal_nodes(lefts, list(branch)):
            members = [i for side in sides for i in side]
            if left + right >= window and any(branch[i] != branch[members[0]] for i in members):
                yield left, right, members


def covered(spans: Sequence[tuple[int, int]], window: int = WINDOW) -> list[tuple[int, int]]:
    """Maximal runs of words [from, to) under the windows that start in ``spans`` (first, last start)."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], last + window))
        else:
            out.append((first, last + window))
    return out


def _keyed(docs: DataFrame) -> DataFrame:
    """The rows with none, id (an id for null ones, too), k (hash of id and text) and data: what names a document."""
    kind, data = docs.schema["doc_id"].dataType, F.coalesce(docs["text"], F.lit("")).cast("binary")
    carried = [docs[c].alias(f"c{i}") for i, c in enumerate(c for c in docs.columns if c != "text")]
    key = F.xxhash64(docs["doc_id"], data).alias("k")
    return docs.select(*carried, docs["doc_id"].isNull().alias("none"), F.coalesce(docs["doc_id"], F.lit(0).cast(kind)).alias("id"), key, docs["text"].isNull().alias("empty"), data.alias("data"))


def _segments(rows: DataFrame, window: int) -> DataFrame:
    """none, id, k, firsts (its places in the document), span, anchor (both from there), h, g of each segment."""
    kind = rows.schema["id"].dataType.simpleString()
    names = ["none", "id", "k", "firsts", "span", "anchor", "h", "g"]

    def table(part: pa.RecordBatch, found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        text, first, last, anchor, h, g = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((first, g, h, anchor - first, last - first, text))
        text, first, span, anchor, h, g = (x[order] for x in (text, first, last - first, anchor - first, h, g))
        same = np.logical_and.reduce([x[1:] == x[:-1] for x in (text, span, anchor, h, g)])
        start = np.flatnonzero(np.r_[True, ~same])
        firsts = pa.ListArray.from_arrays(pa.array(np.r_[start, len(first)], pa.int32()), pa.array(first, pa.int32()))
        documents = part.take(pa.array(text[start]))
        values = [pa.array(x[start], k) for x, k in ((span, pa.int32()), (anchor, pa.int32()), (h, pa.int64()), (g, pa.int64()))]
        return pa.RecordBatch.from_arrays([*(documents[c] for c in ("none", "id", "k")), firsts, *values], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("passages", _memo.clear)
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part, found = batch.slice(at, TEXTS), []
                for n, data in enumerate(part["data"]):
                    found += [(np.full(len(s[0]), n), *s) for s in segments(data.as_py(), window)]
                if found:
                    yield table(part.select(["none", "id", "k"]), found)

    return rows.select("none", "id", "k", "data").mapInArrow(run, f"none boolean, id {kind}, k long, firsts array<int>, span int, anchor int, h long, g long")


def _cut(kind: str, window: int, rows: DataFrame) -> DataFrame:
    """The suffixes of the leaves in ``borders``: of an anchor (deep is false; ``key`` its gram), or of each window
    (deep is true; p0, p1, ... hashes of its prefixes, the whole window's at last)."""
    prefixes = [*PREFIXES, window]
    names = ["deep", "key", *(f"p{i}" for i in range(len(prefixes))), "none", "id", "k", "at", "left", "piece"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        claim("passages", _memo.clear)
        for batch in batches:
            done, out = set(), []
            for none, name, k, data, borders in zip(*(batch[c] for c in ("none", "id", "k", "data", "borders")), strict=True):
                if (name, k) in done:
                    continue
                done.add((name, k))
                starts, ends = word_bounds(data)
                for b in borders:
                    first, last = b["first"], b["first"] + b["span"]
                    if not b["deep"]:
                        out.append((False, b["h"], *[0] * len(prefixes), none, name, k, first + b["anchor"], b["anchor"], data[starts[first] : ends[last + window - 1]]))
                        continue
                    for at in range(first, last + 1):
                        cuts = [hashlib.blake2b(b" ".join(data[starts[at] : ends[at + n - 1]].split()), digest_size=8).digest() for n in prefixes]
                        out.append((True, 0, *np.frombuffer(b"".join(cuts), "int64").tolist(), none, name, k, at, 0, data[starts[at] : ends[at + window - 1]]))
                if len(out) > 20_000:
                    yield pd.DataFrame(out, columns=names)
                    out = []
            yield pd.DataFrame(out, columns=names)

    return rows.mapInPandas(run, f"deep boolean, key long, {', '.join(f'p{i} long' for i in range(len(prefixes)))}, none boolean, id {kind}, k long, at int, left int, piece binary")


def _trees(groups: DataFrame, kind: str, window: int) -> DataFrame:
    """id, k, first, last: windows that are copies, by each group's tree; rows come sorted by group."""

    def grouped(batches: Iterator[pd.DataFrame]) -> Iterator[list[tuple]]:
        group: dict[tuple, tuple] = {}
        last = None
        for batch in batches:
            for key, *row in zip(*(batch[c] for c in ("key", "none", "id", "k", "at", "left", "piece")), strict=True):
                if key != last and group:
                    yield list(group.values())
                    group = {}
                last = key
                group[(*row[:4], row[4], len(row[5]))] = tuple(row)  # a document that two rows hold is cut twice
        if group:
            yield list(group.values())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        claim("passages", _memo.clear)
        out: list[tuple] = []
        for members in grouped(batches):
            pieces = [m[5].split() for m in members]
            lefts = [p[: m[4]][::-1] for p, m in zip(pieces, members, strict=True)]
            rights = [p[m[4] :] for p, m in zip(pieces, members, strict=True)]
            spans: dict[int, set[tuple[int, int]]] = defaultdict(set)
            for left, right, own in maximal_repeats(lefts, rights, window):
                earliest = min(own, key=lambda i: members[i][:4])
                for i in own:
                    if i != earliest:
                        spans[i].add((members[i][3] - left, members[i][3] + right - window))
            out += [(members[i][1], members[i][2], a, b - window) for i, found in spans.items() for a, b in covered(list(found), window)]
            if len(out) > 20_000:
                yield pd.DataFrame(out, columns=["id", "k", "first", "last"])
                out = []
        yield pd.DataFrame(out, columns=["id", "k", "first", "last"])

    return groups.repartition("key").sortWithinPartitions("key").mapInPandas(run, f"id {kind}, k long, first int, last int")


def _partitioned(deep: DataFrame, scratch: Scratch) -> tuple[list[DataFrame], DataFrame]:
    """Suffixes of windows by the shortest prefix that begins at most ``MOST`` of them, as groups with a key; and
    those which no prefix parts."""
    settled: list[DataFrame] = []
    for n in range(len(PREFIXES)):
        if not deep.take(1):
            break
        large = scratch.store(deep.groupBy(f"p{n}").agg(F.count("*").alias("n")).where(F.col("n") > MOST).select(f"p{n}"), "large-prefixes")
        few = deep.join(large, f"p{n}", "left_anti").withColumn("key", F.xxhash64(F.lit(n), f"p{n}"))
        settled.append(few.select("key", "none", "id", "k", "at", "left", "piece"))
        deep = scratch.store(deep.join(large, f"p{n}", "left_semi"), "deeper-suffixes")
    return settled, deep


def copied_windows(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """id, k, spans (array of first, last): windows that cover what copies cover in each document; stored.

    Counts are stored before they are joined back: both sides of such a join come from exchanges of its own, so
    that Spark can split the partition of a very common gram."""
    kind, last_prefix = rows.schema["id"].dataType.simpleString(), f"p{len(PREFIXES)}"
    scratch, early = Scratch(rows.sparkSession), Scratch(rows.sparkSession)
    found = early.store(_segments(rows, window), "segments")
    twice = early.store(found.groupBy("h").agg(F.sum(F.size("firsts")).alias("n")).where("n > 1").select("h"), "repeated-grams")
    shared = scratch.store(found.join(twice, "h"), "shared-grams")
    early.clear()
    place = F.struct("none", "id", "k", F.col("firsts")[0].alias("first"), "span", "anchor")
    leaves = early.store(shared.groupBy("h", "g").agg(F.sum(F.size("firsts")).alias("n"), F.min(place).alias("at")), "distinct-leaves")
    variety = early.store(leaves.groupBy("h").agg(F.count("*").alias("n_h")), "leaves-by-gram")
    leaves = scratch.store(leaves.join(variety, "h"), "leaves")
    early.clear()
    again = shared.join(leaves.where("n > 1").select("h", "g", F.struct("at.id", "at.k", "at.first").alias("at")), ["h", "g"])
    again = again.select("id", "k", F.explode("firsts").alias("first"), "span", "at").where(F.struct("id", "k", "first") != F.col("at"))
    again = again.select("id", "k", "first", (F.col("first") + F.col("span")).alias("last"))
    border = F.struct("at.first", "at.span", "at.anchor", "h", (F.col("n_h") > MOST).alias("deep"))
    borders = leaves.where("n_h > 1").groupBy(F.col("at.id").alias("id"), F.col("at.k").alias("k")).agg(F.collect_list(border).alias("borders"))
    borders = scratch.store(borders, "borders")
    cut = scratch.store(_cut(kind, window, rows.select("none", "id", "k", "data").join(borders, ["id", "k"])), "suffixes")
    settled, whole = _partitioned(cut.where("deep").dropDuplicates(["id", "k", "at"]), scratch)
    groups = cut.where("not deep").select("key", "none", "id", "k", "at", "left", "piece")
    for more in settled:
        groups = groups.unionByName(more)
    spans = again.unionByName(_trees(groups, kind, window))
    if settled:
        own = F.struct("none", "id", "k", "at")
        least = scratch.store(whole.groupBy(last_prefix).agg(F.min(own).alias("least")), "first-windows")
        later = whole.join(least, last_prefix).where(own != F.col("least"))
        spans = spans.unionByName(later.select("id", "k", F.col("at").alias("first"), F.col("at").alias("last")))
    return scratch.finish(spans.groupBy("id", "k").agg(F.collect_set(F.struct("first", "last")).alias("spans")), "copied-windows")


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A few rows at a time: what is made of them in Python is many times as large as they are."""
    for batch in batches:
        for at in range(0, batch.num_rows, TEXTS):
            yield batch.slice(at, TEXTS)


def _kept(data: bytes, spans, window: int) -> tuple[int, list[tuple[int, int]], Iterator[bytes]]:
    """Number of words, the removed runs of words, and what is kept, in pieces joined by one space."""
    starts, ends = word_bounds(data)
    runs = covered([(s["first"], s["last"]) for s in spans], window) if spans is not None else []
    bounds = [0, *(x for run in runs for x in run), len(starts)]

    def pieces() -> Iterator[bytes]:
        lead = b""
        for low, high in zip(bounds[::2], bounds[1::2], strict=True):
            for at in range(low, high, CHUNK):
                yield lead + b" ".join(data[starts[at] : ends[min(high, at + CHUNK) - 1]].split())
                lead = b" "

    return len(starts), runs, pieces()


def removal_digests(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""
    rows = _keyed(docs.select("doc_id", "text"))
    spans = copied_windows(rows, window)

    kinds = {"n_words": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            out = []
            for data, found in zip(part["data"].to_pylist(), part["spans"].to_pylist(), strict=True):
                n, runs, pieces = _kept(data, found, window)
                digest = hashlib.sha256()
                for piece in pieces:
                    digest.update(piece)
                out.append((n, sum(b - a for a, b in runs), digest.hexdigest()))
            yield pa.RecordBatch.from_arrays([part["c0"], *[pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds.values(), strict=True)]], ["doc_id", *kinds])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.select("c0", "id", "k", "data").join(spans, ["id", "k"], "left").mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string")


def remove_passages(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs``, every column as it was but text, which holds the kept words joined by one space (as it was where
    nothing goes), and with removed: the runs of words (from, to) taken from each text."""
    rows = _keyed(docs)
    carried = [c for c in docs.columns if c != "text"]

    names = [*(f"c{i}" for i in range(len(carried))), "text", "removed"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            given = part["data"].to_pylist()
            kept = [_kept(data, spans, window) for data, spans in zip(given, part["spans"].to_pylist(), strict=True)]
            texts = [None if empty else (b"".join(p) if runs else data).decode() for empty, data, (_, runs, p) in zip(part["empty"].to_pylist(), given, kept, strict=True)]
            removed = pa.array([[{"from": a, "to": b} for a, b in runs] for _, runs, _ in kept], pa.list_(pa.struct({"from": pa.int32(), "to": pa.int32()})))
            yield pa.RecordBatch.from_arrays([*(part[c] for c in names[:-2]), pa.array(texts, pa.string()), removed], names)

    types = [f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(carried)]
    joined = rows.join(copied_windows(rows, window), ["id", "k"], "left")
    out = joined.mapInArrow(run, ", ".join([*types, "text string", "removed array<struct<from: int, to: int>>"]))

    def named(c: str) -> Column:
        return out["text"] if c == "text" else out[f"c{carried.index(c)}"].alias(c)

    return out.select(*[named(c) for c in docs.columns], "removed")


ORACLE = r"""
WITH w AS (
  SELECT doc_id, generate_subscripts(l, 1) AS p, unnest(l) AS word FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS l FROM documents)
), s AS (
  SELECT doc_id, p, word, count(*) OVER o AS n, string_agg(word, ' ') OVER o AS window_text FROM w
  WINDOW o AS (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)
), f AS (
  SELECT doc_id, p, word, n = 20 AND row_number() OVER (PARTITION BY md5(window_text) ORDER BY doc_id, p) > 1 AS copied FROM s
), c AS (
  SELECT doc_id, p, word, bool_or(copied) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM f
), d AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (NOT gone) AS kept FROM c GROUP BY doc_id
)
SELECT o.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents o LEFT JOIN d USING (doc_id)
"""
