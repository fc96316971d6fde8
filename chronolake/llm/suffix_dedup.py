"""Removal of long repeated strings, by sparse enhanced suffix arrays and their common-prefix interval trees.

A string of ``length`` bytes is repeated if it also starts anywhere else, in this document or another.
Every byte that a repeated string covers goes.

1. Anchors. Each string of ``length`` bytes elects an anchor: its rightmost gram (of ``gram_of`` bytes) of
   least hash. The choice depends on the string's bytes alone, so copies elect the same anchor at the same
   place. Consecutive strings mostly share theirs; such a run is a segment: one row for about 170 bytes of
   text at a length of 400.
2. Equal segments. Segments are counted by (anchor hash, segment digest), aggregated before the shuffle.
   All strings of a segment that occurs twice are repeated: exact copies, however many, end here without
   their text being moved. Segments whose anchor occurs once are unique and end here too.
3. Border segments, which differ but share an anchor: one fragment of text for each distinct segment
   goes to its anchor. There the suffixes that start at the anchor are sorted, neighbours' common prefixes
   make an interval tree, and a stack scan closes its nodes one after the other. A node's members have a
   right extension in common; they lie ordered by what stands to the left of the anchor, smaller lists
   inserted into larger. A scan over the common left extensions of neighbours gives the node's maximal
   repeats: sets of members whose left extension is alike up to a place where it differs, and that aren't
   all from one child, so that it differs on the right as well. Each comes with all its members.
4. An anchor with more than ``HOT`` distinct segments isn't gathered in one task: the strings of its
   segments are hashed (126 bits) and counted by an aggregate that combines before its shuffle.

``repeat_groups`` lists the maximal repeats with all their occurrences. They are maximal in the surroundings
of their anchor, which end with the segment: a longer one appears at each of its anchors, cut there. Those
of hot anchors are its repeated strings of ``length`` bytes.

Defined cases: null counts as empty; shorter texts than ``length`` have no repeats; repeated rows are
copies of each other and lose every byte that a repeated string covers; ties of gram hashes go to the
right; an empty table gives an empty result; further columns are carried by ``remove_repeats`` alone.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolake.llm.common import Scratch, claim, content_key, materialise

LENGTH = 400
#: Bytes of a passage that documents share: passages of over 50 words of prose have more.
PASSAGE = 256
#: Greatest length that is asked for.
LONGEST = 4096
#: Distinct segments of one anchor that one task gathers: at most 3 MB of text.
HOT = 4096
#: Parts into which the occurrences of a string of a hot anchor are dealt when its count comes back.
SALTS = 16
#: Strings that are hashed at once: bounds memory for very long texts.
CHUNK = 1 << 19
#: Texts that are read at once.
TEXTS = 256
_LOW = np.uint64((1 << 20) - 1)
_BASE = 0x9E3779B97F4A7C15
_PRIMES = ((2147483647, 1000003), (2147483629, 69069))


def gram_of(length: int) -> int:
    """Bytes of the grams that strings of ``length`` bytes choose their anchors from."""
    return 4 * length // 25


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    n = CHUNK + LONGEST
    up, down = np.full(n, _BASE, "uint64"), np.full(n, pow(_BASE, -1, 1 << 64), "uint64")
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


@lru_cache(maxsize=4)
def _powers_mod(prime: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    n, inverse = 2 * LONGEST + 1, pow(base, -1, prime)
    return np.array([pow(base, i, prime) for i in range(n)], "uint64"), np.array([pow(inverse, i, prime) for i in range(n)], "uint64")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def _wrapped(data: np.ndarray, width: int) -> np.ndarray:
    """Polynomial hashes, modulo 2**64 and mixed, of all strings of ``width`` bytes."""
    up, down = _powers()
    sums = np.zeros(len(data) + 1, "uint64")
    np.cumsum(data.astype("uint64") * up[: len(data)], out=sums[1:])
    n = len(data) - width + 1
    return _mixed((sums[width:] - sums[:n]) * down[:n])


def segments(data: bytes, length: int = LENGTH) -> Iterator[tuple[int, int, int, int]]:
    """(first start, last start, anchor, anchor's hash) of the runs of strings that share an anchor."""
    whole = np.frombuffer(data, "uint8")
    wide = length - gram_of(length) + 1
    for at in range(0, len(whole) - length + 1, CHUNK):
        part = whole[at : at + CHUNK + length - 1]
        hashes = _wrapped(part, gram_of(length))
        least = (hashes & ~_LOW) | (_LOW - np.arange(len(hashes), dtype="uint64"))
        span = 1
        while 2 * span <= wide:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        n = len(part) - length + 1
        anchors = (_LOW - (np.minimum(least[:n], least[wide - span : wide - span + n]) & _LOW)).astype("int64")
        first = np.flatnonzero(np.r_[True, anchors[1:] != anchors[:-1]])
        last = np.r_[first[1:] - 1, n - 1]
        own = anchors[first]
        yield from zip((first + at).tolist(), (last + at).tolist(), (own + at).tolist(), hashes[own].astype("int64").tolist(), strict=True)


def string_hashes(data: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes (64 and 62 bits) of every string of ``length`` bytes in a fragment of at most twice that."""
    part = np.frombuffer(data, "uint8")
    n, second = len(part) - length + 1, None
    for prime, base in _PRIMES:
        up, down = _powers_mod(prime, base)
        sums = np.zeros(len(part) + 1, "uint64")
        np.cumsum((part.astype("uint64") + np.uint64(1)) * up[: len(part)], out=sums[1:])
        sums %= np.uint64(prime)
        x = (sums[length:] + np.uint64(prime) - sums[:n]) % np.uint64(prime) * down[:n] % np.uint64(prime)
        second = x if second is None else (second << np.uint64(31)) | x
    return _wrapped(part, length).astype("int64"), second.astype("int64")


def common_prefix(a: bytes, b: bytes) -> int:
    high = min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    low = 0
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


class Node:
    """An open interval of suffixes: its depth (the right extension that all share), and its members in order
    of left context, with how much of that each shares with the one before it and the child it came from."""

    def __init__(self, depth: int, members: list, near: list[int], child: int = 0):
        self.depth, self.members, self.near = depth, members, near
        self.child, self.children = [child] * len(members), child + 1

    def take(self, other: Node) -> None:
        """Another child's members; the smaller list is inserted into the larger."""
        more = [other.members, other.near, [self.children] * len(other.members)]
        if len(self.members) < len(other.members):
            (self.members, self.near, self.child), more = more, [self.members, self.near, self.child]
        self.children += 1
        for item, own in zip(more[0], more[2], strict=True):
            at = bisect_left(self.members, item)
            self.members.insert(at, item)
            self.child.insert(at, own)
            self.near.insert(at, common_prefix(self.members[at - 1][0], item[0]) if at else 0)
            if at + 1 < len(self.members):
                self.near[at + 1] = common_prefix(item[0], self.members[at + 1][0])

    def repeats(self, least: int) -> Iterator[tuple[int, list[int]]]:
        """(left extension, members), the longest first where they lie in each other, of the sets that share a
        left extension of ``least`` or more and come from more than one child."""
        turns, n = [0], len(self.members)
        for a, b in zip(self.child, self.child[1:], strict=False):
            turns.append(turns[-1] + (a != b))
        opened: list[tuple[int, int]] = []
        for k in range(1, n + 1):
            left, low = self.near[k] if k < n else -1, k - 1
            while opened and opened[-1][0] > left:
                known, low = opened.pop()
                if turns[k - 1] > turns[low]:
                    yield known, [i for _, i in self.members[low:k]]
            if left >= max(least, 0) and (not opened or opened[-1][0] < left):
                opened.append((left, low))


def maximal_repeats(fragments: list[tuple[bytes, int]], length: int = LENGTH) -> Iterator[tuple[int, int, list[int]]]:
    """(left, right, members) of the maximal repeats of ``length`` or more that lie around the places of the
    anchors in the ``fragments``: each with all the fragments that hold it. Deeper nodes come first."""
    reach = max((o for _, o in fragments), default=0)
    order = sorted(range(len(fragments)), key=lambda i: fragments[i][0][fragments[i][1] :])
    rights = [fragments[i][0][fragments[i][1] :] for i in order]
    stack: list[Node] = []
    for n, i in enumerate(order):
        done = Node(len(rights[n]), [(fragments[i][0][: fragments[i][1]][::-1], i)], [0])
        depth = common_prefix(rights[n], rights[n + 1]) if n + 1 < len(order) else -1
        while stack and stack[-1].depth > depth:
            top = stack.pop()
            top.take(done)
            done = top
            if done.depth + reach >= length:
                yield from ((left, done.depth, members) for left, members in done.repeats(length - done.depth))
        if depth < 0 or depth + reach < length:  # nothing above is long enough
            continue
        if stack and stack[-1].depth == depth:
            stack[-1].take(done)
        else:
            stack.append(Node(depth, done.members, done.near))


def extensions(fragments: list[tuple[bytes, int]], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """For each (fragment, place of the anchor): the (left, right) extensions, longest right first, that it
    shares with another fragment, as far as together they reach ``length`` and each goes further left."""
    found: list[list[tuple[int, int]]] = [[] for _ in fragments]
    for left, right, members in maximal_repeats(fragments, length):
        for i in members:
            if not found[i] or found[i][-1][0] < left:
                found[i].append((left, right))
    return found


def covered(spans: list[tuple[int, int]], length: int = LENGTH) -> list[tuple[int, int]]:
    """Maximal runs of bytes [from, to) under the strings that start in ``spans`` (first, last start)."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], last + length))
        else:
            out.append((first, last + length))
    return out


def _keyed(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """Every row: its columns but text as c0, c1, ...; text as bytes; the key of the text."""
    carried = [c for c in docs.columns if c != "text"]
    data = F.coalesce(docs["text"], F.lit("")).cast("binary")
    rows = docs.select(*[docs[c].alias(f"c{i}") for i, c in enumerate(carried)], docs["text"].isNull().alias("none"), data.alias("data"))
    return rows.select("*", *content_key(F.col("data"))), carried


def _anchored(rows: DataFrame, length: int) -> DataFrame:
    """A row for each distinct segment of each text: its starts, how far its last string and its anchor lie
    from them, the anchor's hash and the segment's digest. A run of one short period is one row."""
    kinds = {"k1": pa.int64(), "k2": pa.int64(), "firsts": pa.list_(pa.int32()), "span": pa.int32(), "anchor": pa.int32(), "h": pa.int64(), "g": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("suffix")
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part, out = batch.slice(at, TEXTS), []
                for k1, k2, data in zip(*(part[c].to_pylist() for c in ("k1", "k2", "data")), strict=True):
                    found: dict[tuple, list[int]] = {}
                    for first, last, anchor, h in segments(data, length):
                        g = hashlib.blake2b(data[first : last + length], digest_size=8).digest()
                        found.setdefault((last - first, anchor - first, h, int.from_bytes(g, "little", signed=True)), []).append(first)
                    out += [(k1, k2, firsts, *key) for key, firsts in found.items()]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), kinds.values(), strict=True)], list(kinds))

    return rows.select("k1", "k2", "data").mapInArrow(run, "k1 long, k2 long, firsts array<int>, span int, anchor int, h long, g long")


def _shared(rows: DataFrame, length: int, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tables of the segments whose anchor occurs twice: all of them; the distinct ones, with their number n,
    that of the distinct segments of their anchor n_g, and one place; and the fragments of the border ones.

    Counts are stored before they are joined back: both sides of such a join come from exchanges of its
    own, so that Spark can split the partition of a very common anchor."""
    early = Scratch(rows.sparkSession)
    anchored = early.store(_anchored(rows, length), "anchors")
    twice = early.store(anchored.groupBy("h").agg(F.sum(F.size("firsts")).alias("n_h")).where("n_h > 1").select("h"), "repeated-anchors")
    shared = scratch.store(anchored.join(twice, "h"), "shared-anchors")
    early.clear()
    place = F.struct("k1", "k2", F.col("firsts")[0].alias("first"), "span", "anchor")
    distinct = early.store(shared.groupBy("h", "g").agg(F.sum(F.size("firsts")).alias("n"), F.min(place).alias("at")), "distinct-segments")
    variety = early.store(distinct.groupBy("h").agg(F.count("*").alias("n_g")), "variety")
    kinds = scratch.store(distinct.join(variety, "h"), "segments")
    early.clear()
    border = F.struct("at.first", (F.col("at.first") + F.col("at.span")).alias("last"), "at.anchor", "h", "g", (F.col("n") > 1).alias("known"), (F.col("n_g") > HOT).alias("hot"))
    wanted = kinds.where("n_g > 1").groupBy(F.col("at.k1").alias("k1"), F.col("at.k2").alias("k2")).agg(F.collect_list(border).alias("borders"))
    schema = "hot boolean, h long, g long, x long, y long, shift int, k1 long, k2 long, first int, anchor int, known boolean, piece binary"
    cut = scratch.store(rows.join(wanted, ["k1", "k2"]).mapInPandas(_cut(length), schema), "fragments")
    return shared, kinds, cut


def _again(cut: DataFrame, equal: bool, *keys: str) -> DataFrame:
    """The strings of hot anchors that occur twice, as rows of ``cut`` with ``keys``; ``equal``: also those whose
    segment does."""
    salt = F.pmod(F.xxhash64("k1", "k2", "first"), F.lit(SALTS)).alias("salt")
    many = cut.where("hot").select("x", "y", "known", *keys, salt).distinct()
    twice = many.groupBy("x", "y").agg(F.count("*").alias("n"), F.max("known").alias("any")).where((F.col("n") > 1) | (F.lit(equal) & F.col("any")))
    twice = twice.select("x", "y", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<long>")).alias("salt"))
    return many.join(twice, ["x", "y", "salt"]).drop("salt")


def repeated_starts(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """k1, k2, spans (array of first, last): starts of the repeated strings of each text that has any; stored."""
    scratch = Scratch(rows.sparkSession)
    shared, kinds, cut = _shared(rows, length, scratch)
    equal = shared.join(kinds.where("n > 1").select("h", "g"), ["h", "g"]).select("k1", "k2", F.explode("firsts").alias("first"), "span")
    equal = equal.select("k1", "k2", "first", (F.col("first") + F.col("span")).alias("last"))
    few = cut.where("not hot").repartition("h").sortWithinPartitions("h").mapInPandas(_gathered(length), "k1 long, k2 long, first int, last int")
    many = _again(cut, False, "k1", "k2", "first").select("k1", "k2", "first", F.col("first").alias("last"))
    spans = equal.unionByName(few).unionByName(many)
    return scratch.finish(spans.groupBy("k1", "k2").agg(F.collect_set(F.struct("first", "last")).alias("spans")), "spans")


def repeat_groups(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, start, size, repeat (hex digest of the string): a row for each occurrence, in each row of
    ``docs``, of each maximal repeat of ``length`` bytes or more."""
    rows, _ = _keyed(docs.select("doc_id", "text"))
    scratch = Scratch(docs.sparkSession)
    shared, kinds, cut = _shared(rows, length, scratch)
    few = cut.where("not hot").repartition("h").sortWithinPartitions("h").mapInPandas(_grouped(length), "x long, y long, size int, h long, g long, shift int")
    alone = kinds.where("n > 1 and n_g = 1").select(F.col("h").alias("x"), F.col("g").alias("y"), (F.col("at.span") + length).alias("size"), "h", "g", F.lit(0).alias("shift"))
    many = _again(cut, True, "k1", "k2", "first", "h", "g", "shift").select("x", "y", F.lit(length).alias("size"), "h", "g", "shift")
    groups = scratch.store(few.unionByName(alone).unionByName(many).distinct(), "repeats")
    places = shared.join(groups, ["h", "g"]).select("k1", "k2", "x", "y", "size", "shift", F.explode("firsts").alias("first"))
    places = scratch.store(places.select("k1", "k2", "x", "y", "size", (F.col("first") + F.col("shift")).alias("start")).distinct(), "occurrences")
    named = rows.select(F.col("c0").alias("doc_id"), "k1", "k2").join(places, ["k1", "k2"])
    return scratch.finish(named.select("doc_id", "start", "size", F.concat(F.hex("x"), F.hex("y")).alias("repeat")), "repeat-groups")


def _cut(length: int):
    """Fragments of text for the border segments; of hot anchors the hashes of their strings instead."""
    names = ["hot", "h", "g", "x", "y", "shift", "k1", "k2", "first", "anchor", "known", "piece"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out, done = [], set()
            for k1, k2, data, borders in zip(batch["k1"], batch["k2"], batch["data"], batch["borders"], strict=True):
                if (k1, k2) in done:  # a copy of a text that this batch has cut
                    continue
                done.add((k1, k2))
                for b in borders:
                    h, g, first = b["h"], b["g"], b["first"]
                    piece = data[first : b["last"] + length]
                    if b["hot"]:
                        for i, (x, y) in enumerate(zip(*(z.tolist() for z in string_hashes(piece, length)), strict=True)):
                            out.append((True, h, g, x, y, i, k1, k2, first + i, 0, b["known"], None))
                    else:
                        out.append((False, h, g, 0, 0, 0, k1, k2, first, b["anchor"], b["known"], piece))
            yield pd.DataFrame(out, columns=names)

    return run


def _by_anchor(batches: Iterator[pd.DataFrame]) -> Iterator[list[tuple]]:
    """(h, g, k1, k2, first, anchor, known, piece) of the fragments of each anchor, copies of a text that several
    tasks have cut once; rows come sorted by anchor, and no anchor has many."""
    columns, group = ["h", "g", "k1", "k2", "first", "anchor", "known", "piece"], {}
    last = None
    for batch in batches:
        for row in zip(*(batch[c] for c in columns), strict=True):
            if row[0] != last and group:
                yield list(group.values())
                group = {}
            last = row[0]
            group[row[2:5]] = row
    if group:
        yield list(group.values())


def _gathered(length: int):
    """Starts of the repeated strings in each anchor's fragments, but for those that are known to be repeated."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        claim("suffix")
        out: list[tuple] = []
        for rows in _by_anchor(batches):
            for row, pairs in zip(rows, extensions([(r[7], r[5]) for r in rows], length), strict=True):
                if not row[6]:
                    at, merged = row[4] + row[5], []
                    for first, last in sorted((at - left, at + right - length) for left, right in pairs):
                        if merged and first <= merged[-1][1] + 1:
                            merged[-1] = (merged[-1][0], max(merged[-1][1], last))
                        else:
                            merged.append((first, last))
                    out += [(row[2], row[3], *m) for m in merged]
            if len(out) > 20_000:
                yield pd.DataFrame(out, columns=["k1", "k2", "first", "last"])
                out = []
        yield pd.DataFrame(out, columns=["k1", "k2", "first", "last"])

    return run


def _grouped(length: int):
    """Maximal repeats of each anchor's fragments: their digest (x, y) and size, and each segment (h, g) that holds
    one with how far it starts behind the segment. A segment that occurs twice is one by itself, too."""
    names = ["x", "y", "size", "h", "g", "shift"]

    def digest(string: bytes) -> list[int]:
        return np.frombuffer(hashlib.blake2b(string, digest_size=16).digest(), "int64").tolist()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        claim("suffix")
        out: list[tuple] = []
        for rows in _by_anchor(batches):
            out += [(*digest(r[7]), len(r[7]), r[0], r[1], 0) for r in rows if r[6]]
            for left, right, members in maximal_repeats([(r[7], r[5]) for r in rows], length):
                first = rows[members[0]]
                name = digest(first[7][first[5] - left : first[5] + right])
                out += [(*name, left + right, rows[i][0], rows[i][1], rows[i][5] - left) for i in members]
                if len(out) > 20_000:
                    yield pd.DataFrame(out, columns=names)
                    out = []
        yield pd.DataFrame(out, columns=names)

    return run


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A few rows at a time: what is made of them in Python is many times as large as they are."""
    for batch in batches:
        for at in range(0, batch.num_rows, TEXTS):
            yield batch.slice(at, TEXTS)


def _kept(data: bytes, spans, length: int) -> tuple[list[bytes], list[tuple[int, int]]]:
    runs = covered([(s["first"], s["last"]) for s in spans], length) if spans is not None else []
    ends = [0, *(x for run in runs for x in run), len(data)]
    return [data[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True)], runs


def _longer_starts(rows: DataFrame, shorter: DataFrame, passage: int, length: int) -> DataFrame:
    """k1, k2, spans of the repeated strings of ``length``, found within what strings of ``passage`` bytes, which
    are shorter, cover: where a string is repeated all its parts are, so it lies whole in one of these runs,
    and so does each of its copies."""
    scratch = Scratch(rows.sparkSession)
    names = ["t1", "t2", "at", "data"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("suffix")
        for part in _slices(batches):
            out = []
            for k1, k2, data, spans in zip(*(part[c].to_pylist() for c in ("k1", "k2", "data", "spans")), strict=True):
                out += [(k1, k2, a, data[a:b]) for a, b in _kept(data, spans, passage)[1] if b - a >= length]
            columns = zip(*out, strict=True) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names)

    runs = rows.select("k1", "k2", "data").join(shorter, ["k1", "k2"]).mapInArrow(run, "t1 long, t2 long, at int, data binary")
    runs = scratch.store(runs.select("*", *content_key(F.col("t1"), F.col("t2"), F.col("at"))), "runs")
    found = repeated_starts(runs.select("k1", "k2", "data"), length)
    placed = runs.select("t1", "t2", "at", "k1", "k2").distinct().join(found, ["k1", "k2"])
    placed = placed.select("t1", "t2", F.transform("spans", lambda s: F.struct((s["first"] + F.col("at")).alias("first"), (s["last"] + F.col("at")).alias("last"))).alias("spans"))
    whole = placed.groupBy(F.col("t1").alias("k1"), F.col("t2").alias("k2")).agg(F.flatten(F.collect_list("spans")).alias("spans"))
    return scratch.finish(whole, "longer-spans")


def removal_digests(docs: DataFrame, length: int = LENGTH, passage: int = PASSAGE) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row, and n_shared: the bytes under strings of
    ``passage`` bytes (fewer than ``length``) that also start anywhere else, which are reported and stay."""
    rows, _ = _keyed(docs.select("doc_id", "text"))
    shared = repeated_starts(rows, passage)
    spans = _longer_starts(rows, shared, passage, length)
    both = materialise(shared.withColumnRenamed("spans", "shared").join(spans, ["k1", "k2"], "left"), "all-spans")

    kinds = {"n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "n_shared": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            out = []
            for data, found, more in zip(*(part[c].to_pylist() for c in ("data", "spans", "shared")), strict=True):
                parts, runs = _kept(data, found, length)
                n_shared = sum(b - a for a, b in _kept(data, more, passage)[1])
                out.append((len(data), sum(b - a for a, b in runs), len(runs), hashlib.sha256(b"".join(parts)).hexdigest(), n_shared))
            yield pa.RecordBatch.from_arrays([part["c0"], *[pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds.values(), strict=True)]], ["doc_id", *kinds])

    kind = docs.schema["doc_id"].dataType.simpleString()
    joined = rows.join(both, ["k1", "k2"], "left")
    return joined.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_shared long")


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs``, every column as it was but text without its repeated strings (characters that a removal
    cuts through go with it), and with removed: the runs of bytes (from, to) taken from each text."""
    rows, carried = _keyed(docs)

    names = [*(f"c{i}" for i in range(len(carried))), "text", "removed"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            kept = [_kept(data, spans, length) for data, spans in zip(part["data"].to_pylist(), part["spans"].to_pylist(), strict=True)]
            texts = [None if none else b"".join(p).decode("utf-8", "ignore") for none, (p, _) in zip(part["none"].to_pylist(), kept, strict=True)]
            removed = pa.array([[{"from": a, "to": b} for a, b in runs] for _, runs in kept], pa.list_(pa.struct({"from": pa.int32(), "to": pa.int32()})))
            yield pa.RecordBatch.from_arrays([*(part[c] for c in names[:-2]), pa.array(texts, pa.string()), removed], names)

    types = [f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(carried)]
    out = rows.join(repeated_starts(rows, length), ["k1", "k2"], "left").mapInArrow(run, ", ".join([*types, "text string", "removed array<struct<from: int, to: int>>"]))

    def named(c: str) -> Column:
        return out["text"] if c == "text" else out[f"c{carried.index(c)}"].alias(c)

    return out.select(*[named(c) for c in docs.columns], "removed")
