"""Near-duplicate join: documents whose sets of word 5-grams have a Jaccard similarity of 0.8 or more.

1. Texts with the same set of n-grams form a class, keyed by a digest of the set; copies, however many,
   are one class with a count and never meet as pairs.
2. MinHash banding. ``bands_for`` chooses how many bands of ``ROWS`` minima reach the target recall at the
   threshold. A shuffle on band hashes (aggregated before it) leaves the buckets of two classes or more.
   The pairs that have a band in common are those that are verified, each once, whatever else is near.
3. Buckets link their members to their least one, and the connected components of these links are the
   scopes within which pairs are verified: pairs of a component without a common band are passed over. A
   component of more than ``WIDE`` classes, which chains of chance meetings can make, is verified bucket by
   bucket instead, each pair in its first common bucket; the pairs are the same.
4. Verification on the full n-gram sets. The classes of a scope are dealt into tiles of about ``TILE`` sets
   and ``TILE_GRAMS`` n-grams, and each two tiles meet in a group of rows; incidence matrices of the n-grams
   that the group shares give all intersections at once. What leaves a group is a link count and a root for
   each class, not a row for each pair.
5. Components of the verified links are the near-duplicate groups.

Defined cases: words are what white space separates, lower-cased; a text of one to four words has one
n-gram, all its words; a null, empty or blank text has the empty set, and these are copies of each other; rows that
repeat count each; a null id counts but never names a group unless no other is there (then null); an
empty table gives an empty result; other columns are not read (``keep_one`` carries them, whatever their names); a
very long text is one sorted set of n-gram hashes, 8 bytes for each of its distinct n-grams.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronolake.llm.common import Scratch, claim, content_key, materialise
from chronolake.llm.components import components

WORDS = 5
THRESHOLD = 0.8
#: Minima in a band, and the share of pairs at the threshold that shall meet.
ROWS, RECALL = 8, 0.999
#: Classes in a tile and n-grams in their sets, on average, and classes in a component that is verified as a whole.
TILE, TILE_GRAMS, WIDE = 256, 1 << 20, 4096
#: n-grams whose minima are taken at once, and columns of an incidence matrix.
STRIP = 4096
MEMO_WORDS = 200_000
#: Texts whose sets are held at once.
TEXTS = 256


def bands_for(threshold: float = THRESHOLD, rows: int = ROWS, recall: float = RECALL) -> int:
    """The fewest bands with which a pair at ``threshold`` meets with probability ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


class Shingler:
    """Sets of hashed word n-grams, with a bounded memo of word hashes."""

    def __init__(self, words: int = WORDS):
        self.n = words
        self.memo: dict[str, int] = {}
        rng = np.random.default_rng(20)
        self.odd = rng.integers(0, 1 << 63, words, "uint64") * np.uint64(2) + np.uint64(1)

    def _word(self, word: str) -> int:
        found = self.memo.get(word)
        if found is None:
            found = int.from_bytes(hashlib.blake2b(word.encode("utf-8"), digest_size=8).digest(), "little")
            if len(self.memo) >= MEMO_WORDS:
                self.memo.clear()
            self.memo[word] = found
        return found

    def __call__(self, text: str) -> np.ndarray:
        """Sorted distinct 64-bit hashes."""
        words = text.lower().split()
        hashes = np.fromiter(map(self._word, words), "uint64", len(words))
        if 0 < len(words) < self.n:
            hashes = np.r_[hashes, np.full(self.n - len(words), len(words), "uint64")]
        n = len(hashes) - self.n + 1
        if n < 1:
            return np.empty(0, "uint64")
        x = hashes[:n] * self.odd[0]
        for i in range(1, self.n):
            x = (x ^ (x >> np.uint64(31))) + hashes[i : i + n] * self.odd[i]
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return np.unique(x ^ (x >> np.uint64(32)))


def minima(shingles: np.ndarray, odd: np.ndarray, plus: np.ndarray) -> np.ndarray:
    """MinHash: the least value of each of the functions odd * x + plus (32 bits)."""
    out = np.full(len(odd), 0xFFFFFFFF, "uint32")
    x = (shingles >> np.uint64(16)).astype("uint32")
    for at in range(0, len(x), STRIP):
        np.minimum(out, (odd[:, None] * x[None, at : at + STRIP] + plus[:, None]).min(axis=1), out=out)
    return out


def band_hashes(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit hash of each band of each signature, different for each band."""
    parts = signatures.reshape(len(signatures), bands, rows).astype("uint64")
    x = np.arange(bands, dtype="uint64")[None, :] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)
    x = np.repeat(x, len(signatures), axis=0)
    for i in range(rows):
        x = (x ^ parts[:, :, i]) * np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(32)
    return x.astype("int64")


def signed(docs: DataFrame, bands: int, rows: int = ROWS) -> DataFrame:
    """doc_id, t1, t2 (key of the text), c (digest of the n-gram set), v (its first 64 bits), grams (its
    size), bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, rng = Shingler(), np.random.default_rng(21)
        odd = rng.integers(0, 1 << 31, bands * rows, "uint32") * np.uint32(2) + np.uint32(1)
        plus = rng.integers(0, 1 << 32, bands * rows, "uint32")
        claim("jaccard")
        none = np.empty(0, "int64")
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                sets = [shingle(t) for t in part["text"].to_pylist()]
                c = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                v = np.frombuffer(b"".join(c), "int64")[::2]
                hashes = band_hashes(np.stack([minima(s, odd, plus) for s in sets]), bands, rows)
                found = [h if len(s) else none for h, s in zip(hashes, sets, strict=True)]
                columns = [pa.array(c, pa.binary()), pa.array(v), pa.array([len(s) for s in sets], pa.int64()), pa.array(found, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["t1"], part["t2"], *columns], ["doc_id", "t1", "t2", "c", "v", "grams", "bands"])

    text = F.coalesce("text", F.lit(""))
    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", text.alias("text")).select("doc_id", "text", *[k.alias(f"t{i + 1}") for i, k in enumerate(content_key(F.col("text")))])
    return keyed.select("doc_id", "t1", "t2", "text").mapInArrow(run, f"doc_id {kind}, t1 long, t2 long, c binary, v long, grams long, bands array<long>")


def _first_common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which band is the first that two members have in common; -1: none."""
    out = np.full((len(a), len(b)), -1, "int32")
    for i in range(a.shape[1] - 1, -1, -1):
        out[a[:, i][:, None] == b[:, i][None, :]] = i
    return out


def intersections(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each set of ``a`` with each of ``b``."""
    every = np.concatenate([*a, *b])
    owner = np.repeat(np.arange(len(a) + len(b)), [len(s) for s in [*a, *b]])
    values, at, counts = np.unique(every, return_inverse=True, return_counts=True)
    column = np.cumsum(counts > 1) - 1
    kept = counts[at] > 1
    owner, at = owner[kept], column[at[kept]]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    out = np.zeros((len(a), len(b)), "float32")
    width = int(at[-1]) + 1 if len(at) else 0
    for low in range(0, width, STRIP):
        i, j = np.searchsorted(at, [low, low + STRIP])
        grid = np.zeros((len(a) + len(b), min(STRIP, width - low)), "float32")
        grid[owner[i:j], at[i:j] - low] = 1
        out += grid[: len(a)] @ grid[len(a) :].T
    return out


def _verified(rows: list[tuple], threshold: float) -> Iterator[tuple]:
    """(c, linked documents, root) of the members of a group of rows that have links in it."""
    _, i, j, scope, by_band = rows[0][:5]
    rows = list({r[6]: r for r in rows}.values())
    left = [r for r in rows if r[5] == i]
    right = left if i == j else [r for r in rows if r[5] == j]
    if not left or not right:
        return
    a, b = [np.frombuffer(r[9], "uint64") for r in left], [np.frombuffer(r[9], "uint64") for r in right]
    both = intersections(a, b)
    union = np.array([len(s) for s in a])[:, None] + np.array([len(s) for s in b])[None, :] - both
    linked = both >= threshold * union - 1e-6
    if i == j:
        np.fill_diagonal(linked, False)
    if linked.any():
        bands = [np.stack([np.asarray(r[8]) for r in side]) for side in (left, right)]
        first = _first_common(*bands)
        linked &= first == int(np.flatnonzero(bands[0][0] == scope)[0]) if by_band else first >= 0
    n_left, n_right = np.array([r[7] for r in left]), np.array([r[7] for r in right])
    counts = {r[6]: int(n) for r, n in zip(left, linked @ n_right, strict=True)}
    if i != j:
        counts |= {r[6]: int(n) for r, n in zip(right, linked.T @ n_left, strict=True)}
    root = {c: c for c in counts}

    def top(c: bytes) -> bytes:
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    for x, y in zip(*np.nonzero(linked), strict=True):
        p, q = sorted((top(left[x][6]), top(right[y][6])))
        root[q] = p
    yield from ((c, n, top(c)) for c, n in counts.items() if n)


def _tiles(threshold: float):
    columns = ["scope", "i", "j", "scope", "by_band", "tile", "c", "n", "bands", "shingles"]

    def found(rows: list[tuple]) -> pa.RecordBatch:
        c, links, root = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(c, pa.binary()), pa.array(links, pa.int64()), pa.array(root, pa.binary())], ["c", "links", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("jaccard")
        group: list[tuple] = []
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part, out = batch.slice(at, TEXTS), []
                for key, rows in groupby(zip(*(part[c].to_pylist() for c in columns), strict=True), key=lambda r: (r[3], r[4], r[1], r[2])):
                    if group and (group[0][3], group[0][4], group[0][1], group[0][2]) != key:
                        out += _verified(group, threshold)
                        group = []
                    group += rows
                if out:
                    yield found(out)
        yield found(list(_verified(group, threshold)) if group else [])

    return run


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[DataFrame, DataFrame]:
    """Two tables: (doc_id, t1, t2, c) of every row, with the key of its text and its class; and
    (c, n, links, class_id) of every class: its rows, the rows of other classes that it is linked to, and
    the least doc_id in its group."""
    bands, scratch = bands_for(threshold, ROWS, recall), Scratch(docs.sparkSession)
    signed_rows = scratch.store(signed(docs, bands), "signed")
    classes = signed_rows.groupBy("c").agg(
        F.count("*").alias("n"), F.min("doc_id").alias("first_id"), F.min(F.struct("t1", "t2")).alias("t"), F.min("v").alias("v"), F.max("grams").alias("grams")
    )
    classes = scratch.store(classes, "classes")

    banded = scratch.store(signed_rows.groupBy("c", "v").agg(F.first("bands").alias("bands")), "bands")  # a class's rows share them
    members = banded.select("v", F.explode("bands").alias("band"))
    buckets = members.groupBy("band").agg(F.min("v").alias("low"), F.max("v").alias("high")).where("low < high").select("band", "low")
    buckets = scratch.store(buckets, "buckets")
    met = scratch.store(members.join(buckets, "band").select("band", "v", "low").distinct(), "met")
    scopes = components(met.select(F.col("v").alias("a"), F.col("low").alias("b")), scratch, "scopes")
    grams = classes.groupBy("v").agg(F.max("grams").alias("grams"))
    scopes = scratch.store(scopes.join(grams, scopes["node"] == grams["v"]).drop("v"), "sized")
    sizes = [F.count("*").alias("size"), F.sum("grams").alias("all")]
    scopes = scratch.store(scopes.join(scopes.groupBy("root").agg(*sizes), "root"), "scoped")

    whole = scopes.where(F.col("size") <= WIDE).select("node", F.col("root").alias("scope"), F.lit(False).alias("by_band"), "size", "all")
    wide = met.join(scopes.where(F.col("size") > WIDE).select("node", "grams"), met["v"] == F.col("node")).select("node", F.col("band").alias("scope"), "grams")
    wide = wide.join(wide.groupBy("scope").agg(*sizes), "scope").select("node", "scope", F.lit(True).alias("by_band"), "size", "all")
    tiles = F.greatest(F.ceil(F.col("size") / TILE), F.ceil(F.col("all") / TILE_GRAMS)).cast("int")
    places = whole.unionByName(wide).withColumn("tiles", tiles)

    shingled = _shingles(docs, banded, classes, scopes)
    dealt = (
        shingled.join(places, shingled["v"] == places["node"])
        .withColumn("tile", F.pmod(F.xxhash64("c"), F.col("tiles")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .select("scope", "by_band", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "c", "n", "bands", "shingles")
    )
    key = ["scope", "by_band", "i", "j"]
    checked = dealt.repartition(*key).sortWithinPartitions(*key).mapInArrow(_tiles(threshold), "c binary, links long, root binary")
    checked = scratch.store(checked, "verified")
    links = checked.groupBy("c").agg(F.sum("links").alias("links"))
    groups = components(checked.select(F.col("c").alias("a"), F.col("root").alias("b")), scratch, "groups").select(F.col("node").alias("c"), "root")

    linked = classes.join(links, "c").join(groups, "c")
    least = linked.groupBy("root").agg(F.min("first_id").alias("class_id"))
    named = linked.join(least, "root").select("c", "links", "class_id")
    found = classes.join(named.withColumn("in", F.lit(True)), "c", "left").select(
        "c", "n", F.coalesce("links", F.lit(0)).alias("links"), F.when(F.col("in"), F.col("class_id")).otherwise(F.col("first_id")).alias("class_id")
    )
    found = materialise(found, "near-classes")
    return scratch.finish(signed_rows.select("doc_id", "t1", "t2", "c"), "near-rows"), found


def _shingles(docs: DataFrame, banded: DataFrame, classes: DataFrame, scopes: DataFrame) -> DataFrame:
    """c, v, n, bands, shingles (sorted, as bytes) of the classes that have a scope; one text of each is read."""
    wanted = classes.join(scopes.select(F.col("node").alias("v")), "v").select("t.t1", "t.t2", "c", "v", "n")
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select(text.alias("text")).select("text", *[k.alias(f"t{i + 1}") for i, k in enumerate(content_key(F.col("text")))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("jaccard")
        shingle, done = Shingler(), set()
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                first = {c: i for i, c in reversed(list(enumerate(part["c"].to_pylist()))) if c not in done}
                if first:
                    if len(done) < MEMO_WORDS:
                        done.update(first)
                    part = part.take(pa.array(sorted(first.values())))
                    sets = pa.array([shingle(t).tobytes() for t in part["text"].to_pylist()], pa.binary())
                    yield pa.RecordBatch.from_arrays([part["c"], part["v"], part["n"], sets], ["c", "v", "n", "shingles"])

    made = keyed.join(wanted, ["t1", "t2"]).select("c", "v", "n", "text").mapInArrow(run, "c binary, v long, n long, shingles binary")
    one = made.groupBy("c").agg(F.first("v").alias("v"), F.first("n").alias("n"), F.first("shingles").alias("shingles"))
    return one.join(banded, ["c", "v"])


def links_by_document(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, n_links: a row for every document, with the least id in its group and the number
    of other documents at the threshold or above, copies included."""
    rows, classes = near_duplicates(docs)
    counted = classes.select("c", "class_id", (F.col("links") + F.col("n") - 1).alias("n_links"))
    return rows.join(counted, "c").select("doc_id", "class_id", "n_links")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group: the one of least id (null last), then of least text key."""
    rows, classes = near_duplicates(docs)
    group = F.coalesce(F.col("class_id").cast("string"), F.hex("c"))
    order = Window.partitionBy("group").orderBy(F.asc_nulls_last("doc_id"), "t1", "t2")
    judged = rows.join(classes.select("c", "class_id"), "c").select("doc_id", "t1", "t2", group.alias("group"))
    best = judged.withColumn("place", F.row_number().over(order)).where("place = 1")
    best = best.select(F.col("doc_id").alias("_id"), F.col("t1").alias("_1"), F.col("t2").alias("_2"))
    text = F.coalesce(docs["text"], F.lit(""))
    keyed = docs.select(*[docs[c].alias(f"c{i}") for i, c in enumerate(docs.columns)], *[k.alias(f"t{i + 1}") for i, k in enumerate(content_key(text))])
    doc_id = f"c{docs.columns.index('doc_id')}"
    same = keyed[doc_id].eqNullSafe(best["_id"]) & (keyed["t1"] == best["_1"]) & (keyed["t2"] == best["_2"])
    kept = keyed.join(best, same, "left_semi").dropDuplicates([doc_id, "t1", "t2"])
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
