"""Hashed maximum-entropy language model with a class-factored softmax, and its scores of texts.

log P(text) is the sum over its words and its end of log P(class | context) + log P(word | class, context).

* Corpus statistics cover every training document: counts of all words, and counts of word endings by
  the endings before them. Endings (hashed) are clustered by these into ``CLASSES`` - 1 classes, so a word's
  class follows from its spelling and words that were never seen have one; the end has its own.
* Features of the class softmax, hashed into ``FEATURES`` rows each: the word before (n-gram), the word
  before that (skip), and the pair of their classes.
* Within a class the ``SLOTS`` most frequent words (both are least sizes, and grow with the number of
  frequent words up to a stated bound) and one item for all others form a second softmax, with features of
  the same kinds: the class before, the word before and the word before that, the words hashed into
  ``WITHIN`` rows. The words of the last item share its probability by (count + 0.5), unseen ones together
  counting once, so that all sums to one.
* Training is distributed: in each of ``ROUNDS`` rounds the tasks take the weights by broadcast, make
  minibatch gradient updates of the class weights over their own documents of that round's share (together:
  all), and hand over how far they moved; the moves are averaged by number of tokens. They hand over as well
  how often each word of a slot met each value of a feature. Weights within the classes are fitted to these
  counts by gradient ascent, each kind by itself; in the last round the tasks also sum gradient and
  curvature of how much each kind counts beside the others (``mix``, by class), on documents that the
  weights then used don't know. What a task hands over meets in ``PIECES`` groups.
* Scoring is one pass in sparse numpy batches. The sum below a softmax is taken of products of the weights'
  powers, so that no token asks for a power of its own. Words that occur ``2**b`` times or more, at most
  ``HEAD_WORDS`` of them, have their counts broadcast (by 64-bit hash); the others, which are rare by
  construction, meet theirs in a join.

Defined cases: null counts as empty, which is one token, the end; without any training document both
scores are 0 per token; the trained score depends, slightly, on how many tasks the input splits into, as their
moves are averaged; texts that repeat are scored alike and count as often as they come; a null id is
in fold 0; an empty table gives an empty result; other columns are not read; a very long text is scored whole,
``STEP_TOKENS`` of its tokens at once, after its words were turned into some 100 bytes each.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolake.llm.common import Scratch, content_key, fold, give_back, k_means, materialise

CLASSES, ENDINGS, AROUND = 64, 2048, 128
#: Least and most sizes of the context model; ``sizes_of`` picks them by the corpus. Weights go to each task.
SLOTS, FEATURES, MOST_SLOTS, MOST_FEATURES = 64, 2048, 128, 8192
#: Hashed rows of each word feature within the classes.
WITHIN = 128
#: Tasks of a round at most, or twice the session's cores where that is more: what each hands over is as large as
#: the weights, however small its share.
LEAST_TASKS = 32
#: Parts into which the weights are cut where the tasks' moves meet.
PIECES = 64
#: A word that is counted in these sizes occurs 2**OFTEN times or more.
OFTEN = 6
ROUNDS, STEP_TOKENS, RATE = 3, 4096, 0.1
#: Most words whose counts are broadcast: 12 bytes each.
HEAD_WORDS = 1 << 18
#: Words in a worker's counter before it starts anew.
MEMO_WORDS = 500_000
#: Tokens whose contexts within the classes wait until equal ones are told.
MET_TOKENS = 1 << 21
#: Texts that are turned into arrays at once, and their bytes (a longer text goes alone).
BATCH, BATCH_BYTES = 512, 1 << 21
#: Tokens whose rows of weights are gathered at once where no minibatch sets their number: few, for the caches.
SLICE_TOKENS = 512
#: Rows of a minibatch that are added one after the other.
CHAIN = 32
#: Logits up to this size have powers that 32 bits hold, with room for sums of them.
MOST_LOGIT = 80.0
END_CLASS, START_CLASS = CLASSES - 1, CLASSES
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def words_of(data: bytes) -> list[bytes]:
    """Runs of bytes other than blank and 9 to 13, A-Z lower-cased."""
    return data.translate(_LOWER).split()


def ending(word: bytes) -> int:
    return crc32(word[-3:]) % ENDINGS


#: Of each byte, as crc32 takes it into what it has.
_CRC = np.array([crc32(bytes([i ^ 0xFF])) ^ 0xFF000000 for i in range(256)], "uint32")


def endings(words: pa.LargeBinaryArray) -> np.ndarray:
    """``ending`` of each of these words."""
    if not len(words):
        return np.empty(0, "int64")
    ends, data = (np.frombuffer(b, k) for b, k in zip(words.buffers()[1:], ("int64", "uint8"), strict=True))
    ends = ends[words.offset : words.offset + len(words) + 1]
    sizes, found = np.diff(ends), np.full(len(words), 0xFFFFFFFF, "uint32")
    for back in (3, 2, 1):
        more = _CRC[(found ^ data[np.maximum(ends[1:] - back, 0)]) & 0xFF] ^ (found >> 8)
        found = np.where(sizes >= back, more, found)
    return (~found % ENDINGS).astype("int64")


def word_hashes(words: list[bytes] | np.ndarray) -> np.ndarray:
    return pd.util.hash_array(np.asarray(words, object), categorize=False).astype("int64")


def objects(words: pa.LargeBinaryArray) -> np.ndarray:
    return words.to_numpy(zero_copy_only=False)


def slices(texts: list[bytes]) -> Iterator[slice]:
    """Parts of ``texts`` of at most ``BATCH`` texts and, but for one text, ``BATCH_BYTES`` bytes."""
    start = size = 0
    for at, text in enumerate(texts):
        if at > start and (at - start == BATCH or size + len(text) > BATCH_BYTES):
            yield slice(start, at)
            start, size = at, 0
        size += len(text)
    if texts:
        yield slice(start, len(texts))


def split(texts: list[bytes]) -> tuple[pa.LargeBinaryArray, np.ndarray, np.ndarray]:
    """The distinct words of ``texts``, as by ``words_of``; of each word its place there; words of each text."""
    data = pa.array([t.translate(_LOWER) for t in texts], pa.large_binary())
    # Arrow splits strings only; it looks at single bytes here, whatever they encode
    lists = pc.ascii_split_whitespace(pa.LargeStringArray.from_buffers(len(data), *data.buffers()[1:]))
    words, ends = lists.values, lists.offsets.to_numpy()
    full = pc.binary_length(words).to_numpy() > 0  # blanks at either end leave empty strings
    if not full.all():
        words, ends = words.filter(pa.array(full)), np.r_[0, np.cumsum(full)][ends]
    found = words.dictionary_encode()
    return found.dictionary.cast(pa.large_binary()), found.indices.to_numpy(), np.diff(ends)


def _logits(w: np.ndarray, rows: np.ndarray) -> np.ndarray:
    x = np.take(w, rows[0], axis=0)
    more = np.empty_like(x)
    for which in rows[1:]:
        x += np.take(w, which, axis=0, out=more, mode="clip")
    x += w[-1]
    return x


def _less_top(x: np.ndarray) -> np.ndarray:
    """Takes each row's largest value from it, in place; by halves, as rows are short."""
    top = x
    while top.shape[1] > 4 and top.shape[1] % 2 == 0:
        half = top.shape[1] // 2
        top = np.maximum(top[:, :half], top[:, half:])
    x -= top.max(axis=1, keepdims=True)
    return x


class Softmax:
    """A softmax whose logits are sums of one row from each of three tables."""

    def __init__(self, logs: list[np.ndarray]):
        self.logs = logs
        most = [np.abs(x[np.isfinite(x)]).max(initial=0) for x in logs]
        kind = "float32" if sum(most) < MOST_LOGIT else "float64"
        powers = {id(x): np.exp(x, dtype=kind) for x in logs}
        self.powers = [powers[id(x)] for x in logs]

    def shares(self, rows: np.ndarray) -> np.ndarray:
        """Of all items, for each token; still to be divided by their sum."""
        x, more = self._product(rows)
        x *= more
        return x

    def _product(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = np.take(self.powers[0], rows[0], axis=0)
        more = np.take(self.powers[1], rows[1], axis=0)
        x *= more
        return x, np.take(self.powers[2], rows[2], axis=0, out=more, mode="clip")

    def log_share(self, rows: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Log of the share of each token's item ``which``."""
        width = self.logs[0].shape[1]
        own = sum(np.take(x.reshape(-1), r * width + which).astype("float64") for x, r in zip(self.logs, rows, strict=True))
        total = np.empty(len(which))
        for i in range(0, len(which), SLICE_TOKENS):
            part = slice(i, i + SLICE_TOKENS)
            total[part] = np.einsum("ij,ij->i", *self._product(rows[:, part]))
        return own - np.log(total)


def _based(base: np.ndarray, extras: list[np.ndarray]) -> list[np.ndarray]:
    """``extras``, with ``base`` taken into the first."""
    first = extras[0].reshape(-1, *base.shape) + base
    return [first.reshape(extras[0].shape), *extras[1:]]


@dataclass
class Model:
    """Counts of the frequent words by hash, classes of the endings, and the weights."""

    features: int  # hashed rows of each word feature
    n_slots: int  # words with a slot of their own in each class, at most
    train_tokens: int
    train_words: int  # distinct, the end included
    end_count: int
    classes: np.ndarray  # of endings
    hashes: np.ndarray  # of the head words, ascending
    counts: np.ndarray
    slots: np.ndarray
    tail_mass: np.ndarray  # by class: (count + 0.5) of the words without a slot, and 0.5 for the unseen
    weights: np.ndarray  # by feature row and class
    base: np.ndarray  # log share of each slot in its class; -inf: no such slot
    extras: list[np.ndarray]  # by kind of feature: weights of slots, a row for each value and class
    mix: np.ndarray  # by kind of feature and class

    def weigh(self) -> None:
        """Takes ``mix`` into the weights."""
        for kind, extra in enumerate(self.extras):
            extra *= np.tile(self.mix[kind], len(extra) // CLASSES)[:, None]

    @cached_property
    def class_softmax(self) -> Softmax:
        logs = self.weights[:-1].copy()
        logs[: self.features + 1] += self.weights[-1]  # each token has one of these rows
        return Softmax([logs] * 3)

    @cached_property
    def within_softmax(self) -> Softmax:
        """Of the slots in a class; rows are a feature's value times ``CLASSES``, and the class."""
        return Softmax(_based(self.base, self.extras))

    @cached_property
    def mixed_softmax(self) -> Softmax:
        """The same, of weights that ``mix`` isn't taken into."""
        return Softmax(_based(self.base, [e * np.tile(m, len(e) // CLASSES)[:, None] for e, m in zip(self.extras, self.mix.astype("float32"), strict=True)]))


#: Values of the features within classes: the class before, the word before, the word before that.
VALUES = (CLASSES + 1, WITHIN + 1, WITHIN + 1)


def sizes_of(levels: dict[int, int]) -> tuple[int, int]:
    """Feature rows and slots for a corpus with ``levels[b]`` words that occur 2**b to 2**(b+1) - 1 times."""
    often = sum(k for b, k in levels.items() if b >= OFTEN)
    features, slots = FEATURES, SLOTS
    while features < min(often, MOST_FEATURES):
        features *= 2
    while slots < min(-(-often // END_CLASS), MOST_SLOTS):
        slots *= 2
    return features, slots


def feature_rows(words: np.ndarray, classes: np.ndarray, first: np.ndarray, features: int = FEATURES) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the three features of each token, and the class before it."""

    def before(x: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
        one, two = np.r_[start, x][:-1], np.r_[start, start, x][:-2]
        one[first] = two[first] = start
        second = first + 1
        second = second[second < len(x)]
        alone = np.zeros(len(x), bool)
        alone[first] = True
        two[second[~alone[second]]] = start
        return one, two

    one, two = before(words % features, features)
    c1, c2 = before(classes, START_CLASS)
    pair = 2 * (features + 1) + c1 * (CLASSES + 1) + c2
    return np.stack([one, features + 1 + two, pair]), c1


def within_values(rows: np.ndarray, before: np.ndarray, features: int) -> np.ndarray:
    """Values of the three features within classes: the class before, and the two words before by hash."""
    one, two = rows[0], rows[1] - (features + 1)
    return np.stack([before, np.where(one == features, WITHIN, one % WITHIN), np.where(two == features, WITHIN, two % WITHIN)])


def n_rows(features: int) -> int:
    return 2 * (features + 1) + (CLASSES + 1) ** 2 + 1  # the last is the bias


class Positions(dict):
    """Positions of words from 1 on; a word that is asked for the first time gets the next one."""

    def __missing__(self, word: bytes) -> int:
        at = self[word] = len(self) + 1
        return at

    def all_of(self, words: np.ndarray) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), "int64", len(words))


class Reader:
    """Turns batches of texts into arrays."""

    def __init__(self, model: Model):
        self.model, self.heads = model, pd.Index(model.hashes)

    def _known(self, distinct: pa.LargeBinaryArray, words: np.ndarray) -> np.ndarray:
        """As rows: hash, class, slot and count (-1: not a head word) of each word and, at last, of the end."""
        m, known = self.model, np.empty((4, len(words) + 1), "int64")
        hashes = word_hashes(words)
        at = self.heads.get_indexer(hashes)
        head = np.flatnonzero(at >= 0)
        known[0, :-1] = hashes & 0x7FFFFFFF
        known[1, :-1] = m.classes[endings(distinct)]
        known[2], known[3] = m.n_slots, -1
        known[2, head], known[3, head] = m.slots[at[head]], m.counts[at[head]]
        known[:, -1] = (0, END_CLASS, 0, m.end_count)
        return known

    def read(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The distinct words; each token's place there (-1: the end); the number of tokens of each text; positions
        where texts start; and, as rows, each token's hash, class, slot and count."""
        distinct, codes, sizes = split(texts)
        words, sizes = objects(distinct), sizes + 1
        ends = np.cumsum(sizes)
        inner = np.ones(ends[-1], bool)
        inner[ends - 1] = False
        places = np.full(ends[-1], -1, "int64")
        places[inner] = codes
        return words, places, sizes, ends - sizes, np.take(self._known(distinct, words), places, axis=1)


def _keyed(docs: DataFrame) -> DataFrame:
    data = F.coalesce("text", F.lit("")).cast("binary")
    return docs.select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), data.alias("data")).select("*", *content_key(F.col("data")))


def _gather(train: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored counts: (word, n) of all words, and (cell, n) of endings by the ending before."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found, n = Positions(), np.zeros(2 * MEMO_WORDS, "int64")
        cells = np.zeros(ENDINGS * AROUND, "int64")

        def counted() -> pd.DataFrame:
            return pd.DataFrame({"word": list(found), "cell": -1, "n": n[1 : len(found) + 1]})

        for batch in batches:
            texts = batch["data"].tolist()
            for part in slices(texts):
                distinct, codes, sizes = split(texts[part])
                if not len(codes):
                    continue
                ids = found.all_of(objects(distinct))
                more = len(found) + 1 - len(n)
                if more > 0:
                    n = np.r_[n, np.zeros(more, "int64")]
                n[ids] += np.bincount(codes, minlength=len(ids))
                # pairs of neighbours, without those of a text's last word and the next one's first
                x = endings(distinct)[codes]
                pairs = x[1:] * AROUND + x[:-1] % AROUND
                ends = np.cumsum(sizes)
                across = np.ones(len(pairs), bool)
                across[ends[(ends > 0) & (ends < len(codes))] - 1] = False
                cells += np.bincount(pairs[across], minlength=len(cells))
                if len(found) > MEMO_WORDS:
                    yield counted()
                    found.clear()
                    n[:] = 0
        yield counted()
        full = np.flatnonzero(cells)
        yield pd.DataFrame({"word": None, "cell": full, "n": cells[full]})

    parts = train.select("data").mapInPandas(run, "word binary, cell int, n long")
    both = materialise(parts.groupBy("word", "cell").agg(F.sum("n").alias("n")), "counts")
    return both.where("cell < 0").select("word", "n"), both.where("cell >= 0").select("cell", "n")


def _clustered(cells: pd.DataFrame) -> np.ndarray:
    """Classes of the endings: clusters of those that follow the same endings."""
    grid = np.zeros((ENDINGS, AROUND))
    grid.flat[cells["cell"].to_numpy()] = cells["n"]
    total = grid.sum(axis=1)
    used = np.flatnonzero(total)
    classes = np.arange(ENDINGS) % END_CLASS
    if len(used) > END_CLASS:
        unit = np.sqrt(grid[used] / total[used, None])
        often = used[np.argsort(-total[used], kind="stable")][: 4 * END_CLASS]
        centres = k_means(np.sqrt(grid[often] / total[often, None]), END_CLASS, 12, 5, True)
        classes[used] = (unit @ centres.T).argmax(axis=1)
    return classes.astype("int64")


def _softmax(x: np.ndarray) -> np.ndarray:
    """Of each row, in place."""
    if x.max() > MOST_LOGIT or x.min() < -MOST_LOGIT:
        _less_top(x)
    np.exp(x, out=x)
    x /= (x @ np.ones(x.shape[1], x.dtype))[:, None]
    return x


def _base(cells: np.ndarray, exists: np.ndarray) -> np.ndarray:
    """Log share of each slot in its class. ``exists``: slots of each class."""
    used = np.where(exists, cells.sum(axis=0) + 0.1, 0)
    with np.errstate(divide="ignore"):
        return np.log(used / used.sum(axis=1, keepdims=True))


def _extra(cells: np.ndarray, base: np.ndarray, rounds: int = 60, keep: float = 4.0) -> np.ndarray:
    """Weights of slots with each value of a feature, beside ``base``, by gradient ascent on the gathered
    counts (value, class, slot), with a quadratic penalty; a row for each value and class."""
    total = cells.sum(axis=2, keepdims=True)
    extra, rate = np.zeros(cells.shape), 1.0 / (0.25 * total + keep)
    for _ in range(rounds):
        p = np.exp(base[None] + extra)
        p /= p.sum(axis=2, keepdims=True)
        extra += rate * (cells - total * p - keep * extra)
    return extra.reshape(-1, cells.shape[2]).astype("float32")


def learn(keyed: DataFrame) -> tuple[Model | None, DataFrame]:
    """The model, and the stored counts of the words that aren't head words."""
    spark = keyed.sparkSession
    train = keyed.where(~F.col("held_out"))
    counts, cells = _gather(train)
    n_docs = train.count()
    power = F.floor(F.log2(F.col("n").cast("double"))).cast("int")
    levels = {r["b"]: r["k"] for r in counts.groupBy(power.alias("b")).agg(F.count("*").alias("k")).collect()}
    least, kept = 64, 0
    while least > 0 and kept + levels.get(least - 1, 0) <= HEAD_WORDS:
        least -= 1
        kept += levels.get(least, 0)
    rest = counts.where(F.col("n") < 2.0**least)
    if not n_docs:
        return None, rest
    classes = _clustered(cells.toPandas())
    shared = spark.sparkContext.broadcast(classes)

    def classed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            of = shared.value[endings(pa.array(batch["word"], pa.large_binary()))]
            yield pd.DataFrame({"h": word_hashes(batch["word"].to_numpy()), "cls": of, "n": batch["n"]})

    scratch = Scratch(spark)
    every = scratch.store(counts.mapInPandas(classed, "h long, cls int, n long"), "classed")
    sums = every.groupBy("cls").agg(F.sum("n").alias("n"), F.count("*").alias("k")).toPandas().set_index("cls")
    head = every.where(F.col("n") >= 2.0**least).toArrow()
    h, cls, n = (head[c].to_numpy().astype("int64") for c in ("h", "cls", "n"))
    order = np.lexsort((h, -n, cls))
    starts = np.r_[0, np.flatnonzero(np.diff(cls[order])) + 1] if len(order) else np.empty(0, int)
    slot = np.empty(len(order), "int64")
    slot[order] = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
    features, n_slots = sizes_of(levels)
    slot = np.minimum(slot, n_slots)
    mass = np.full(CLASSES, 0.5)
    mass[sums.index] += sums["n"] + 0.5 * sums["k"]
    own = slot < n_slots
    np.subtract.at(mass, cls[own], n[own] + 0.5)
    order = np.argsort(h, kind="stable")
    tokens = int(sums["n"].sum()) + n_docs
    bias = np.full(CLASSES, 0.5)
    bias[sums.index] += sums["n"]
    bias[END_CLASS] += n_docs
    weights = np.zeros((n_rows(features), CLASSES), "float32")
    weights[-1] = np.log(bias / bias.sum())
    exists = np.zeros((CLASSES, n_slots + 1), bool)
    exists[cls[own], slot[own]] = True
    exists[:END_CLASS, n_slots] = exists[END_CLASS, 0] = True  # unseen words belong to the last item of their class
    none = np.zeros((CLASSES, n_slots + 1), "float32")
    model = Model(features, n_slots, tokens, int(sums["k"].sum()) + 1, n_docs, classes, h[order], n[order], slot[order], mass, weights, none, [], np.full((3, CLASSES), 0.5))
    cells = [np.zeros((k, CLASSES, n_slots + 1)) for k in VALUES]

    def fitted() -> tuple[np.ndarray, list[np.ndarray]]:
        base = _base(cells[0], exists)
        return base.astype("float32"), [_extra(c, base) for c in cells]

    for turn in range(ROUNDS):
        part, last = train.where(F.pmod("k2", F.lit(ROUNDS)) == turn), turn == ROUNDS - 1
        if last:
            model.base, model.extras = fitted()
        moved, seen, slopes = _round(part, model, last)
        model.weights = model.weights + moved
        at = 0
        for c in cells:
            c += seen[at : at + c.size].reshape(c.shape)
            at += c.size
    gradient, curvature = slopes[: 3 * CLASSES].reshape(3, CLASSES), slopes[3 * CLASSES :].reshape(3, 3, CLASSES)
    step = np.linalg.solve(curvature.transpose(2, 0, 1) + 10.0 * np.eye(3), gradient.T[:, :, None])[:, :, 0].T
    model.mix = np.clip(model.mix + step, 0, 1)
    model.base, model.extras = fitted()
    model.weigh()
    scratch.clear()
    give_back()
    return model, rest


def _round(part: DataFrame, model: Model, last: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How far all tasks together move the class weights, how often slots met values of the features within
    classes and, in the last round, gradient and curvature of the mix."""
    shared = part.sparkSession.sparkContext.broadcast(model)
    width = model.n_slots + 1
    n_cells, n_slopes = sum(VALUES) * CLASSES * width, 12 * CLASSES

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        reader, w = Reader(model), model.weights.copy()
        heat = np.ones(w.shape, "float32")
        seen, slopes, n = np.zeros(n_cells, "int32"), np.zeros(n_slopes), 0
        met, waiting = [], 0
        for batch in batches:
            texts = batch["data"].tolist()
            for part in slices(texts):
                *_, first, (words, classes, slot, _) = reader.read(texts[part])
                rows, before = feature_rows(words, classes, first, model.features)
                values = within_values(rows, before, model.features)
                low = 0
                for value, k in zip(values, VALUES, strict=True):
                    high = low + k * CLASSES * width
                    np.add.at(seen, low + (value * CLASSES + classes) * width + slot, 1)
                    low = high
                n += len(words)
                for i in range(0, len(words), STEP_TOKENS):
                    step = slice(i, i + STEP_TOKENS)
                    _update(w, heat, rows[:, step], classes[step])
                if last:
                    _add_own(slopes, model, values, classes, slot)
                    met.append(np.ravel_multi_index((classes, *values), (CLASSES, *VALUES)).astype("int32"))
                    waiting += len(words)
                if waiting > MET_TOKENS:
                    _add_slopes(slopes, model, np.concatenate(met))
                    met, waiting = [], 0
        if waiting:
            _add_slopes(slopes, model, np.concatenate(met))
        if n:
            moved = (w - model.weights).ravel().astype("float16")  # far finer than the steps are sure
            for k, (x, y) in enumerate(zip(np.array_split(moved, PIECES), np.array_split(seen, PIECES), strict=True)):
                yield pd.DataFrame({"k": [k, PIECES + k], "n": n, "x": [x.tobytes(), y.tobytes()]})
            yield pd.DataFrame({"k": [2 * PIECES], "n": [n], "x": [slopes.tobytes()]})

    def added(group: pd.DataFrame) -> pd.DataFrame:
        k = int(group["k"].iloc[0])
        kind = "float16" if k < PIECES else "int32" if k < 2 * PIECES else "float64"
        total = sum(np.frombuffer(x, kind).astype("float64") * (n if k < PIECES else 1) for x, n in zip(group["x"], group["n"], strict=True))
        return pd.DataFrame({"k": [k], "n": [group["n"].sum()], "x": [total.tobytes()]})

    tasks = max(LEAST_TASKS, 2 * part.sparkSession.sparkContext.defaultParallelism)
    out = part.select("data").coalesce(tasks).mapInPandas(run, "k int, n long, x binary").groupBy("k").applyInPandas(added, "k int, n long, x binary")
    rows = out.toPandas().sort_values("k")
    if not len(rows):
        return np.zeros_like(model.weights), np.zeros(n_cells), np.zeros(n_slopes)
    parts = [np.frombuffer(x, "float64") for x in rows["x"]]
    moved = np.concatenate(parts[:PIECES]) / rows["n"].iloc[0]
    return moved.reshape(model.weights.shape).astype("float32"), np.concatenate(parts[PIECES : 2 * PIECES]), parts[-1]


def _add_own(slopes: np.ndarray, model: Model, values: np.ndarray, classes: np.ndarray, slot: np.ndarray) -> None:
    """Adds the part of the gradient (kind, class) that comes from the slots that these tokens have."""
    for i, extra in enumerate(model.extras):
        own = np.take(extra.reshape(-1), (values[i] * CLASSES + classes) * extra.shape[1] + slot)
        slopes[i * CLASSES : (i + 1) * CLASSES] += np.bincount(classes, own, CLASSES)


def _add_slopes(slopes: np.ndarray, model: Model, met: np.ndarray) -> None:
    """Adds the rest of gradient (kind, class) and curvature (kind, kind, class) of these tokens' log probability
    within the class by the mix, at the mix as it is. ``met``: class and values of each token, as one number;
    all that it takes is the same for equal ones, and those of a class lie together."""
    met, times = np.unique(met, return_counts=True)
    for i in range(0, len(met), STEP_TOKENS):
        _add_distinct(slopes, model, met[i : i + STEP_TOKENS], times[i : i + STEP_TOKENS])


def _add_distinct(slopes: np.ndarray, model: Model, met: np.ndarray, times: np.ndarray) -> None:
    classes, *values = np.unravel_index(met, (CLASSES, *VALUES))
    rows, ones = np.stack(values) * CLASSES + classes, np.ones(model.base.shape[1], "float32")
    means, squares = np.empty((3, len(met))), np.empty((3, 3, len(met)))
    for i in range(0, len(met), SLICE_TOKENS):
        part = slice(i, i + SLICE_TOKENS)
        p = model.mixed_softmax.shares(rows[:, part])
        p /= (p @ ones)[:, None]
        parts = [np.take(e, r, axis=0) for e, r in zip(model.extras, rows[:, part], strict=True)]
        weighted = np.empty_like(p)
        for j, one in enumerate(parts):
            np.multiply(p, one, out=weighted)
            means[j, part] = weighted @ ones
            for k in range(j, 3):
                squares[j, k, part] = np.einsum("ij,ij->i", weighted, parts[k])
    at = 3 * CLASSES
    for i in range(3):
        slopes[i * CLASSES : (i + 1) * CLASSES] -= np.bincount(classes, times * means[i], CLASSES)
        for j in range(i, 3):  # symmetric
            more = np.bincount(classes, times * (squares[i, j] - means[i] * means[j]), CLASSES)
            for k in {3 * i + j, 3 * j + i}:
                slopes[at + k * CLASSES : at + (k + 1) * CLASSES] += more


def _summed(p: np.ndarray, order: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ``keys`` and, for each, the sum of the rows ``order`` of ``p`` that have it; ``keys`` ascend.

    Rows of a key form chains of up to ``CHAIN``. Chains lie by length, so that the n-th rows of all that have one
    are added at once; the sums of a key's chains meet in another turn."""
    new = np.r_[True, keys[1:] != keys[:-1]]
    starts = np.flatnonzero(new)
    chains = -(-np.diff(starts, append=len(keys)) // CHAIN)
    n = int(chains.sum())
    heads = np.repeat(starts - CHAIN * (np.cumsum(chains) - chains), chains) + CHAIN * np.arange(n)
    sizes = np.diff(heads, append=len(keys))
    heads = heads[np.argsort((CHAIN - sizes).astype("uint8"), kind="stable")]
    longer = len(heads) - np.cumsum(np.bincount(sizes, minlength=CHAIN))  # chains of more than so many rows
    sums = np.take(p, order[heads], axis=0)
    more = np.empty_like(sums)
    for j, k in enumerate(longer[1 : sizes.max()].tolist(), 1):
        sums[:k] += np.take(p, order[heads[:k] + j], axis=0, out=more[:k], mode="clip")
    keys = keys[heads]
    if n == len(starts):
        return keys, sums
    again = np.argsort(keys, kind="stable")
    return _summed(sums, again, keys[again])


def _update(w: np.ndarray, heat: np.ndarray, rows: np.ndarray, classes: np.ndarray) -> None:
    """One gradient step on a minibatch: each row that occurs moves by its own adapted rate."""
    p = _softmax(_logits(w, rows))
    p[np.arange(len(classes)), classes] -= 1
    keys = rows.ravel().astype("uint16" if len(w) <= 1 << 16 else "int64")  # kinds have rows of their own
    order = np.argsort(keys, kind="stable")
    at, g = _summed(p, order % len(classes), keys[order])
    for i in range(0, len(at), SLICE_TOKENS):
        part, h = at[i : i + SLICE_TOKENS], g[i : i + SLICE_TOKENS]
        warm = np.take(heat, part, axis=0)
        warm += h * h
        heat[part] = warm
        np.sqrt(warm, out=warm)
        h *= np.float32(RATE)
        h /= warm
        w[part] -= h
    g = np.ones(len(p), p.dtype) @ p
    heat[-1] += g * g
    w[-1] -= RATE * g / np.sqrt(heat[-1])


def batch_scores(model: Model, reader: Reader, texts: list[bytes]) -> tuple[list, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: the words that aren't head words, with their number; tokens; known head words; the sum of
    log10(count + 0.5) over head words; and the log10 probability, both still without that sum over the others."""
    distinct, places, sizes, first, (hashes, classes, slot, count) = reader.read(texts)
    rows, before = feature_rows(hashes, classes, first, model.features)
    scores = np.empty(len(hashes))
    for i in range(0, len(hashes), STEP_TOKENS):
        part = slice(i, i + STEP_TOKENS)
        scores[part] = model.class_softmax.log_share(rows[:, part], classes[part])
        values = within_values(rows[:, part], before[part], model.features)
        scores[part] += model.within_softmax.log_share(values * CLASSES + classes[part], slot[part])
    scores /= math.log(10)
    half = np.log10(np.maximum(count, 0) + 0.5)
    half[count < 0] = 0
    tail = (slot == model.n_slots) & (classes != END_CLASS)
    scores[tail] += half[tail] - np.log10(model.tail_mass[classes[tail]])
    known = np.add.reduceat(count > 0, first)
    rare = np.flatnonzero(count < 0)
    bounds = np.searchsorted(rare, np.r_[first, len(count)])
    words = distinct[places[rare]].tolist()
    other = [Counter(words[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return other, sizes, known, np.add.reduceat(half, first), np.add.reduceat(scores, first)


def scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    keyed = _keyed(docs)
    model, rest = learn(keyed)
    if model is None:
        n = F.size(F.array_compact(F.transform(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: F.when(w != "", w)))) + 1
        zero = F.lit(0.0)
        none = docs.select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), n.cast("long").alias("n_tokens"), F.lit(0).cast("long").alias("n_known"))
        return none.select("*", F.lit(0).cast("long").alias("train_tokens"), zero.alias("base_score"), zero.alias("score"))
    shared = keyed.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        reader = Reader(model)
        for batch in batches:
            texts = batch["data"].tolist()
            for part in slices(texts):
                other, sizes, known, half, found = batch_scores(model, reader, texts[part])
                yield batch.iloc[part].drop(columns="data").assign(
                    n_tokens=sizes, known=known, half=half, found=found, rare=[list(c) for c in other], times=[list(c.values()) for c in other]
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, k1 long, k2 long, n_tokens long, known long, half double, found double, rare array<binary>, times array<long>"
    scored = materialise(keyed.select("doc_id", "held_out", "k1", "k2", "data").mapInPandas(run, schema), "scored")
    one = scored.where(F.size("rare") > 0).groupBy("k1", "k2").agg(F.first(F.arrays_zip("rare", "times")).alias("pairs"))
    pairs = one.select("k1", "k2", F.inline("pairs")).withColumnRenamed("rare", "word").join(rest, "word", "left")
    n = F.coalesce("n", F.lit(0))
    sums = pairs.groupBy("k1", "k2").agg(F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("more"), F.sum(F.col("times") * F.log10(n + 0.5)).alias("rest"))
    both = scored.join(materialise(sums, "rare-words"), ["k1", "k2"], "left")
    whole = math.log10(model.train_tokens + 0.5 * (model.train_words + 1))
    rest_sum = F.coalesce("rest", F.lit(0.0))
    return both.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(model.train_tokens).cast("long").alias("train_tokens"),
        (F.col("half") + rest_sum - F.col("n_tokens") * whole).alias("base_score"),
        (F.col("found") + rest_sum).alias("score"),
    )
