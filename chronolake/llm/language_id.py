"""Language identification by hierarchical discrimination.

Languages are grouped into families by the likeness of their n-gram profiles. A text's family is predicted
first, by linear classifiers of one family against the others; within the family one-versus-one linear
support vector machines vote on the language.

Features are counts of byte n-grams (1 to 4) of the whole text, with A-Z lower-cased and ASCII digits,
punctuation and blanks read as one blank, hashed into ``BUCKETS``; square roots of the shares, so that
every vector has length one. The models are fitted on a bounded sample (at most ``SAMPLE`` labelled rows,
evenly by language, chosen by a hash of id and text); prediction is one pass without a shuffle.

``keep_identified`` also asks whether a text is of a learned language at all: the margin of its best family
(the classifier's raw value, near 0 where nothing speaks for any family) must reach a part of what the
labelled rows of the held-out fold reach.

Defined cases: a text that is null or without letters is ``und`` with score 0; without any labelled row
everything else is ``und`` as well; one learned language is predicted with score 1; of more than ``SAMPLE``
languages the most frequent are learned; repeated rows get equal results; ties go to the language that
sorts first; an empty table gives an empty result; the columns lang, source and doc_id are never inputs of
a prediction.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronolake.llm.common import claim, fold, give_back

BUCKETS, ORDERS = 4096, 4
#: Most labelled rows that the models are fitted on.
SAMPLE = 4000
UNDETERMINED = "und"
#: A text of a learned language reaches this part of the margin of 99 % of the held-out labelled rows.
LEAST_MARGIN = 0.25
#: Bytes whose n-grams are hashed at once.
CHUNK = 1 << 20
#: Texts whose vectors are judged at once.
TEXTS = 256
_ASCII = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_MULTIPLIERS = (0, 0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35)


def has_letters(text: str) -> bool:
    return text.isalpha() or any(map(str.isalpha, text))


def features(text: str) -> np.ndarray:
    """The vector of one text."""
    data = np.frombuffer(b" " + b" ".join(text.encode("utf-8", "replace").translate(_ASCII).split()) + b" ", "uint8")
    counts = np.zeros(BUCKETS, "int64")
    for at in range(0, len(data), CHUNK):
        part = data[at : at + CHUNK + ORDERS - 1].astype("uint32")
        x = np.zeros(len(part), "uint32")
        for n in range(ORDERS):
            x = (x[: len(part) - n] + part[n:] + np.uint32(1)) * np.uint32(0x01000193) if n == 0 else (x[:-1] ^ (part[n:] * np.uint32(_MULTIPLIERS[n]))) * np.uint32(0x01000193)
            x ^= x >> np.uint32(15)
            counts += np.bincount((x * np.uint32(0x2C1B3C6D) >> np.uint32(20))[: min(CHUNK, len(x))], minlength=BUCKETS)
    return np.sqrt(counts / max(1, counts.sum())).astype("float32")


def linear_svm(x: np.ndarray, positive: np.ndarray, rounds: int = 60, keep: float = 1e-4) -> np.ndarray:
    """Weights (the last is the bias) of linear classifiers with squared hinge loss, by accelerated gradient: one
    for each column of ``positive``, all at once, as rows of the result."""
    y = np.where(positive, 1, -1).astype("float32")
    shares = [0.5 / np.maximum(1, which.sum(axis=0)) for which in (positive, ~positive)]
    weight = np.where(positive, *shares).astype("float32")
    w = look = np.zeros((x.shape[1] + 1, positive.shape[1]), "float32")
    step = (1 / (4 * weight.sum(axis=0) + keep)).astype("float32")
    for i in range(rounds):
        pull = weight * y * np.maximum(0, 1 - y * (x @ look[:-1] + look[-1]))
        grad = -2 * np.vstack([x.T @ pull, pull.sum(axis=0)]) + np.float32(keep) * look
        new = look - step * grad
        look = new + np.float32(i / (i + 3)) * (new - w)
        w = new
    return np.ascontiguousarray(w.T)


def grouped(profile: np.ndarray, wanted: int) -> list[list[int]]:
    """Rows of ``profile`` in ``wanted`` groups: the two most alike on average join, again and again; ties to the
    first. Every group knows its best partner among the later ones, so that a step compares few pairs anew."""
    alike = (profile @ profile.T).astype("float64")
    n, members = len(alike), {i: [i] for i in range(len(alike))}
    sizes, there = np.ones(n), np.ones(n, bool)

    def partner(i: int) -> tuple[float, int]:
        means = np.where(there[i + 1 :], alike[i, i + 1 :] / (sizes[i] * sizes[i + 1 :]), -np.inf)
        at = int(means.argmax()) if len(means) else 0
        return (float(means[at]), i + 1 + at) if len(means) else (-np.inf, i)

    known = [partner(i) for i in range(n)]
    while len(members) > wanted:
        i = max(members, key=lambda g: (known[g][0], -g))
        j = known[i][1]
        members[i] += members.pop(j)
        alike[i] += alike[j]
        alike[:, i] += alike[:, j]
        sizes[i] += sizes[j]
        there[j] = False
        known[i] = partner(i)
        for g in members:
            if g < i:
                mean = float(alike[g, i] / (sizes[g] * sizes[i]))
                known[g] = partner(g) if known[g][1] in (i, j) else max(known[g], (mean, i), key=lambda p: (p[0], -p[1]))
            elif g < j and known[g][1] == j:
                known[g] = partner(g)
    return list(members.values())


@dataclass
class LanguageModel:
    """Families (lists of languages), a classifier for each family and for each pair within one."""

    families: list[list[str]]
    of_family: np.ndarray
    pairs: list[list[tuple[int, int]]]
    of_pairs: list[np.ndarray]

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language and score of each row (the product of both decisions' certainties), and the margin of
        its family."""
        x = np.hstack([x, np.ones((len(x), 1), "float32")])
        raw = x @ self.of_family.T
        first = 1 / (1 + np.exp(-4 * raw))
        share = first / first.sum(axis=1, keepdims=True)
        family = first.argmax(axis=1)
        names, scores = np.empty(len(x), object), share[np.arange(len(x)), family].astype("float64")
        for f, languages in enumerate(self.families):
            rows = np.flatnonzero(family == f)
            votes = np.zeros((len(rows), len(languages)))
            sure = np.zeros((len(rows), len(languages)))
            for (a, b), w in zip(self.pairs[f], self.of_pairs[f], strict=True):
                p = 1 / (1 + np.exp(-4 * (x[rows] @ w)))
                votes[:, a] += p >= 0.5
                votes[:, b] += p < 0.5
                sure[:, a] += p
                sure[:, b] += 1 - p
            if len(languages) > 1:
                sure /= len(languages) - 1
                votes += sure / 2
                best = votes.argmax(axis=1)
                scores[rows] *= sure[np.arange(len(rows)), best]
            else:
                best = np.zeros(len(rows), int)
            names[rows] = np.array(languages, object)[best]
        return names.tolist(), scores.clip(0, 1), raw.max(axis=1).astype("float64")


def fit(x: np.ndarray, languages: list[str]) -> LanguageModel | None:
    """Groups the languages into half as many families, most alike first, and fits the classifiers."""
    labels = np.array(languages, object)
    names = sorted(set(languages))
    if not names:
        return None
    order = np.argsort(labels, kind="stable")
    ends = np.searchsorted(labels[order], np.array(names, object), side="right").tolist()
    of = {name: order[low:high] for name, low, high in zip(names, [0, *ends[:-1]], ends, strict=True)}  # its rows
    profile = np.stack([x[of[n]].mean(axis=0) for n in names])
    profile /= np.sqrt((profile * profile).sum(axis=1, keepdims=True))
    families = [[names[i] for i in sorted(g)] for g in grouped(profile, (len(names) + 1) // 2)]
    family = {name: n for n, f in enumerate(families) for name in f}
    own = np.array([family[name] for name in languages])
    of_family = np.zeros((1, x.shape[1] + 1), "float32")
    if len(families) > 1:  # so many at once that what they need is as large as the sample at most
        parts = [np.arange(at, min(at + BUCKETS, len(families))) for at in range(0, len(families), BUCKETS)]
        of_family = np.concatenate([linear_svm(x, own[:, None] == part[None, :]) for part in parts])
    pairs = [list(combinations(range(len(f)), 2)) for f in families]
    of_pairs = []
    for f, wanted in zip(families, pairs, strict=True):
        found = []
        for a, b in wanted:
            rows = np.sort(np.concatenate([of[f[a]], of[f[b]]]))
            found.append(linear_svm(x[rows], (labels[rows] == f[a])[:, None])[0])
        of_pairs.append(np.array(found))
    return LanguageModel(families, of_family, pairs, of_pairs)


def learn(docs: DataFrame) -> LanguageModel | None:
    """Fits on a bounded sample of the rows outside fold 0 that have a language and a text."""
    held = docs.where((fold(F.col("doc_id")) != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    spot = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_003))
    sizes = held.groupBy("lang").agg(F.count("*").alias("n"), F.min(spot).alias("low")).orderBy(F.desc("n"), "lang").limit(SAMPLE).collect()
    each = SAMPLE // max(1, len(sizes))
    # Twice as many as are wanted, to rank few; one text at least. A row for each of at most SAMPLE languages.
    limits = [(r["lang"], max(int(2_000_006 * each / r["n"]) + 2000, r["low"] + 1)) for r in sizes]
    limits = F.broadcast(docs.sparkSession.createDataFrame(limits, "lang string, limit long"))
    chosen = held.select("lang", "text", spot.alias("spot")).join(limits, "lang").where(F.col("spot") < F.col("limit"))
    order = Window.partitionBy("lang").orderBy("spot", "text")
    chosen = chosen.withColumn("place", F.row_number().over(order)).where(F.col("place") <= each).select("lang", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            good = batch[[has_letters(t) for t in batch["text"]]]
            yield pd.DataFrame({"lang": good["lang"], "x": [features(t).tobytes() for t in good["text"]]})

    return fit(*_fetched(chosen.mapInPandas(run, "lang string, x binary")))


def _fetched(rows: DataFrame) -> tuple[np.ndarray, list[str]]:
    """The sample's vectors and languages on the driver, in an order that depends on their content alone:
    at most ``SAMPLE`` vectors of 16 KB, of which two copies exist for a moment."""
    table = rows.toArrow()
    names, vectors = table["lang"].to_pylist(), table["x"]
    digests = [hashlib.blake2b(v.as_buffer(), digest_size=16).digest() for v in vectors]
    order = sorted(range(len(names)), key=lambda i: (names[i], digests[i]))
    x = np.empty((len(names), BUCKETS), "float32")
    for at, i in enumerate(order):
        x[at] = np.frombuffer(vectors[i].as_buffer(), "float32")
    return x, [names[i] for i in order]


def _judged(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """Columns of ``docs`` by number, then lang_pred, score and margin; one pass."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at_text = str(docs.columns.index("text"))

    names = [*(str(i) for i in range(len(docs.columns))), "lang_pred", "score", "margin"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("language")
        model = shared.value
        for batch in batches:
            for low in range(0, batch.num_rows, TEXTS):
                part = batch.slice(low, TEXTS)
                texts = part[at_text].to_pylist()
                found, scores, margins = np.full(len(texts), UNDETERMINED, object), np.zeros(len(texts)), np.zeros(len(texts))
                known = [i for i, t in enumerate(texts) if model is not None and t is not None and has_letters(t)]
                if known:
                    found[known], scores[known], margins[known] = model.predict(np.stack([features(texts[i]) for i in known]))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.string()), pa.array(scores), pa.array(margins)], names)

    plain = docs.select(*[docs[c].alias(str(i)) for i, c in enumerate(docs.columns)])
    types = [f"`{i}` {f.dataType.simpleString()}" for i, f in enumerate(docs.schema)]
    return plain.mapInArrow(run, ", ".join([*types, "lang_pred string", "score double", "margin double"]))


def predictions(docs: DataFrame, model: LanguageModel | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row, by ``model`` or one learned from ``docs``."""
    found = _judged(docs.select("doc_id", "text"), model or learn(docs))
    give_back()
    return found.select(F.col("0").alias("doc_id"), (fold(F.col("0")) == 0).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, least_score: float = 0.3) -> DataFrame:
    """``docs`` without those whose language stays undetermined, that score below ``least_score``, or whose
    margin lies below ``LEAST_MARGIN`` of the labelled held-out rows' first percentile. The held-out fold is
    judged by itself first; then one pass judges and decides, and no text is stored or shuffled for it."""
    model = learn(docs)
    held = docs.where((fold(F.col("doc_id")) == 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    known = _judged(held.select("text"), model).where(F.col("lang_pred") != UNDETERMINED)
    low = known.agg(F.percentile_approx("margin", F.lit(0.01), 10_000).alias("q")).first()["q"]
    least = LEAST_MARGIN * low if low is not None else float("-inf")
    judged = _judged(docs, model)
    del model
    give_back()
    found = judged.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least_score) & (F.col("margin") >= least))
    return found.select(*[F.col(str(i)).alias(c) for i, c in enumerate(docs.columns)])
