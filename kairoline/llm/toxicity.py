"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is logistic in its words and the words' beginnings, and the
document's score is the noisy-or of its sentences: 1 - prod(1 - p). Training sees document labels alone and moves the
weights by the gradient of the document's log loss, which falls mostly on the sentences that already look worst.
So the sentence scores locate what offends.

Fitting takes a bounded sample: at most ``per_class`` labelled documents of each class, those with the smallest hash of
the text. A document of up to WHOLE * ``sample_chars`` characters teaches whole, as its offence may lie anywhere; of
a longer one ``sample_chars`` characters from a hash-chosen start do. Both bounds hold for fitting only; scoring reads whole texts. With one class only, all scores are 0 or 1 as the labels say; without labels 0.

Nulls: a null or empty text has no sentence and scores 0. Rows whose label or text is null teach nothing. Repeated
rows each come back. Columns other than those named are not read. Empty tables give empty results.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, ship, sliced

PER_CLASS = 3000
SAMPLE_CHARS = 6000
WHOLE = 8
PREFIXES = (4, 5)
MIN_DOCS = 3
EPOCHS = 200
THRESHOLD = 0.7

_SENTENCE = re.compile(r"[.!?\n]+")
_WORD = re.compile(r"[^\W\d_]+")


def sentence_spans(text: str) -> list[tuple[int, int]]:
    """Pieces between full stops, marks and line ends, blank ones left out."""
    out, at = [], 0
    for m in _SENTENCE.finditer(text):
        out.append((at, m.start()))
        at = m.end()
    out.append((at, len(text)))
    return [(a, b) for a, b in out if not text[a:b].isspace() and a < b]


def features(word: str) -> list[str]:
    """The word and its beginnings. A beginning ends in *, which no word has."""
    return [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) > n)]


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    #: A sentence's log odds without any known word.
    bias: float = -20.0
    words: dict[str, float] = field(default_factory=dict)

    def word(self, w: str) -> float:
        """A word's weight with those of its beginnings, remembered for words seen before."""
        got = self.words.get(w)
        if got is None:
            got = sum(self.weights.get(f, 0.0) for f in features(w))
            if len(self.words) < 200_000:
                self.words[w] = got
        return got

    def sentence(self, text: str) -> float:
        """Log odds: the weights of a sentence's different words."""
        return self.bias + sum(map(self.word, set(_WORD.findall(text.lower()))))

    def sentences(self, text: str | None) -> list[tuple[int, int, float]]:
        """Start, end and probability of each sentence."""
        return [(a, b, float(_sigmoid(self.sentence(text[a:b])))) for a, b in sentence_spans(text or "")]

    def offending(self, text: str | None, threshold: float = THRESHOLD) -> list[tuple[int, int, float]]:
        """The sentences at the threshold or above, or else the likeliest one, likeliest first."""
        ranked = sorted(self.sentences(text), key=lambda s: (-s[2], s[0]))
        return [s for s in ranked if s[2] >= threshold] or ranked[:1]

    def document(self, text: str | None) -> float:
        """The noisy-or of the sentences."""
        # log(1 - p) of a sentence with log odds z is -log(1 + e**z)
        return float(-np.expm1(-np.logaddexp(0, self.log_odds(text)).sum()))

    def log_odds(self, text: str | None) -> np.ndarray:
        return np.array([self.sentence(s) for s in _SENTENCE.split(text or "") if s and not s.isspace()], float)


def _sigmoid(z):
    return 0.5 * (1 + np.tanh(0.5 * np.asarray(z)))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", per_class: int = PER_CLASS, sample_chars: int = SAMPLE_CHARS) -> Model:
    """From a bounded sample of labelled documents."""
    known = labels.where(F.col(label).isin(0, 1)).groupBy(F.col(key).alias("k")).agg(F.max(label).alias("y"))
    # by hash alone first: texts of the chosen documents only are carried on
    hashed = docs.where(F.length(text) > 0).select(F.col(key).alias("k"), F.xxhash64(text).alias("h")).join(known, "k")
    # for each class, every task sends its least ones on, so no task gathers a class
    chosen = [hashed.where(F.col("y") == y).orderBy("h", "k").limit(per_class).distinct() for y in (0, 1)]
    wanted = [r for one in chosen for r in one.collect()]  # 2 * per_class rows at most
    if not wanted:
        return Model()
    keys = docs.sparkSession.createDataFrame([(r["k"], r["h"], int(r["y"])) for r in wanted], T.StructType([T.StructField("k", docs.schema[key].dataType), T.StructField("h", T.LongType()), T.StructField("y", T.IntegerType())]))
    own = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.xxhash64(text).alias("h")).join(F.broadcast(keys), ["k", "h"])
    start = F.pmod(F.col("h"), F.greatest(F.lit(1), F.length("t") - sample_chars + 1)).cast("int") + 1
    part = F.when(F.length("t") <= WHOLE * sample_chars, F.col("t")).otherwise(F.substring(F.col("t"), start, F.lit(sample_chars)))
    rows = own.select("k", "h", "y", part.alias("t")).dropDuplicates(["k", "h"]).collect()
    rows.sort(key=lambda r: (r["h"], str(r["k"])))
    return calibrated([r["t"] for r in rows], [r["y"] for r in rows])


def calibrated(texts: list[str], labels: list[int], threshold: float = THRESHOLD, part: int = 5) -> Model:
    """A model of all the documents, whose sentences' bias is set on every ``part``-th by a model of the others: so that the
    threshold gets most of both classes right, midway between the documents on its two sides."""
    model = train(texts, labels)
    held = range(0, len(texts), part)
    rest = [i for i in range(len(texts)) if i % part]
    y = np.array([labels[i] for i in held])
    if len(rest) < 50 or len({labels[i] for i in rest}) < 2 or len(set(y.tolist())) < 2:
        return model
    other = train([texts[i] for i in rest], [labels[i] for i in rest])
    z = _room([other.log_odds(texts[i]) for i in held], threshold)
    order = np.argsort(z, kind="stable")
    z, y = z[order], y[order]
    # right when the cut lies above the first k: those below that are 0, those above that are 1
    right = np.append(0, np.cumsum(y == 0)) / max(1, (y == 0).sum()) + np.append(np.cumsum((y == 1)[::-1])[::-1], 0) / max(1, (y == 1).sum())
    best = np.nonzero(right == right.max())[0]
    k = int(best[len(best) // 2])
    low, high = z[k - 1] if k else z[0], z[k] if k < len(z) else z[-1]
    model.bias -= float((low + high) / 2)
    return model


def _room(documents: list[np.ndarray], threshold: float, reach: float = 60.0) -> np.ndarray:
    """By how much each document's sentences may lose in log odds until their noisy-or falls to the threshold, by halving
    a range of ``reach`` either way."""
    at = np.repeat(np.arange(len(documents)), [len(z) for z in documents])
    every = np.concatenate(documents) if len(at) else np.zeros(0)
    low, high = np.full(len(documents), -reach), np.full(len(documents), reach)
    for _ in range(50):
        mid = (low + high) / 2
        above = np.bincount(at, np.logaddexp(0, every - mid[at]), len(documents)) >= -math.log1p(-threshold)
        low, high = np.where(above, mid, low), np.where(above, high, mid)
    return (low + high) / 2


def train(texts: list[str], labels: list[int], epochs: int = EPOCHS, rate: float = 0.2, decay: float = 1e-5) -> Model:
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        return Model(bias=20.0 if len(y) and y[0] else -20.0)
    # features as numbers, in the order in which they come
    number: dict[str, int] = {}
    of_word: dict[str, tuple[int, ...]] = {}

    def numbers(word: str) -> tuple[int, ...]:
        got = of_word.get(word)
        if got is None:
            got = of_word[word] = tuple(number.setdefault(f, len(number)) for f in features(word))
        return got

    doc, sizes, flat = array("i"), array("i"), array("i")
    having: tuple[list[int], list[int]] = ([], [])  # documents of each class that have a feature
    for d, (t, label) in enumerate(zip(texts, labels, strict=True)):
        in_text: set[int] = set()
        for a, b in sentence_spans(t):
            own = {n for w in set(_WORD.findall(t[a:b].lower())) for n in numbers(w)}
            doc.append(d)
            sizes.append(len(own))
            flat.extend(sorted(own))
            in_text |= own
        for counts in having:
            counts.extend([0] * (len(number) - len(counts)))
        for f in in_text:
            having[label][f] += 1
    of_word.clear()
    seen = [np.array(counts, np.int64) for counts in having]
    doc, sizes, cols = (np.frombuffer(x, np.int32) if len(x) else np.zeros(0, np.int32) for x in (doc, sizes, flat))
    n = [labels.count(0), labels.count(1)]
    # a start: how much likelier a feature is in toxic documents
    odds = np.log((seen[1] + 0.5) / (n[1] + 1) * (n[0] + 1) / (seen[0] + 0.5))
    # features of few documents teach chance; common ones that are as frequent in both classes teach nothing
    total = seen[0] + seen[1]
    useful = (total >= MIN_DOCS) & ((np.abs(odds) >= 0.25) | (total < 100))
    place = np.cumsum(useful) - 1
    kept = useful[cols]
    row = np.repeat(np.arange(len(doc), dtype=np.int32), sizes)[kept].astype(np.int64)
    cols = place[cols[kept]]
    doc = doc.astype(np.int64)
    vocabulary = [f for f, u in zip(number, useful, strict=True) if u]
    w = np.where(np.abs(odds) > 1.5, odds, 0.0)[useful] * 0.5
    bias, m, v = -5.0, np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    each = np.where(y == 1, 0.5 / n[1], 0.5 / n[0])  # both classes weigh the same
    for epoch in range(1, epochs + 1):
        z = bias + np.bincount(row, w[cols], len(doc))
        total = np.bincount(doc, np.logaddexp(0, z), len(y))  # -log(1 - P)
        # of the log loss by z: for a label of 0 the sentence's p; for 1, -p (1 - P) / P
        pull = np.where(y == 1, -1 / np.maximum(np.expm1(np.minimum(total, 50)), 1e-6), 1.0)
        gz = _sigmoid(z) * (pull * each)[doc]
        g = np.append(np.bincount(cols, gz[row], len(w)) + decay * w, gz.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = rate * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.99**epoch)) + 1e-8)
        w, bias = w - step[:-1], bias - step[-1]
    return Model({f: float(x) for f, x in zip(vocabulary, w, strict=True) if abs(x) > 1e-3}, float(bias))


def score(df: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",), located: int | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """The kept columns, score, predicted and, of documents predicted toxic, the offending sentences as start, end and
    probability, likeliest first: all at the threshold or above, and the likeliest one where none is. ``located`` bounds
    their number. A kept column named like a result raises."""
    if {"score", "predicted", "offending"} & set(keep):
        raise ValueError("score, predicted and offending are results")
    ship(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(model)
    chosen = df.select(*keep, F.col(text).alias(fresh(keep, "text")[0]))
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("p", T.DoubleType())])
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in sliced(batches):
            texts = batch.column(len(keep)).to_pylist()
            scores = [own.document(t) for t in texts]
            worst = [own.offending(t, threshold)[:located] if p >= threshold else [] for t, p in zip(texts, scores, strict=True)]
            spans = pa.array([[{"start": a, "end": b, "p": p} for a, b, p in s] for s in worst], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(scores, pa.float64()), pa.array([int(p >= threshold) for p in scores], pa.int32()), spans], names)

    names = [*keep, "score", "predicted", "offending"]
    fields = [chosen.schema[n] for n in keep]
    return chosen.mapInArrow(scan, T.StructType([*fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("offending", T.ArrayType(span))]))
