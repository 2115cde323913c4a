"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text is its set of different words (ASCII case folded); a feature is an n-gram of ``GRAMS`` bytes of a word between word
marks, hashed to ``2 ** BITS`` buckets, and its count is the number of different words that hold it. For training, each
bucket gets the ratio ``r = log((pos + a) / |pos|) - log((neg + a) / |neg|)`` of the documents of both labels that hold it,
and logistic regression with an L2 penalty is fitted on the features ``r * count``. A word's n-grams add up, so that the
score of a text is a sum over its different words.

Training uses a bounded sample: the ``FIT_ROWS`` labelled rows with the smallest hash of their id. Everything else covers
whole texts of all documents. The model is one weight per bucket, a fixed 2^16 numbers, whatever the corpus.

Nulls: a null text is scored like an empty one; labels other than 0 and 1 and rows without id are not used; a document
labelled twice alike counts once, and so does an id that several documents have. Without labelled rows every score is 0. Repeated rows are scored alike; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cobblestone.llm.common import map_batches
from cobblestone.llm.words import Words, mix, words_of

GRAMS = (3, 4, 5)
BITS = 16
FIT_ROWS = 4096
#: Buckets that get a weight: those whose ratio stands out most for the number of documents behind it.
KEEP = 4096
FOLDS = 5


@dataclass
class Model:
    weights: np.ndarray  # per bucket, the ratio included
    bias: float
    trained: bool = True


def _distinct_words(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per (document, different word): the document and the number of the word; per number: an example place."""
    _, example, number = np.unique(words.codes(), return_index=True, return_inverse=True)
    pairs = np.unique(words.owner.astype(np.int64) * max(1, len(example)) + number)
    return pairs // max(1, len(example)), pairs % max(1, len(example)), example


def _word_buckets(words: Words, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of the words at ``places``: (index into places, bucket)."""
    length = words.end[places] - words.begin[places] + 2
    first = np.concatenate([[0], np.cumsum(length)])
    which = np.repeat(np.arange(len(places)), length)
    inside = np.arange(first[-1]) - first[which]
    body = (inside > 0) & (inside < length[which] - 1)
    letters = np.full(first[-1], 1, np.uint64)  # the mark before and after a word
    letters[body] = words.data[(words.begin[places][which] + inside - 1)[body]]
    owners, buckets = [], []
    for n in GRAMS:
        at = np.flatnonzero(inside + n <= length[which])
        value = np.full(len(at), n, np.uint64)
        for j in range(n):
            value = value << np.uint64(8) | letters[at + j]
        owners.append(which[at])
        buckets.append((mix(value) >> np.uint64(64 - BITS)).astype(np.int64))
    return np.concatenate(owners), np.concatenate(buckets)


def features(docs: DataFrame, text: str, label: str) -> DataFrame:
    """(label, buckets, counts) per document; buckets are different and in order."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        labels = batch.column(1).to_numpy(zero_copy_only=False)
        for words in words_of(batch.column(0), lower=True):
            doc, number, example = _distinct_words(words)
            owner, bucket = _word_buckets(words, example)
            order = np.argsort(owner, kind="stable")
            bucket, start = bucket[order], np.searchsorted(owner[order], np.arange(len(example) + 1))
            reps = np.diff(start)[number]
            at = np.repeat(start[number] - (np.cumsum(reps) - reps), reps) + np.arange(reps.sum())
            key, count = np.unique(np.repeat(doc, reps) << BITS | bucket[at], return_counts=True)
            bounds = np.searchsorted(key >> BITS, np.arange(words.docs + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(bounds, pa.array(x.astype(np.int32))) for x in (key & ((1 << BITS) - 1), count)]
            yield pa.RecordBatch.from_arrays([pa.array(labels[words.first : words.first + words.docs].astype(np.int32)), *lists], ["label", "buckets", "counts"])

    return map_batches(docs.select(text, label), run, "label int, buckets array<int>, counts array<int>")


def fit(rows: pa.Table, smoothing: float = 1.0, penalty: float = 1e-5, steps: int = 600, keep: int = KEEP) -> Model:
    """Logistic regression on the scaled features of a bounded sample (label, buckets, counts)."""
    size = 1 << BITS
    y = rows["label"].to_numpy().astype(float)
    if not len(y):
        return Model(np.zeros(size, np.float32), 0.0, False)
    lists = rows["buckets"].combine_chunks()
    bucket = lists.flatten().to_numpy()
    count = rows["counts"].combine_chunks().flatten().to_numpy().astype(np.float32)
    lengths = np.diff(lists.offsets.to_numpy())
    doc = np.repeat(np.arange(len(y)), lengths)
    held = [np.bincount(bucket[(y == k)[doc]], minlength=size) + smoothing for k in (0, 1)]
    ratio = np.log(held[1] / held[1].sum()) - np.log(held[0] / held[0].sum())
    strength = np.abs(ratio) * np.sqrt(held[0] + held[1] - 2 * smoothing)
    ratio[np.argsort(-strength, kind="stable")[keep:]] = 0.0
    told = ratio[bucket] != 0
    bucket, doc, count = bucket[told], doc[told], count[told]
    value = count * ratio[bucket].astype(np.float32)
    # unit length in the mean keeps the step size and the penalty independent of the texts' length
    scale = np.sqrt(max(1e-9, float((value**2).sum()) / len(y)))
    value /= scale
    # Nesterov's accelerated gradient; the mean loss has a curvature of at most the mean square length / 4
    w, bias = np.zeros(size), float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    look, look_bias, rate = w.copy(), bias, 4.0
    momentum = 1.0
    for _ in range(steps):
        z = np.bincount(doc, value * look[bucket], minlength=len(y)) + look_bias
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        gap = (p - y) / len(y)
        grad = np.bincount(bucket, value * gap[doc], minlength=size) + penalty * look
        new, new_bias = look - rate * grad, look_bias - rate * gap.sum()
        faster = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        blend = (momentum - 1) / faster
        look, look_bias = new + blend * (new - w), new_bias + blend * (new_bias - bias)
        w, bias, momentum = new, new_bias, faster
    return Model((w * ratio / scale).astype(np.float32), bias)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` without its text, with ``score``."""
    rest = [f for f in docs.schema.fields if f.name not in (text, "score")]

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for words in words_of(batch.column(0), lower=True):
            doc, number, example = _distinct_words(words)
            owner, bucket = _word_buckets(words, example)
            each = np.bincount(owner, model.weights[bucket], minlength=len(example))
            z = np.bincount(doc, each[number], minlength=words.docs) + model.bias
            p = 1 / (1 + np.exp(-np.clip(z, -40, 40))) if model.trained else np.zeros(words.docs)
            part = batch.slice(words.first, words.docs)
            yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(p)], [f.name for f in rest] + ["score"])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rest) + "score double"
    return map_batches(docs.select(F.col(text).alias("_text"), *(F.col(f"`{f.name}`") for f in rest)), run, schema)


def held_out(ident: str = "doc_id", folds: int = FOLDS) -> Column:
    return F.coalesce(F.crc32(F.col(ident).cast("string").cast("binary")) % folds == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", ident: str = "doc_id", label: str = "toxic", rows: int = FIT_ROWS) -> Model:
    """Fit on at most ``rows`` labelled rows outside the held-out fold."""
    usable = labels.where(F.col(label).isin(0, 1) & F.col(ident).isNotNull() & ~held_out(ident))
    sample = usable.select(F.col(ident).alias("_id"), F.col(label).cast("int").alias("_label"))
    sample = sample.orderBy(F.xxhash64("_id"), "_id", "_label").limit(rows)
    # the sample has at most ``rows`` rows
    texts = docs.join(F.broadcast(sample), F.col(ident) == F.col("_id")).select("_id", F.col(text).alias("_text"), "_label")
    # an id that documents share counts once: of its texts the one with the smallest hash
    texts = texts.groupBy("_id", "_label").agg(F.min_by("_text", F.xxhash64("_text")).alias("_text"))
    return fit(features(texts, "_text", "_label").toArrow())
