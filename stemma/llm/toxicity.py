"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashes, in ``2 ** BITS`` buckets, of its words
(letters only, lower-cased, so punctuation glued to a word is no disguise), of
their stems (first ``STEMS`` bytes, so inflected and compound forms share a
weight), of pairs of neighbours, and of pairs with one word between. FTRL-proximal gives every
coordinate its own learning rate and, by its L1 term, leaves most at exactly
zero; what remains is sent to the executors, at most ``2 ** BITS`` pairs.

The model is fitted in one task on at most about ``MAX_ROWS`` labelled texts: those
whose hash is below the bound over the number of labelled rows. Any text is
scored whole, by itself.

Nulls: a null or empty text has the bias alone; rows without label or doc_id are
not learned from. Repeated rows and texts are learned from and scored each. Without any
labelled row every score is 0. An empty table gives an empty result; a very long
text is a slice of its own. Learning takes the rows in order of a hash of their
id, then of id, text and label, so rows that tie are equal. Labels, lang, source and doc_id are no features;
other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textops import LOWER, buffers, chained, slices, word_hashes, words

BITS = 20
STEMS = (4, 5, 6, 7, 8, 9)
MAX_ROWS = 12_000
EPOCHS = 6
ALPHA, BETA, L1, L2 = 1.0, 1.0, 8.0, 1.0

#: Words are runs of letters: A-Z, a-z and all beyond ASCII.
LETTERS = np.zeros(256, bool)
LETTERS[65:91] = LETTERS[97:123] = LETTERS[128:] = True


def features(column: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all texts, with repeats, and each text's first (one more at the end)."""
    data, offsets = buffers(column)
    data = LOWER[data]
    starts, ends, first = words(data, offsets, LETTERS)
    hashes = word_hashes(data, starts, ends)
    n = len(hashes)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    found, owner = [hashes], [text]
    for k in STEMS:
        long = np.flatnonzero(ends - starts > k)
        found.append(word_hashes(data, starts[long], starts[long] + k) + np.uint64(k))
        owner.append(text[long])
    for gap in (1, 2):
        if n > gap:
            same = text[gap:] == text[:-gap]
            found.append(chained([hashes[:-gap][same] + np.uint64(gap), hashes[gap:][same]]))
            owner.append(text[gap:][same])
    owner, found = np.concatenate(owner), np.concatenate(found)
    order = np.argsort(owner, kind="stable")
    return (found[order] >> np.uint64(64 - bits)).astype(np.int64), np.searchsorted(owner[order], np.arange(len(first)))


class Ftrl:
    """Per-coordinate FTRL-proximal; the last coordinate is the bias, free of L1."""

    def __init__(self, size: int, alpha=ALPHA, beta=BETA, l1=L1, l2=L2):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(at == len(self.z) - 1, 0.0, self.l1)
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        rate = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - rate * w
        self.n[at] += g * g


def fit(docs: DataFrame, labels: DataFrame, learned: Column, label: str = "toxic", max_rows: int = MAX_ROWS, epochs: int = EPOCHS, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets with their weights (the bias at 2 ** bits), learned from rows of ``labels`` where ``learned`` holds."""
    marked = labels.where(learned & F.col(label).isNotNull()).select("doc_id", F.col(label).cast("int").alias("label"))
    share = min(1.0, max_rows / max(1, marked.count()))
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("toxicity")), F.lit(1 << 20)) / F.lit(1 << 20)
    sample = docs.select("doc_id", "text").join(marked.where(draw < share), "doc_id").select("doc_id", "text", "label")

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for part in slices(batches):
            found, first = features(part.column("text"), bits)
            for i, label in enumerate(part.column("label").to_pylist()):
                rows.append((np.append(np.unique(found[first[i] : first[i + 1]]), 1 << bits), label))
        model = Ftrl(1 << bits)
        for epoch in range(epochs):
            for i in np.random.default_rng(epoch).permutation(len(rows)):
                model.learn(*rows[i])
        at = np.flatnonzero(model.n)
        w = model.weights(at)
        yield pa.RecordBatch.from_arrays([pa.array(at[w != 0]), pa.array(w[w != 0])], names=["bucket", "weight"])

    table = sample.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "text", "label").mapInArrow(train, "bucket long, weight double").toPandas()
    return table["bucket"].to_numpy(np.int64), table["weight"].to_numpy(np.float64)


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], bits: int = BITS) -> DataFrame:
    """doc_id, score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, w = sent.value
        dense = np.zeros((1 << bits) + 1)
        dense[at] = w
        for part in slices(batches):
            found, first = features(part.column("text"), bits)
            hit = np.flatnonzero(dense[found])
            owner = np.searchsorted(first, hit, "right") - 1
            pairs = np.unique(np.stack([owner, found[hit]], 1), axis=0)
            sums = np.bincount(pairs[:, 0], dense[pairs[:, 1]], part.num_rows) + dense[-1]
            out = 1.0 / (1.0 + np.exp(-np.clip(sums, -35, 35))) if len(at) else np.zeros(part.num_rows)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(out)], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
