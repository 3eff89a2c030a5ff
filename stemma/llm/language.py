"""Language identification by rank-order profiles.

A profile lists the ``SIZE`` most frequent character n-grams (n = 1 to 3, over
lower-cased letters, anything else being one blank) in order of rank. A document
is given the language from which its own profile is least out of place: the sum,
over its n-grams, of the distance between the ranks in both profiles, ``SIZE``
where the language lacks the n-gram.

Profiles are counted on at most about ``PER_LANGUAGE`` documents a language: those
whose hash is below the bound over the language's count, so a language with
fewer is used whole. All texts are judged whole, each by itself.

Nulls: a null or letterless text is ``und`` with score 0, as is any text if no
language could be learned. Rows without language or doc_id are not learned from.
Ties go to the smaller n-gram and the first language by code point. Repeated
rows count and are judged each. Other columns are not looked at. An empty table
gives an empty result; a very long text is a slice of its own.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textops import slices

SIZE = 400
PER_LANGUAGE = 1500
LEAST = 0.25
_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.frombuffer(bytes(chr(i).isalpha() for i in range(sys.maxunicode + 1)), np.uint8).astype(bool))
    return _LETTER[0]


def gram_codes(text: str) -> np.ndarray:
    """Codes of all n-grams of the text, with repeats; none if it has no letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    inside = _letters()[points]
    if not inside.any():
        return np.zeros(0, np.int64)
    padded = np.full(len(points) + 2, 32, np.int64)
    padded[1:-1] = np.where(inside, points, 32)
    keep = np.ones(len(padded), bool)
    keep[1:] = (padded[1:] != 32) | (padded[:-1] != 32)
    c = padded[keep]
    two = (c[:-1] << 21) | c[1:]
    three = (two[:-1] << 21) | c[2:]
    return np.concatenate((c[c != 32], two, three))


def profile(codes: np.ndarray, weights: np.ndarray | None = None, size: int = SIZE) -> np.ndarray:
    """The most frequent codes, by rank."""
    if weights is None:
        codes, weights = np.unique(codes, return_counts=True)
    if len(codes) > size:
        least = np.partition(weights, len(weights) - size)[len(weights) - size]
        kept = weights >= least
        codes, weights = codes[kept], weights[kept]
    return codes[np.lexsort((codes, -weights))][:size]


def fit(docs: DataFrame, learned: Column, per_language: int = PER_LANGUAGE, size: int = SIZE) -> dict[str, list[int]]:
    """Profiles by language of the rows where ``learned`` holds, from a bounded sample counted in one task."""
    rows = docs.where(learned & F.col("lang").isNotNull())
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    shares = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, per_language / n))])
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("language")), F.lit(1 << 20)) / F.lit(1 << 20)
    sample = rows.where(draw < shares[F.col("lang")]).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        for part in slices(batches):
            for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist()):
                mine = held.setdefault(lang, [])
                mine.append(np.unique(gram_codes(text or ""), return_counts=True))
                if len(mine) > 200:
                    mine[:] = [_merged(mine)]
        for lang in sorted(held):
            codes, n = _merged(held[lang])
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([profile(codes, n, size).tolist()], pa.list_(pa.int64()))], names=["lang", "codes"])

    found = sample.repartition(1).mapInArrow(count, "lang string, codes array<bigint>").collect()
    return {r["lang"]: list(r["codes"]) for r in sorted(found, key=lambda r: r["lang"]) if r["codes"]}


def _merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
    codes, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return codes, np.bincount(back, np.concatenate([p[1] for p in parts]), len(codes)).astype(np.int64)


class Judge:
    """Out-of-place distances to all profiles at once."""

    def __init__(self, profiles: dict[str, list[int]], size: int = SIZE):
        self.names, self.size = sorted(profiles), size
        self.known = np.unique(np.concatenate([np.array(profiles[k]) for k in self.names])) if profiles else np.zeros(0, np.int64)
        self.ranks = np.full((len(self.known), len(self.names)), -1, np.int64)
        for j, k in enumerate(self.names):
            self.ranks[np.searchsorted(self.known, profiles[k]), j] = np.arange(len(profiles[k]))

    def __call__(self, text: str | None) -> tuple[str, float]:
        codes = gram_codes(text or "")
        if not len(codes) or not self.names:
            return "und", 0.0
        mine = profile(codes, size=self.size)
        at = np.minimum(np.searchsorted(self.known, mine), len(self.known) - 1)
        hit = self.known[at] == mine
        theirs = self.ranks[at[hit]]
        apart = np.where(theirs < 0, self.size, np.abs(theirs - np.flatnonzero(hit)[:, None]))
        total = apart.sum(0) + self.size * int((~hit).sum())
        best = int(np.argmin(total))
        return self.names[best], 1.0 - float(total[best]) / (self.size * len(mine))


def judged(batches: Iterator[pa.RecordBatch], judge: Judge) -> Iterator[tuple[pa.RecordBatch, list]]:
    for part in slices(batches):
        yield part, [judge(x) for x in part.column("text").to_pylist()]


def identify(docs: DataFrame, profiles: dict[str, list[int]], size: int = SIZE) -> DataFrame:
    """doc_id, lang_pred, score (1 less the share of the largest distance) of every text."""

    def run(batches):
        judge = Judge(profiles, size)
        for part, found in judged(batches, judge):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, profiles: dict[str, list[int]], wanted: list[str] | None = None, least: float = LEAST, size: int = SIZE) -> DataFrame:
    """Rows of ``docs`` whose predicted language is among ``wanted`` (any learned one if None) and whose score is at least ``least``.

    A row keeps its columns; where there is a text column ``lang``, it becomes the prediction.
    """
    place = next((i for i, f in enumerate(docs.schema) if f.name == "lang" and isinstance(f.dataType, T.StringType)), None)

    def run(batches):
        judge = Judge(profiles, size)
        for part, found in judged(batches, judge):
            keep = pa.array([x[0] != "und" and x[1] >= least and (wanted is None or x[0] in wanted) for x in found], pa.bool_())
            if place is not None:
                part = part.set_column(place, part.schema.field(place), pa.array([x[0] for x in found], part.schema.field(place).type))
            yield part.filter(keep)

    return docs.mapInArrow(run, docs.schema)
