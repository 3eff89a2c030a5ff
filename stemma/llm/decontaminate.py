"""Benchmark decontamination with a distributed positional inverted index.

``build_index`` cuts the table into segments of about ``SEGMENT_BYTES`` of text.
A segment holds, for its documents, the sorted terms and for each term the
ascending list of positions (documents one after the other, a gap between), so
every list is bounded by the segment and a frequent term burdens no single task.
Segments with the postings of all terms are written to the shared folder, in row
groups of a few segments, so that a task holds few at a time however many it has; an
index for known queries only may leave out other terms (``terms``).

``search`` answers phrases on each segment: beginning with its rarest term, a
phrase's lists are moved by the terms' offsets and intersected, so what is left
are exact starts. With ``slop`` above 0 every term may stand up to that many
words from its place: a proximity match.

The benchmark's windows are a written table, dealt into blocks of about
``BLOCK_WINDOWS`` (window, item) rows, however many there are. One block at a time
goes out as a broadcast of bounded size and makes one pass over the index; only
documents with hits come out of a pass and are joined.

Nulls: a null or wordless text has no words and no hits, a null or wordless item
no windows. An item without item_id still marks words but is not listed. Items
with equal windows are each listed; repeated rows of documents are judged each.
Other columns are not looked at. No documents give no rows, no items no hits. A
very long text is a segment of its own. Of equally rare terms the first leads.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import WIDE, discard, identity, materialize, without
from .textops import ALNUM, hashed_words, slices

WINDOW = 13
SEGMENT_BYTES = 4 << 20
BLOCK_WINDOWS = 200_000
GAP = 64

INDEX = "doc_ids array<bigint>, marks array<bigint>, sizes array<int>, bounds array<int>, terms array<bigint>, lists array<int>, positions array<int>"


def build_index(docs: DataFrame, terms: np.ndarray | None = None, segment_bytes: int = SEGMENT_BYTES, window: int = WINDOW) -> DataFrame:
    """One row a segment. marks: a hash of each text, to tell rows of equal doc_id apart.

    bounds are the documents' first positions, lists the first place of each
    term in positions (one more at the end). terms: the sorted hashes to keep.
    """
    gap = max(GAP, 2 * window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, limit=segment_bytes):
            hashes, first = hashed_words(part.column("text"), ALNUM)
            sizes = np.diff(first)
            bounds = first[:-1] + gap * np.arange(len(sizes))
            place = np.arange(len(hashes)) + np.repeat(gap * np.arange(len(sizes)), sizes)
            if terms is not None:
                at = np.minimum(np.searchsorted(terms, hashes), max(len(terms) - 1, 0))
                kept = terms[at] == hashes if len(terms) else np.zeros(len(hashes), bool)
                hashes, place = hashes[kept], place[kept]
            order = np.argsort(hashes, kind="stable")
            own, lists = np.unique(hashes[order], return_index=True)
            row = [part.column("doc_id").to_pylist(), part.column("mark").to_pylist(), sizes.astype(np.int32), bounds.astype(np.int32), own.view(np.int64), np.append(lists, len(order)).astype(np.int32), place[order].astype(np.int32)]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.list_(k)) for x, k in zip(row, kinds)], names=[x.split()[0] for x in INDEX.split(", ")])

    rows = docs.select(*identity(docs), docs["text"].alias("text"))
    return materialize(rows.mapInArrow(run, INDEX), "postings", options=WIDE)


class Phrases:
    """Distinct phrases as rows of term hashes, and the items that hold each."""

    def __init__(self, phrases: list[np.ndarray], items: list[list[str]]):
        self.items = items
        self.sizes = np.array([len(p) for p in phrases], np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.terms = np.concatenate(phrases) if phrases else np.zeros(0, np.uint64)


def windows_of(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The distinct (item_id, phrase) rows of the benchmark, a phrase being packed term hashes, as a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            hashes, first = hashed_words(part.column("text"), ALNUM)
            for item, a, b in zip(part.column("item_id").to_pylist(), first[:-1].tolist(), first[1:].tolist()):
                found = {hashes[i : min(i + window, b)].tobytes() for i in range(a, max(a + 1, b - window + 1))} if b > a else set()
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([item] * len(found), pa.string()), pa.array(sorted(found), pa.binary())], names=["item_id", "phrase"])

    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").mapInArrow(run, "item_id string, phrase binary")
    return materialize(rows.distinct(), "windows")


def blocks_of(windows: DataFrame) -> Iterator[tuple[list[bytes], list[list[str]]]]:
    """(phrases, their items) of one block after the other; a block's size is bounded, whatever the benchmark's."""
    n = -(-windows.count() // BLOCK_WINDOWS)
    for i in range(n):
        held: dict[bytes, list[str]] = {}
        for row in windows.where(F.pmod(F.xxhash64("phrase", "item_id"), F.lit(n)) == i).collect():
            items = held.setdefault(bytes(row["phrase"]), [])
            if row["item_id"] is not None:
                items.append(row["item_id"])
        yield list(held), list(held.values())


def find_starts(seg: dict, q: Phrases, slop: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(phrase, start position) of all matches in a segment."""
    own, lists, positions = seg["terms"].view(np.uint64), seg["lists"], seg["positions"]
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(own) or not len(q.sizes):
        return none
    at = np.minimum(np.searchsorted(own, q.terms), len(own) - 1)
    known = own[at] == q.terms
    long = np.where(known, lists[at + 1] - lists[at], 0).astype(np.int64)
    alive = np.flatnonzero(np.minimum.reduceat(long, q.first) > 0)
    if not len(alive):
        return none
    # The terms of each phrase that is left, rarest first.
    widest = int(q.sizes[alive].max())
    cell = q.first[alive][:, None] + np.minimum(np.arange(widest), q.sizes[alive][:, None] - 1)
    rank = np.argsort(np.where(np.arange(widest) < q.sizes[alive][:, None], long[cell], np.iinfo(np.int64).max), axis=1, kind="stable")
    top = q.first[alive] + rank[:, 0]
    out_p, out_s = [], []
    for lo, hi in _blocks(long[top], 2_000_000):
        mine = np.arange(lo, hi)
        n = long[top[lo:hi]]
        who = np.repeat(mine, n)
        inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        start = positions[np.repeat(lists[at[top[lo:hi]]], n) + inner].astype(np.int64) - np.repeat(rank[lo:hi, 0], n)
        if slop:
            start = (start[:, None] + np.arange(-slop, slop + 1)).ravel()
            who = np.repeat(who, 2 * slop + 1)
        for k in range(0 if slop else 1, widest):
            if not len(who):
                break
            use = k < q.sizes[alive[who]]
            offset = rank[who, k]
            term = at[q.first[alive[who]] + np.minimum(offset, q.sizes[alive[who]] - 1)]
            keep = ~use
            for d in range(-slop, slop + 1):
                keep |= _listed(positions, lists, term, start + offset + d)
            start, who = start[keep], who[keep]
        if slop and len(who):  # one start may be near through several places of the rarest term
            who, start = np.unique(np.stack([who, start]), axis=1)
        out_p.append(alive[who])
        out_s.append(start)
    return np.concatenate(out_p), np.concatenate(out_s)


def _blocks(sizes: np.ndarray, limit: int):
    """Ranges whose sizes add up to about ``limit``."""
    total, lo = np.cumsum(sizes), 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + limit, "right")))
        yield lo, hi
        lo = hi


def _listed(positions: np.ndarray, lists: np.ndarray, term: np.ndarray, where: np.ndarray) -> np.ndarray:
    """Is ``where`` in the term's list? One binary search for all: keys of (term, position) are ascending."""
    lo, hi = lists[term].astype(np.int64), lists[term + 1].astype(np.int64)
    end = hi.copy()
    while (open_ := lo < hi).any():
        middle = (lo + hi) >> 1
        less = positions[np.minimum(middle, len(positions) - 1)] < where
        lo = np.where(open_ & less, middle + 1, lo)
        hi = np.where(open_ & ~less, middle, hi)
    return (lo < end) & (positions[np.minimum(lo, len(positions) - 1)] == where)


FOUND = "doc_id long, mark long, n_words long, hits array<int>, items array<string>, starts array<int>"


def search(index: DataFrame, block: tuple[list[bytes], list[list[str]]], slop: int = 0) -> DataFrame:
    """For every document with a match: n_words, the words in matches (hits, as word numbers), the items of the phrases, and
    for each item the number of its windows' starts."""
    sent = index.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases, listed = sent.value
        q = Phrases([np.frombuffer(p, np.uint64) for p in phrases], listed)
        for batch in batches:
            for i in range(batch.num_rows):
                seg = {c: batch.column(c)[i].values for c in batch.schema.names}
                ids, marks = seg["doc_ids"], seg["marks"]
                seg = {c: seg[c].to_numpy(zero_copy_only=False) for c in ("sizes", "bounds", "terms", "lists", "positions")}
                phrase, start = find_starts(seg, q, slop)
                doc = np.searchsorted(seg["bounds"], start + slop, "right") - 1  # a near start may lie before its text
                order = np.argsort(doc, kind="stable")
                found, first = np.unique(doc[order], return_index=True)
                rows: list = [[], [], [], []]
                for d, a, b in zip(found.tolist(), first.tolist(), [*first[1:].tolist(), len(order)]):
                    own = order[a:b]
                    size = int(seg["sizes"][d])
                    step = np.zeros(size + 1, np.int64)
                    np.add.at(step, np.clip(start[own] - seg["bounds"][d], 0, size), 1)
                    np.add.at(step, np.clip(start[own] - seg["bounds"][d] + q.sizes[phrase[own]], 0, size), -1)
                    times: dict[str, int] = {}
                    for p, n in zip(*(x.tolist() for x in np.unique(phrase[own], return_counts=True))):
                        for item in q.items[p]:
                            times[item] = times.get(item, 0) + n
                    names = sorted(times)
                    for column, x in zip(rows, (size, np.flatnonzero(np.cumsum(step)[:size] > 0).astype(np.int32), names, [times[x] for x in names])):
                        column.append(x)
                if len(found):
                    kinds = [pa.int64(), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.int32())]
                    columns = [ids.take(pa.array(found)), marks.take(pa.array(found)), *[pa.array(x, k) for x, k in zip(rows, kinds)]]
                    yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in FOUND.split(", ")])

    return index.mapInArrow(run, FOUND)


def passes(docs: DataFrame, benchmark: DataFrame, window: int, slop: int, segment_bytes: int) -> tuple[DataFrame, list[DataFrame]]:
    """The index, and what each block of windows finds in it, all written."""
    windows = windows_of(benchmark, window)
    index = build_index(docs, None, segment_bytes, window)
    found = [materialize(search(index, b, slop), "hits") for b in blocks_of(windows)] or [materialize(index.sparkSession.createDataFrame([], FOUND), "hits")]
    discard(windows)
    return index, found


def overlap(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = 0, segment_bytes: int = SEGMENT_BYTES) -> tuple[DataFrame, DataFrame]:
    """(doc_id, mark, n_words of every row of ``docs``; doc_id, mark, n_words, n_hit, items of those with hits, once each)."""
    index, found = passes(docs, benchmark, window, slop, segment_bytes)
    # Repeated rows give equal sets of hits; a document has one set a block of windows at most.
    hits = reduce(DataFrame.unionByName, found).groupBy("doc_id", "mark", "n_words").agg(
        F.size(F.array_distinct(F.flatten(F.collect_set("hits")))).cast("long").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items")
    )
    sizes = index.select(F.explode(F.arrays_zip("doc_ids", "marks", "sizes")).alias("x")).select(F.col("x.doc_ids").alias("doc_id"), F.col("x.marks").alias("mark"), F.col("x.sizes").cast("long").alias("n_words"))
    out = materialize(sizes, "sizes"), materialize(hits, "found")
    discard(index, *found)
    return out


def matches(docs: DataFrame, benchmark: DataFrame, slop: int = 0, window: int = WINDOW, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """doc_id, item_id, starts: how many places begin a window of the item, each of its words at most ``slop`` words from its
    place. Repeated rows count each."""
    index, found = passes(docs, benchmark, window, slop, segment_bytes)
    discard(index)
    rows = reduce(DataFrame.unionByName, found).select("doc_id", F.explode(F.arrays_zip("items", "starts")).alias("x")).select("doc_id", F.col("x.items").alias("item_id"), F.col("x.starts").alias("n"))
    return rows.groupBy("doc_id", "item_id").agg(F.sum("n").alias("starts"))


def contaminated(n_hit="n_hit", n_words="n_words"):
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The digest columns of the contract of op6."""
    sizes, hits = overlap(docs, benchmark)
    hits = hits.select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark"), "n_hit", "items")
    found = sizes.join(hits, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("mark") == F.col("__mark")), "left")
    found = found.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), contaminated().alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of ``docs``, unchanged, that are not contaminated. Only rows that a bounded bitmap of those that go lets through
    meet them in a join, so texts are not shuffled."""
    return without(docs, overlap(docs, benchmark)[1].where(contaminated()))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS k,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents
), b AS (
  SELECT item_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS phrase
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), dw AS (
  SELECT k, i, n, array_to_string(w[i : i + n - 1], ' ') AS phrase
  FROM (SELECT k, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)
), m AS (
  SELECT dw.k, dw.i, dw.n, bw.item_id FROM dw JOIN bw USING (n, phrase)
), hit AS (
  SELECT k, count(DISTINCT j) AS n_hit FROM (SELECT k, unnest(range(i, i + n)) AS j FROM m) GROUP BY k
), item AS (
  SELECT k, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT k, item_id::VARCHAR AS id FROM m WHERE item_id IS NOT NULL) GROUP BY k
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hit USING (k) LEFT JOIN item USING (k)
"""
