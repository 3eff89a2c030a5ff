"""Ranked lexical search with block-max pruning over a segmented index.

``build_index`` cuts the documents into segments of about ``SEGMENT_BYTES`` of text, in
order of doc_id within each. A segment's list for a term is dealt into blocks of
``BLOCK`` postings. A block holds the gaps of its documents and their counts as bytes
of seven bits each, and stands in the index with its first and last document and
its greatest impact: the part of the score that doesn't depend on the query. Sizes of documents,
which impacts need, come from a pass of its own. Every row and term is indexed.

``search`` joins the lists of the query's terms with the items that use them, so that
no query is broadcast and a term's lists meet in tasks by segment. On a segment an
item's blocks cut the documents into ranges in which no block begins or ends. Pointers to blocks
move over the ranges without a look into the blocks (shallow moves), and the sum of
the greatest impacts there bounds every score in the range. Ranges are taken with the
largest bounds first, their blocks decompressed and scored, until the bound of what is
left is below the kth score so far; the rest is never decompressed. Of equal bounds
with the kth score all are looked into, as ties go to the smaller doc_id. At the end
the best k of all segments' are kept, first those of each task.

Nulls: null and wordless texts have no terms, null ids of documents come last among
ties and null item ids are an item. Items of equal id are one item with the terms of
all. Repeated rows of documents are ranked each. A very long text is a segment of its
own. Empty tables and items without terms give no rows. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import among, bitmap, discard, materialize
from .textops import ALNUM, LOWER, buffers, pack, slices, unpack, words

SEGMENT_BYTES = 8 << 20
BLOCK = 128
ITEMS = 256
#: Ranges scored at once, to begin with; doubled each time.
STRIDE = 16

INDEX = "segment bigint, term binary, n int, firsts array<int>, lasts array<int>, most array<bigint>, starts array<int>, bytes binary, ids array<bigint>, sizes array<int>"


def totals(docs: DataFrame) -> tuple[int, int]:
    """N, the documents with a term, and L, all their terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            data, offsets = buffers(part.column("text"))
            n = np.diff(words(LOWER[data], offsets, ALNUM)[2])
            yield pa.RecordBatch.from_arrays([pa.array([int((n > 0).sum())]), pa.array([int(n.sum())])], names=["n", "l"])

    n, terms = docs.select("text").mapInArrow(run, "n bigint, l bigint").agg(F.sum("n"), F.sum("l")).first()
    return n or 0, terms or 0


def impact(tf: np.ndarray, size: np.ndarray, n: int, total: int) -> np.ndarray:
    """The part of a score that is the document's: what a term's weight is multiplied by."""
    m = 100 - 90 + (90 * size * n) // max(total, 1)
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def postings(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms of some texts, then code, document and count of every posting in that order, and the texts' sizes."""
    data, offsets = buffers(column)
    data = LOWER[data]
    starts, ends, first = words(data, offsets, ALNUM)
    sizes = np.diff(first)
    kept = data[ALNUM[data]]  # words only, one after the other
    bounds = np.concatenate(([0], np.cumsum(ends - starts)))
    kind = (pa.large_binary(), np.int64) if len(kept) >= 1 << 31 else (pa.binary(), np.int32)
    flat = pa.Array.from_buffers(kind[0], len(starts), [None, pa.py_buffer(bounds.astype(kind[1])), pa.py_buffer(kept)])
    coded = flat.dictionary_encode()
    keys = coded.indices.to_numpy().astype(np.int64) * len(sizes) + np.repeat(np.arange(len(sizes)), sizes)
    keys, count = np.unique(keys, return_counts=True)
    return coded.dictionary, keys // max(len(sizes), 1), keys % max(len(sizes), 1), count, sizes


def build_index(docs: DataFrame, n: int, total: int, segment_bytes: int = SEGMENT_BYTES, block: int = BLOCK) -> DataFrame:
    """A written table with a row a segment and term, and a row without term for the segment's documents (ids, sizes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        for part in slices(batches, limit=segment_bytes):
            ids = part.column("doc_id")
            part = part.take(pa.compute.sort_indices(ids, null_placement="at_end"))
            segment = (task << 32) + made
            made += 1
            terms, code, doc, count, sizes = postings(part.column("text"))
            own = pa.RecordBatch.from_arrays([
                pa.array([segment], pa.int64()), pa.array([None], pa.binary()), pa.array([len(sizes)], pa.int32()), *[pa.array([None], pa.list_(k)) for k in (pa.int32(), pa.int32(), pa.int64(), pa.int32())],
                pa.array([None], pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(sizes)], pa.int32()), part.column("doc_id")), pa.array([sizes.astype(np.int32)], pa.list_(pa.int32())),
            ], names=[x.split()[0] for x in INDEX.split(", ")])
            yield own
            if not len(code):
                continue
            # First postings of the lists, then of the blocks: a block begins with a list or after a full block.
            lists = np.flatnonzero(np.diff(code, prepend=-1))
            place = np.arange(len(code)) - np.repeat(lists, np.diff(lists, append=len(code)))
            blocks = np.flatnonzero(place % block == 0)
            gaps = np.diff(doc, prepend=0)
            gaps[lists] = doc[lists]  # from the list's start; a block's first gap counts from the last document of the one before
            data, long = pack(np.stack([gaps, count], axis=1).ravel())
            ends = np.cumsum(long)[1::2]
            begin = np.concatenate(([0], ends[:-1]))  # of each posting
            most = np.maximum.reduceat(impact(count, sizes[doc], n, total), blocks)
            lasts = doc[np.append(blocks[1:], len(code)) - 1]
            first_block = np.searchsorted(blocks, lists)
            block_of = np.append(first_block, len(blocks)).astype(np.int32)
            list_begin = np.append(begin[lists], len(data))
            within = begin[blocks] - np.repeat(begin[lists], np.diff(block_of))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(lists), segment), pa.int64()), terms.cast(pa.binary()).take(pa.array(code[lists])), pa.array(np.diff(lists, append=len(code)), pa.int32()),
                *[pa.ListArray.from_arrays(pa.array(block_of), pa.array(x, k)) for x, k in ((doc[blocks], pa.int32()), (lasts, pa.int32()), (most, pa.int64()), (within, pa.int32()))],
                pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(list_begin.astype(np.int32)), pa.py_buffer(data)]),
                *[pa.nulls(len(lists), pa.list_(k)) for k in (pa.int64(), pa.int32())],
            ], names=[x.split()[0] for x in INDEX.split(", ")])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    return materialize(rows.mapInArrow(run, INDEX), "impacts")


def terms_of(items: DataFrame) -> DataFrame:
    """Distinct item_id, term (binary)."""
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = F.regexp_extract_all(low, F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), 0)
    return items.select("item_id", F.explode(F.array_distinct(found)).alias("term")).select("item_id", F.col("term").cast("binary").alias("term")).distinct()


class Lists:
    """The lists of one segment, of the terms that some items ask for. Blocks are decompressed once, when first needed."""

    def __init__(self, rows: pa.Table, sizes: np.ndarray, n: int, total: int):
        self.sizes, self.n, self.total = sizes, n, total
        column = lambda c: rows.column(c).combine_chunks()
        self.firsts, self.lasts, self.most, self.starts = ([x.values.to_numpy() for x in column(c)] for c in ("firsts", "lasts", "most", "starts"))
        self.bytes = [np.frombuffer(x, np.uint8) for x in column("bytes").to_pylist()]
        self.opened: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def block(self, term: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and impacts of a block."""
        if (term, b) not in self.opened:
            starts = self.starts[term]
            values = unpack(self.bytes[term][starts[b] : starts[b + 1] if b + 1 < len(starts) else None])
            docs = np.cumsum(values[::2]) + (int(self.lasts[term][b - 1]) if b else 0)
            self.opened[term, b] = docs, impact(values[1::2], self.sizes[docs], self.n, self.total)
        return self.opened[term, b]


def best(lists: Lists, terms: list[int], weights: list[int], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of the k best, by descending score and then by place in the segment."""
    # Ranges of documents in which no block begins or ends, by their last document. at[t] is the block that term t's pointer
    # stands on in each range, or -1 where the range lies between blocks.
    edges = np.unique(np.concatenate([x for t in terms for x in (lists.lasts[t], lists.firsts[t] - 1)])).astype(np.int64)
    at = []
    bound = np.zeros(len(edges), np.int64)
    for t, w in zip(terms, weights):
        pointer = np.searchsorted(lists.lasts[t], edges)
        live = pointer < len(lists.most[t])
        live[live] = lists.firsts[t][pointer[live]] <= edges[live]
        bound[live] += w * lists.most[t][pointer[live]]
        at.append(np.where(live, pointer, -1))
    order = np.argsort(-bound, kind="stable")
    docs, scores, stride, done = np.zeros(0, np.int64), np.zeros(0, np.int64), STRIDE, 0
    while done < len(order):
        least = scores[k - 1] if len(scores) >= k else 1
        some = order[done : done + stride]
        some = some[bound[some] >= least]
        if not len(some):
            break
        wanted = np.zeros(len(edges), bool)
        wanted[some] = True
        found, parts = [docs], [scores]
        for t, w, pointer in zip(terms, weights, at):
            for b in np.unique(pointer[some]):
                if b >= 0:
                    d, value = lists.block(t, int(b))
                    inside = wanted[np.searchsorted(edges, d)]
                    found.append(d[inside])
                    parts.append(w * value[inside])
        every = np.concatenate(found)
        docs, where = np.unique(every, return_inverse=True)
        scores = np.zeros(len(docs), np.int64)
        np.add.at(scores, where, np.concatenate(parts))
        top = np.lexsort((docs, -scores))[:k]
        docs, scores = docs[top], scores[top]
        done, stride = done + stride, stride * 2
    held = scores > 0
    return docs[held], scores[held]


def weights_of(terms: DataFrame, counts: DataFrame, n: int) -> DataFrame:
    """item_id, term, w for the terms that occur, by the number of documents that hold them."""
    weight = F.floor(1000 * F.log((2.0 * F.lit(n) + 2) / (2.0 * F.col("df") + 1))).cast("long")
    return terms.join(counts, "term").select("item_id", "term", weight.alias("w"))


def search(index: DataFrame, items: DataFrame, n: int, total: int, k: int = 10, items_a_block: int = ITEMS) -> DataFrame:
    """item_id, rank, doc_id, score of each item's k best documents. items: item_id, text."""
    terms = materialize(terms_of(items), "terms")
    lists = index.where(F.col("term").isNotNull())
    wanted = terms.select("term").distinct()
    found = materialize(among(lists, F.col("term"), bitmap(wanted, F.col("term"))).join(wanted, "term", "left_semi"), "lists")
    counts = found.groupBy("term").agg(F.sum("n").alias("df"))
    blocks = max(1, -(-terms.select("item_id").distinct().count() // items_a_block))
    weighted = weights_of(terms, counts, n).withColumn("part", F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int"))
    used = weighted.groupBy("term", "part").agg(F.collect_list(F.struct("item_id", "w")).alias("users"))
    asked = found.join(used, "term").select("segment", "part", "term", "firsts", "lasts", "most", "starts", "bytes", "users")
    sizes = index.where(F.col("term").isNull()).select(F.col("segment").alias("own"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("own_part"), "ids", "sizes")

    id_type = items.schema["item_id"].dataType.simpleString()
    schema = f"item_id {id_type}, doc_id bigint, score bigint"

    def score(_, rows: pa.Table, own: pa.Table) -> pa.Table:
        ids, sizes = own.column("ids").combine_chunks().flatten(), own.column("sizes").combine_chunks().flatten().to_numpy()
        lists = Lists(rows, sizes.astype(np.int64), n, total)
        asking: dict = {}
        for t, users in enumerate(rows.column("users").to_pylist()):
            for u in users:
                if u["w"] > 0:
                    asking.setdefault(u["item_id"], ([], []))
                    asking[u["item_id"]][0].append(t)
                    asking[u["item_id"]][1].append(u["w"])
        out = {item: best(lists, *x, k) for item, x in asking.items()}
        who = [item for item, (docs, _) in out.items() for _ in docs]
        docs, scores = (np.concatenate([x[i] for x in out.values()]) if out else np.zeros(0, np.int64) for i in (0, 1))
        kind = rows.schema.field("users").type.value_type.field("item_id").type
        return pa.Table.from_arrays([pa.array(who, kind), ids.take(pa.array(docs)), pa.array(scores)], names=["item_id", "doc_id", "score"])

    scored = asked.groupBy("segment", "part").cogroup(sizes.groupBy("own", "own_part")).applyInArrow(score, schema)
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    out = materialize(scored.withColumn("rank", rank).where(F.col("rank") <= k), "ranked")
    discard(terms, found)
    return out.select("item_id", "rank", "doc_id", "score")


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of the contract of op13."""
    n, total = totals(docs)
    index = build_index(docs, n, total)
    out = search(index, items, n, total)
    discard(index)
    return out


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS t FROM documents
), c AS (
  SELECT count(*)::BIGINT AS n, sum(len(t))::BIGINT AS l FROM d WHERE len(t) > 0
), p AS (
  SELECT k, any_value(doc_id) AS doc_id, any_value(len(t))::BIGINT AS size, term, count(*)::BIGINT AS tf FROM (SELECT k, doc_id, t, unnest(t) AS term FROM d) GROUP BY k, term
), q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term FROM benchmark
), f AS (
  SELECT term, count(*) AS df FROM p GROUP BY term
), w AS (
  SELECT q.item_id, q.term, floor(1000 * ln((2 * c.n + 2)::DOUBLE / (2 * f.df + 1)))::BIGINT AS w FROM q JOIN f USING (term), c
), s AS (
  SELECT w.item_id, p.k, any_value(p.doc_id) AS doc_id, sum(w.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * (10 + (90 * p.size * c.n) // c.l))))::BIGINT AS score
  FROM w JOIN p USING (term), c GROUP BY w.item_id, p.k
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, k)::INT AS rank, doc_id, score FROM s
WHERE score > 0 QUALIFY rank <= 10
"""
