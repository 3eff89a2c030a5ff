"""Katz backoff language model of order two, counted on the whole corpus.

Tokens are words and one end a text. Good-Turing discounts (Katz's up to 5, where
the counts of counts allow it, beyond that the log-linear smoothed form, which is
always below 1) free mass for unseen events; the backoff weight of a context is
that mass over the unigram mass of the words not seen after it, so every
distribution adds up to exactly 1 over the training vocabulary and one unknown word. A
token's probability is evaluated recursively: seen pair, else backoff weight
times unigram, else the unknown word's mass. Order two: triples are nearly all
different, and what they add to the messages and tables is more than the pairs do.

The corpus is cut into chunks of about ``CHUNK_BYTES`` of text. A chunk sends its
distinct n-grams with their counts, as sorted packed hashes, to owners, which
are even ranges of the hash; so a frequent word is one entry a chunk, whatever
its number of occurrences, and a frequent context's pairs spread over all owners.
Owners add up the counts, keep their part of the model table (``kind=model``,
by order and owner), and answer each chunk (``kind=reply``); the first chunk of a
pair is told to add it to its context's sums, which are joined the same way. Not
more than a chunk or an owner's range is ever in one task, and nothing but the
counts of counts reaches the driver. The number of owners, and of tasks that serve
them, grows with the corpus; a chunk's messages are as many as the ranges its
n-grams fall into, at most one an n-gram. A text longer than a chunk is a chunk.

Nulls: a null or empty text is one end token. A null doc_id is not learned from.
Repeated rows count and are scored each; an empty table gives an empty result.
Without training rows every token is unknown and has probability 1. Other
columns are not looked at. N-grams are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import discard, materialize
from .textops import GRAPHIC, chained, hashed_words, slices

CHUNK_BYTES = 8 << 20
OWNER_TOKENS = 2_000_000
SEEN_COUNTS = 8
KATZ_K = 5
END, START = np.uint64(0x1F83D9ABFB41BD6B), np.uint64(0x5BE0CD19137E2179)

CHUNK = "chunk long, doc_ids array<bigint>, held array<boolean>, first array<int>, words binary, n_words int, tokens binary, n_tokens long, n_train long, train_docs long"
ASK = "order int, owner int, chunk long, n int, keys binary, counts binary"
MODEL = "kind string, order int, owner int, chunk long, n int, keys binary, counts binary, stats array<bigint>"
SUMS = "owner int, chunk long, n int, keys binary, mass binary, counts binary"
PENDING = "doc_ids array<bigint>, held array<boolean>, n_tokens array<int>, n_known array<int>, base array<double>, part array<double>, asked binary, who binary, n_who int"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def pack(a: np.ndarray, ordered: bool = False) -> bytes:
    """Compressed planes of bytes; of differences if ascending."""
    if ordered:
        a = np.diff(a, prepend=a.dtype.type(0))
    width = a.dtype.itemsize
    return pa.compress(np.ascontiguousarray(a.view(np.uint8).reshape(-1, width).T).tobytes(), codec="zstd", asbytes=True) if len(a) else b""


def unpack(data: bytes, n: int, kind, ordered: bool = False) -> np.ndarray:
    if not n:
        return np.zeros(0, kind)
    width = np.dtype(kind).itemsize
    raw = np.frombuffer(pa.decompress(data, decompressed_size=n * width, codec="zstd", asbytes=True), np.uint8)
    a = np.ascontiguousarray(raw.reshape(width, n).T).reshape(-1).view(kind)
    return np.cumsum(a, dtype=kind) if ordered else a


def table_of(kinds: list[tuple[str, pa.DataType]], rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [()] * len(kinds)
    return pa.table([pa.array(c, k) for c, (_, k) in zip(columns, kinds)], names=[n for n, _ in kinds])


def arrow_kinds(schema: str) -> list[tuple[str, pa.DataType]]:
    one = {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64()}
    out = []
    for x in schema.split(", "):
        name, kind = x.split()
        out.append((name, pa.list_(one[kind[6:-1]]) if kind.startswith("array<") else one[kind]))
    return out


def chunks(docs: DataFrame, held: Column, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The tokenised corpus, one row a chunk: distinct word hashes, ascending, and every token as a number among them."""
    kinds = arrow_kinds(CHUNK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part_no = TaskContext.get().partitionId()
        hashes, sizes, ids, flags, size, number = [], [], [], [], 0, 0

        def row():
            first = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
            words, tokens = np.unique(np.concatenate(hashes), return_inverse=True)
            train = ~np.array(flags, bool)
            n_train = int(np.diff(first)[train].sum())
            return table_of(kinds, [((part_no << 24) + number, ids, flags, first.astype(np.int32), pack(words, True), len(words), pack(tokens.astype(np.uint32)), len(tokens), n_train, int(train.sum()))]).to_batches()[0]

        for part in slices(batches):
            h, first = hashed_words(part.column("text"), GRAPHIC)
            n = np.diff(first)
            hashes.append(np.insert(h, first[1:], END))
            sizes.append(n + 1)
            ids += part.column("doc_id").to_pylist()
            flags += part.column("held").to_pylist()
            size += part.column("text").nbytes
            if size >= chunk_bytes:
                yield row()
                hashes, sizes, ids, flags, size, number = [], [], [], [], 0, number + 1
        if ids:
            yield row()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held"), "text").mapInArrow(run, CHUNK)


class Chunk:
    """A chunk's row, unpacked: t (tokens), words, ctx (the token before, len(words) at a start), train."""

    def __init__(self, row: dict):
        self.words = unpack(row["words"], row["n_words"], np.uint64, True)
        self.t = unpack(row["tokens"], row["n_tokens"], np.uint32).astype(np.int64)
        self.first = np.asarray(row["first"], np.int64)
        self.ctx = np.empty_like(self.t)
        self.ctx[1:] = self.t[:-1]
        self.ctx[self.first[:-1]] = len(self.words)
        self.sizes = np.diff(self.first)
        self.train = np.repeat(~np.asarray(row["held"], bool), self.sizes)
        self.hkeys = np.append(self.words, START)
        self.keys, self.at, self.inv = np.unique(chained([self.hkeys[self.ctx], self.words[self.t]]), return_index=True, return_inverse=True)


def owned(keys: np.ndarray, p: int) -> Iterator[tuple[int, int, int]]:
    """(owner, start, end) of the owners' ranges that ascending keys fall into: as many as there are, whatever p."""
    if len(keys):
        own = (keys >> np.uint64(32)) * np.uint64(p) >> np.uint64(32)
        cut = np.concatenate([[0], np.flatnonzero(own[1:] != own[:-1]) + 1, [len(keys)]])
        yield from zip(own[cut[:-1]].tolist(), cut[:-1].tolist(), cut[1:].tolist())


def spread(df: DataFrame, n: int, *by: str) -> DataFrame:
    """``df`` dealt by the columns into at least as many tasks as there are groups, up to a hundred thousand: a task's input
    then doesn't grow with the corpus."""
    return df.repartition(min(max(n, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), 100_000), *by)


def ask_counts(corpus: DataFrame, p: int) -> DataFrame:
    kinds = arrow_kinds(ASK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {k: v[0] for k, v in batch.slice(i, 1).to_pydict().items()}
                c = Chunk(row)
                ones = np.bincount(c.t[c.train], minlength=len(c.words)).astype(np.uint64)
                twos = np.bincount(c.inv[c.train], minlength=len(c.keys)).astype(np.uint64)
                for order, keys, counts in ((1, c.words, ones), (2, c.keys, twos)):
                    rows = [(order, o, row["chunk"], b - a, pack(keys[a:b], True), pack(counts[a:b])) for o, a, b in owned(keys, p)]
                    yield from table_of(kinds, rows).to_batches()

    return corpus.mapInArrow(run, ASK)


def add_up(asked: DataFrame, p: int) -> DataFrame:
    """The model's tables and the replies; a reply holds twice the count, plus 1 where the chunk is a pair's first."""
    kinds = arrow_kinds(MODEL)

    def run(key: tuple[pa.Scalar, ...], found: pa.Table) -> pa.Table:
        order, owner = key[0].as_py(), key[1].as_py()
        rows = sorted(found.to_pylist(), key=lambda r: r["chunk"])
        keys = [unpack(r["keys"], r["n"], np.uint64, True) for r in rows]
        counts = np.concatenate([unpack(r["counts"], r["n"], np.uint64) for r in rows])
        sizes = [len(k) for k in keys]
        own, back = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.zeros(len(own), np.uint64)
        np.add.at(total, back, counts)
        lead = np.zeros(len(back), np.uint64)
        there = np.flatnonzero(counts > 0)
        _, first = np.unique(back[there], return_index=True)
        lead[there[first]] = 1
        answer = np.split(total[back] * np.uint64(2) + lead, np.cumsum(sizes)[:-1])
        seen = total > 0
        stats = [int(seen.sum()), int(total.sum()), *np.bincount(np.minimum(total[seen], SEEN_COUNTS + 1).astype(np.int64), minlength=SEEN_COUNTS + 2)[1 : SEEN_COUNTS + 1].tolist()]
        out = [("reply", order, owner, r["chunk"], r["n"], None, pack(a), None) for r, a in zip(rows, answer)]
        out.append(("model", order, owner, None, int(seen.sum()), pack(own[seen], True), pack(total[seen]), stats))
        return table_of(kinds, out)

    return spread(asked, p, "order", "owner").groupBy("order", "owner").applyInArrow(run, MODEL)


def discounts(times: list[int]) -> tuple[list[float], float]:
    """From n_1 .. n_8: the factors of counts 1 .. 5, and the exponent e of (1 + 1 / r) ** e for larger ones."""
    some = [(np.log(r), np.log(n)) for r, n in enumerate(times, 1) if n > 0]
    slope = float(np.polyfit(*zip(*some), 1)[0]) if len(some) > 1 else -2.0
    e = min(slope, -1.1) + 1
    smooth = [(1 + 1 / r) ** e for r in range(1, KATZ_K + 1)]
    if all(n > 0 for n in times[: KATZ_K + 1]):
        cut = (KATZ_K + 1) * times[KATZ_K] / times[0]
        turing = [((r + 1) * times[r] / (times[r - 1] * r) - cut) / (1 - cut) if cut < 1 else 0.0 for r in range(1, KATZ_K + 1)]
        if all(0 < d < 1 for d in turing):
            return turing, e
    return smooth, e


class Model:
    """What holds for the whole corpus: n tokens, v words, d documents, discounts by order; unknown: the mass of the unknown word."""

    def __init__(self, n: int, v: int, d: int, times: dict[int, list[int]]):
        self.n, self.v, self.d = n, v, d
        self.factors = {k: discounts(x) for k, x in times.items()}
        self.unknown = 1.0

    def kept(self, counts: np.ndarray, order: int) -> np.ndarray:
        """Discounted counts."""
        low, e = self.factors[order]
        c = counts.astype(np.float64)
        table = np.array([0.0, *low])
        factor = np.where(c <= KATZ_K, table[np.minimum(counts, KATZ_K).astype(np.int64)], (1 + 1 / np.maximum(c, 1)) ** e)
        return c * factor

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, self.kept(counts, 1) / max(self.n, 1), self.unknown)


def look_up(corpus: DataFrame, replies: DataFrame, m: Model, p: int, chunks_: int) -> DataFrame:
    """Of each chunk: its documents with what is known without backoff weights (``pending``), and for contexts the sums over
    the pairs that this chunk leads, with the context's count where its weight is asked for."""
    schema = f"kind string, {SUMS}, {PENDING}"
    kinds = arrow_kinds(schema)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = {k: v[0] for k, v in left.to_pydict().items()}
        c = Chunk(row)
        got = sorted(right.to_pylist(), key=lambda r: (r["order"], r["owner"]))
        both = {k: np.concatenate([unpack(r["counts"], r["n"], np.uint64) for r in got if r["order"] == k]) for k in (1, 2)}
        ones, twos, lead = both[1] >> np.uint64(1), both[2] >> np.uint64(1), (both[2] & np.uint64(1)) > 0
        before = np.append(ones, np.uint64(m.d))
        before[:-1][c.words == END] = 0
        p1 = m.unigram(ones)
        h, w = c.ctx[c.at], c.t[c.at]
        kept = m.kept(twos, 2)
        seen = twos > 0
        with np.errstate(divide="ignore", invalid="ignore"):
            log2 = np.where(seen, np.log10(kept / before[h].astype(np.float64)), np.log10(p1[w]))
        part = np.add.reduceat(log2[c.inv], c.first[:-1])
        base = np.add.reduceat((np.log10(ones + 1.0) - np.log10(m.n + m.v + 1.0))[c.t], c.first[:-1])
        known = np.add.reduceat((ones > 0)[c.t].astype(np.int64), c.first[:-1])
        mine = np.flatnonzero(lead & seen)
        s1 = np.bincount(h[mine], p1[w[mine]], len(c.hkeys))
        s2 = np.bincount(h[mine], kept[mine], len(c.hkeys))
        lone = np.flatnonzero(~seen[c.inv] & (before[c.ctx] > 0))
        need = np.zeros(len(c.hkeys), bool)
        need[c.ctx[lone]] = True
        used = np.flatnonzero(need | (s2 > 0))
        used = used[np.argsort(c.hkeys[used], kind="stable")]
        keys = c.hkeys[used]
        none = [None] * 9
        rows = []
        for o, a, b in owned(keys, p):
            at = used[a:b]
            rows.append(("sums", o, row["chunk"], b - a, pack(keys[a:b], True), pack(np.concatenate([s1[at], s2[at]])), pack(np.where(need[at], before[at], np.uint64(0))), *none))
        # Each unseen token: its document, and its context's place among those asked for, in order of key.
        asked = used[need[used]]
        place = np.zeros(len(c.hkeys), np.int64)
        place[asked] = np.arange(len(asked))
        who = np.concatenate([np.repeat(np.arange(len(c.sizes)), c.sizes)[lone], place[c.ctx[lone]]]).astype(np.uint32)
        rows.append(("pending", None, row["chunk"], len(asked), None, None, None, row["doc_ids"], row["held"], c.sizes, known, base, part, None, pack(who), len(lone)))
        return table_of(kinds, rows)

    return spread(corpus, chunks_, "chunk").groupBy("chunk").cogroup(spread(replies, chunks_, "chunk").groupBy("chunk")).applyInArrow(run, schema)


def weigh(sums: DataFrame, p: int) -> DataFrame:
    """Backoff weights: for each chunk and owner the logarithms it asked for, in order of key."""
    kinds = arrow_kinds("chunk long, owner int, logs array<double>")

    def run(key: tuple[pa.Scalar, ...], found: pa.Table) -> pa.Table:
        rows = sorted(found.to_pylist(), key=lambda r: r["chunk"])
        keys = np.concatenate([unpack(r["keys"], r["n"], np.uint64, True) for r in rows])
        mass = [unpack(r["mass"], 2 * r["n"], np.float64).reshape(2, -1) for r in rows]
        counts = np.concatenate([unpack(r["counts"], r["n"], np.uint64) for r in rows])
        _, back = np.unique(keys, return_inverse=True)
        s1 = np.bincount(back, np.concatenate([x[0] for x in mass]))[back]
        s2 = np.bincount(back, np.concatenate([x[1] for x in mass]))[back]
        left = np.maximum(1 - s2 / np.maximum(counts.astype(np.float64), 1), 1e-12) / np.maximum(1 - s1, 1e-12)
        ends = np.cumsum([r["n"] for r in rows])
        out = []
        for r, b in zip(rows, ends):
            at = np.arange(b - r["n"], b)
            at = at[counts[at] > 0]
            if len(at):
                out.append((r["chunk"], key[0].as_py(), np.log10(left[at])))
        return table_of(kinds, out)

    return spread(sums, p, "owner").groupBy("owner").applyInArrow(run, "chunk long, owner int, logs array<double>")


def finish(pending: DataFrame, weights: DataFrame) -> DataFrame:
    kinds = arrow_kinds(SCORES)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = {k: v[0] for k, v in left.to_pydict().items()}
        got = sorted(right.to_pylist(), key=lambda r: r["owner"])
        logs = np.concatenate([np.asarray(r["logs"]) for r in got]) if got else np.zeros(0)
        who = unpack(row["who"], 2 * row["n_who"], np.uint32).astype(np.int64).reshape(2, -1)
        n = len(row["doc_ids"])
        score = np.asarray(row["part"]) + np.bincount(who[0], logs[who[1]], n)
        columns = [row["doc_ids"], row["held"], row["n_tokens"], row["n_known"], row["base"], score]
        return pa.table([pa.array(x, k) for x, (_, k) in zip(columns, kinds)], names=[k for k, _ in kinds])

    return pending.groupBy("chunk").cogroup(weights.groupBy("chunk")).applyInArrow(run, SCORES)


def model_of(counted: DataFrame, totals) -> Model:
    """The figures of the whole corpus, from one row of statistics an owner."""
    each = counted.where("kind = 'model'").select("order", F.posexplode("stats").alias("i", "x")).groupBy("order", "i").agg(F.sum("x").alias("x")).collect()
    stats = {k: [0] * (SEEN_COUNTS + 2) for k in (1, 2)}
    for r in each:
        stats[r["order"]][r["i"]] = r["x"]
    m = Model(totals["n"] or 0, stats[1][0], totals["d"] or 0, {k: v[2:] for k, v in stats.items()})
    if m.n:
        # What the discounts take from words seen 1 .. 8 times is known exactly; of more frequent ones it is summed below.
        m.unknown = None
    return m


def score(docs: DataFrame, held: Column, chunk_bytes: int = CHUNK_BYTES) -> tuple[DataFrame, DataFrame, Model]:
    """Learns from the rows where ``held`` is false and scores all: (scores, tables of the model, figures)."""
    spark = docs.sparkSession
    corpus = materialize(chunks(docs, held, chunk_bytes), "corpus")
    totals = corpus.agg(F.sum("n_train").alias("n"), F.sum("train_docs").alias("d"), F.sum("n_tokens").alias("all"), F.count("*").alias("chunks")).first()
    p = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(totals["all"] or 0) // OWNER_TOKENS))
    counted = materialize(add_up(ask_counts(corpus, p), p), "ngrams", ["kind", "order"])
    m = model_of(counted, totals)
    if m.unknown is None:
        m.unknown = unknown_mass(counted, m)
    replies = counted.where("kind = 'reply'").select("chunk", "order", "owner", "n", "counts")
    looked = materialize(look_up(corpus, replies, m, p, totals["chunks"]), "contexts")
    discard(corpus)
    sums = looked.where("kind = 'sums'").select(*[x.split()[0] for x in SUMS.split(", ")])
    pending = looked.where("kind = 'pending'").select("chunk", *[x.split()[0] for x in PENDING.split(", ")])
    return finish(pending, weigh(sums, p)), counted.where("kind = 'model'"), m


def unknown_mass(counted: DataFrame, m: Model) -> float:
    """1 less the discounted unigram mass, exactly; discounts beyond 5 depend on the count, so owners add up their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                counts = unpack(r["counts"], r["n"], np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array([r["owner"]], pa.int32()), pa.array([float((counts.astype(np.float64) - m.kept(counts, 1)).sum())])], names=["owner", "freed"])

    rows = counted.where("kind = 'model' and order = 1").select("owner", "n", "counts").mapInArrow(run, "owner int, freed double")
    return float(rows.agg(F.sum("freed")).first()[0]) / m.n
