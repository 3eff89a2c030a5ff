"""Byte-level BPE encoding and decoding by Spark's higher-order functions.

A text is split by the pattern of the vocabulary. The pieces of about ``BLOCK_BYTES``
of texts make a block: its distinct pieces, and for every piece of its texts the
number of that distinct one. Distinct pieces are encoded, not their occurrences: a
piece's bytes are the parts to begin with, and an ``aggregate`` folds over them, at
each step joining the leftmost neighbours whose bytes have the lowest rank, until
none have one. Ranks come from a literal: an array of small maps by checksum, as
Spark looks a key up in a map by going through it.

The pieces that the most blocks hold, at most ``SHARED``, are encoded once and
broadcast; those that a block holds besides, seldom found elsewhere, are encoded in
the block. Only distinct pieces are ever shuffled, to be counted; ids and texts stay
where they are, so a frequent piece burdens no task. Decoding concatenates the ids'
pieces.

Pieces of more than ``LONG`` bytes (base64, unbroken scripts) don't enter the fold,
which takes time in proportion to the square of a piece's length; a heap of pairs
encodes them to the same ids.

Nulls: a null text is empty, and an empty text has no ids. Very long texts are a
block of their own, handled whole. Of equal ranks the leftmost pair is joined first.
Repeated rows are encoded each. An empty table gives an empty result. Other columns
are not looked at, whatever their names. Null ids, and ids that the vocabulary
doesn't have, decode to nothing; a null list of ids decodes to an empty text.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .shared import discard, materialize
from .textops import pack, unpack


BLOCK_BYTES = 16 << 20
LONG = 256
#: The most pieces that are broadcast: at most 2^18 pieces of at most ``LONG`` bytes each, whatever the input.
SHARED = 1 << 18
WORDS_A_TASK = 5_000
BUCKETS = 1 << 14
NONE = 1 << 30
PLACE_BITS = 9

#: Letters and numbers of Unicode 14 to 16, which a JVM of an earlier version takes for unassigned.
NEWER_LETTERS = (
    "870-887 889-88E 8B5 8C8-8C9 C5D CDD 170D 171F 1B4C 1C89-1C8A 2C2F 2C5F 9FFD-9FFF A7C0-A7C1 A7CB-A7CD A7D0-A7D1 A7D3 A7D5-A7DC A7F2-A7F4 "
    "10570-1057A 1057C-1058A 1058C-10592 10594-10595 10597-105A1 105A3-105B1 105B3-105B9 105BB-105BC 105C0-105F3 10780-10785 10787-107B0 "
    "107B2-107BA 10D4A-10D65 10D6F-10D85 10EC2-10EC4 10F70-10F81 11071-11072 11075 1123F-11240 11380-11389 1138B 1138E 11390-113B5 113B7 113D1 "
    "113D3 11740-11746 11AB0-11ABF 11BC0-11BE0 11F02 11F04-11F10 11F12-11F33 12F90-12FF0 1342F 13441-13446 13460-143FA 16100-1611D 16A70-16ABE "
    "16D40-16D6C 18CFF 1AFF0-1AFF3 1AFF5-1AFFB 1AFFD-1AFFE 1B11F-1B122 1B132 1B155 1DF00-1DF1E 1DF25-1DF2A 1E030-1E06D 1E290-1E2AD 1E4D0-1E4EB "
    "1E5D0-1E5ED 1E5F0 1E7E0-1E7E6 1E7E8-1E7EB 1E7ED-1E7EE 1E7F0-1E7FE 2A6DE-2A6DF 2B735-2B739 2EBF0-2EE5D 31350-323AF"
)
NEWER_NUMBERS = "10D40-10D49 116D0-116E3 11BF0-11BF9 11F50-11F59 16130-16139 16AC0-16AC9 16D70-16D79 1CCF0-1CCF9 1D2C0-1D2D3 1E4F0-1E4F9 1E5F1-1E5FA"


def java_pattern(pattern: str) -> str:
    r"""``pattern`` for the JVM: \s as in Unicode, and \p{L} and \p{N} with what newer versions of Unicode add."""

    def ranges(text: str) -> str:
        return "".join("-".join(f"\\x{{{x}}}" for x in part.split("-")) for part in text.split())

    # The outer range keeps ASCII from being held against every newer range.
    letters, numbers = (f"\\p{{{k}}}[\\x{{870}}-\\x{{323AF}}&&[{ranges(v)}]]" for k, v in (("L", NEWER_LETTERS), ("N", NEWER_NUMBERS)))
    own = pattern.replace("[^\\s\\p{L}\\p{N}]", f"[^\\s{letters}{numbers}]").replace(" ?\\p{L}", f" ?[{letters}]").replace(" ?\\p{N}", f" ?[{numbers}]")
    return "(?U)" + own


class Vocabulary:
    """Ranks by bytes, and the literal that holds them."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, pattern

    @classmethod
    def read(cls, lines: bytes, pattern: str) -> Vocabulary:
        """From the contents of a rank file: a piece in base64 and its rank on every line."""
        return cls({base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines.splitlines())}, pattern)

    def rank_map(self) -> Column:
        """array<map<piece, rank>>, a literal once constants are folded. A piece's bytes are the characters of a string."""
        buckets: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
        for piece, rank in self.ranks.items():
            name = piece.decode("latin-1")
            buckets[zlib.crc32(name.encode()) % BUCKETS][name] = rank
        return F.from_json(F.lit(json.dumps(buckets)), "array<map<string,int>>")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def rank_of(ranks: Column, piece: Column) -> Column:
    return F.coalesce(ranks[F.crc32(piece.cast("binary")).bitwiseAND(F.lit(BUCKETS - 1))][piece], F.lit(NONE))


def fold(piece: Column, ranks: Column) -> Column:
    """The ids of a piece, whose bytes are the characters of a string, by merges in order of rank.

    The state is a list of long values, one a part: the rank of the part joined with the next one, then where the part begins,
    where it ends and where the next one ends (the last part has no next one). Its least value is the leftmost pair of lowest rank.
    """
    digits = 1 << PLACE_BITS
    begin = lambda x: F.shiftright(x, 2 * PLACE_BITS).bitwiseAND(F.lit(digits - 1))
    middle = lambda x: F.shiftright(x, PLACE_BITS).bitwiseAND(F.lit(digits - 1))
    end = lambda x: x.bitwiseAND(F.lit(digits - 1))

    def part(a: Column, b: Column, c: Column) -> Column:
        rank = F.when(b == c, F.lit(NONE).cast("long")).otherwise(rank_of(ranks, F.substr(piece, a.cast("int") + 1, (c - a).cast("int"))).cast("long"))
        return rank * digits**3 + a * digits**2 + b * digits + c

    def merged(state: Column, low: Column) -> Column:
        gone = F.lit(-1).cast("long")
        # Compared where they stand, without shifts, as this is done for every part at every step.
        begins, middles = F.lit((digits - 1) * digits**2).cast("long"), F.lit((digits - 1) * digits).cast("long")
        joined = lambda next_, own: F.transform(state, lambda x, i: F.when(x == low, part(begin(low), end(low), end(F.get(state, i + 1)))).when(x.bitwiseAND(begins) == next_, gone).when(x.bitwiseAND(middles) == own, part(begin(x), begin(low), end(low))).otherwise(x))
        return F.array_remove(let(F.shiftleft(middle(low), 2 * PLACE_BITS), lambda next_: let(F.shiftleft(begin(low), PLACE_BITS), lambda own: joined(next_, own))), gone)

    def step(state: Column, _: Column) -> Column:
        return let(F.array_min(state), lambda low: F.when(low >= NONE * digits**3, state).otherwise(merged(state, low)))

    n = F.length(piece)
    parts = F.transform(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1), lambda i: part(i, i + 1, F.least(i + 2, n.cast("long"))))
    folded = F.aggregate(F.sequence(F.lit(2), n), parts, step, lambda s: F.transform(s, lambda x: rank_of(ranks, F.substr(piece, begin(x).cast("int") + 1, (middle(x) - begin(x)).cast("int")))))
    return let(rank_of(ranks, piece), lambda whole: F.when((whole < NONE) | (n < 2), F.array(whole)).otherwise(folded))


def heap_merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a long piece: the same merges, with a heap of the pairs that have a rank."""
    ends = list(range(1, len(piece) + 1))  # of the part that begins here; 0 where none does any more
    before = list(range(-1, len(piece) - 1))
    heap: list[tuple[int, int, int, int]] = []

    def offer(a: int) -> None:
        b = ends[a]
        if a >= 0 and b < len(piece):
            rank = ranks.get(piece[a : ends[b]])
            if rank is not None:
                heapq.heappush(heap, (rank, a, b, ends[b]))

    for a in range(len(piece) - 1):
        offer(a)
    while heap:
        _, a, b, c = heapq.heappop(heap)
        if ends[a] != b or ends[b] != c:  # one of the parts has been joined since
            continue
        ends[a], ends[b] = c, 0
        if c < len(piece):
            before[c] = a
            offer(a)
        if before[a] >= 0:
            offer(before[a])
    out, a = [], 0
    while a < len(piece):
        out.append(ranks[piece[a : ends[a]]])
        a = ends[a]
    return out


def ranges(bounds: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` pieces or bytes each, from where they begin and end."""
    at = 0
    while at < len(bounds) - 1:
        upto = min(max(int(np.searchsorted(bounds, bounds[at] + most, "right")) - 1, at + 1), len(bounds) - 1)
        yield at, upto
        at = upto


BLOCK = "doc_ids array<bigint>, ends array<int>, numbers binary, words array<string>"


def blocks_of(docs: DataFrame, pattern: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A written table of blocks. Words are distinct pieces whose characters are the pieces' bytes, frequent ones first; numbers
    are those of the texts' pieces, packed, and ends the places in them where texts end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def block() -> pa.RecordBatch:
            found = pa.Table.from_batches(held).combine_chunks()
            pieces = found.column("pieces").combine_chunks()
            flat = pieces.flatten().dictionary_encode()
            order = np.argsort(-np.bincount(flat.indices.to_numpy(), minlength=len(flat.dictionary)), kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            words = pa.array([w.decode("latin-1") for w in flat.dictionary.take(pa.array(order)).cast(pa.binary()).to_pylist()], pa.string())
            bounds = pieces.offsets.to_numpy().astype(np.int64)
            bounds -= bounds[0]
            packed, ends, done = [], [], 0
            for a, b in ranges(bounds):
                data, sizes = pack(rank[flat.indices.to_numpy()[bounds[a] : bounds[b]]])
                ends.append(done + np.concatenate(([0], np.cumsum(sizes)))[bounds[a + 1 : b + 1] - bounds[a]])
                packed.append(data.tobytes())
                done += len(data)
            columns = [pa.ListArray.from_arrays(pa.array([0, found.num_rows], pa.int32()), found.column("doc_id").combine_chunks()), pa.array([np.concatenate(ends)], pa.list_(pa.int32())), pa.array([b"".join(packed)], pa.binary())]
            return pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)], names=[x.split()[0] for x in BLOCK.split(", ")])

        for batch in batches:
            lists = batch.column(1)
            if not len(lists) or not len(lists.values):
                held.append(batch)
                continue
            text = lists.values
            bytes_to = np.frombuffer(text.buffers()[1], np.int32)[text.offset + lists.offsets.to_numpy()]
            for a, b in ranges(bytes_to.astype(np.int64), block_bytes):
                n = int(bytes_to[b] - bytes_to[a])
                if held and size + n > block_bytes:
                    yield block()
                    held, size = [], 0
                held.append(batch.slice(a, b - a))
                size += n
        if held:
            yield block()
        held.clear()
        pa.default_memory_pool().release_unused()

    pieces = F.regexp_extract_all(F.coalesce(docs["text"], F.lit("")), F.lit(java_pattern(pattern)), 0)
    return materialize(docs.select(docs["doc_id"].cast("long").alias("doc_id"), pieces.alias("pieces")).mapInArrow(run, BLOCK), "blocks")


def shared_words(blocks: DataFrame, vocabulary: Vocabulary, most: int = SHARED) -> pa.Table:
    """word, ids of at most ``most`` short words: those that the most blocks hold, and at least two."""
    counted = blocks.select(F.explode("words").alias("word")).where(F.length("word") <= LONG).groupBy("word").agg(F.count("*").alias("n")).where("n > 1")
    counted = materialize(counted.withColumn("class", F.floor(F.log2("n") * 16).cast("int")), "words")
    room, least = most, None
    for r in sorted(counted.groupBy("class").count().collect(), key=lambda r: -r["class"]):  # some hundred classes
        room -= r["count"]
        if room < 0:
            break
        least = r["class"]
    held = counted.where(F.lit(False) if least is None else F.col("class") >= least).select("word")
    # Dealt out anew, as the few bytes of the words say little of the time they take.
    dealt = held.repartition(max(1, held.count() // WORDS_A_TASK))
    out = materialize(dealt.select("word", let(vocabulary.rank_map(), lambda literal: fold(F.col("word"), literal)).alias("ids")), "shared")
    found = out.toArrow()
    discard(counted, out)
    return found


def ragged(parts: list[pa.Array]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values, first places and lengths of several arrays of lists, one after the other."""
    values, first, long, at = [], [], [], 0
    for x in parts:
        offsets = x.offsets.to_numpy().astype(np.int64)
        own = x.values.to_numpy()[offsets[0] : offsets[-1]] if len(x) else np.zeros(0, np.int32)
        values.append(own)
        first.append(offsets[:-1] - offsets[0] + at if len(x) else np.zeros(0, np.int64))
        long.append(np.diff(offsets))
        at += len(own)
    return np.concatenate(values), np.concatenate(first), np.concatenate(long)


def encode(docs: DataFrame, vocabulary: Vocabulary, block_bytes: int = BLOCK_BYTES, shared: int = SHARED, then: tuple[Callable[[pa.RecordBatch], pa.RecordBatch], str] | None = None) -> DataFrame:
    """doc_id, ids of every row of ``docs`` (doc_id, text); or what ``then``, a function of batches of these and the schema of its
    result, makes of them in the same task."""
    finish, schema = then or (lambda batch: batch, "doc_id bigint, ids array<int>")
    blocks = blocks_of(docs, vocabulary.pattern, block_bytes)
    found = shared_words(blocks, vocabulary, shared)
    sent = docs.sparkSession.sparkContext.broadcast((found.column("word").combine_chunks(), found.column("ids").combine_chunks()))
    ranks = vocabulary.ranks

    def apart(words: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
        """Of a block's words: their places among the shared ones, those that are left, and the long ones."""
        known = pa.compute.index_in(words, value_set=sent.value[0])
        rest = words.filter(known.is_null())
        short = pa.compute.less_equal(pa.compute.utf8_length(rest), LONG)
        return known, rest.filter(short), rest.filter(pa.compute.invert(short))

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, ends, words, rest = (batch.column(c)[i].values for c in (0, 1, 3, 4))
                numbers = np.frombuffer(batch.column(2)[i].as_buffer(), np.uint8)
                known, short, long = apart(words)
                # Where each word's ids stand: of the shared ones, then of this block's short and long ones.
                values, first, size = ragged([sent.value[1], rest, pa.array([heap_merged(w.encode("latin-1"), ranks) for w in long.to_pylist()], pa.list_(pa.int32()))])
                place = known.fill_null(-1).to_numpy().astype(np.int64)
                others = np.flatnonzero(place < 0)
                is_long = pa.compute.utf8_length(words.take(pa.array(others))).to_numpy() > LONG
                n = len(sent.value[0])
                place[others[~is_long]] = n + np.arange(len(short))
                place[others[is_long]] = n + len(short) + np.arange(len(long))
                first, size = first[place], size[place]
                bounds = np.concatenate(([0], ends.to_numpy()))
                for a, b in ranges(bounds):  # some texts at a time, so that memory stays bounded
                    mine = unpack(numbers[bounds[a] : bounds[b]])
                    # A text ends after the piece whose last byte is there.
                    before = np.concatenate(([0], np.cumsum(numbers[bounds[a] : bounds[b]] < 128)))[bounds[a : b + 1] - bounds[a]]
                    many = size[mine]
                    upto = np.concatenate(([0], np.cumsum(many)))
                    own = values[np.repeat(first[mine] - upto[:-1], many) + np.arange(int(upto[-1]))]
                    yield finish(pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.ListArray.from_arrays(pa.array(upto[before], pa.int32()), pa.array(own, pa.int32()))], names=["doc_id", "ids"]))
                pa.default_memory_pool().release_unused()

    # The shared words as a literal, too, so that what is left of a block's is found and folded without leaving the JVM.
    literal = F.from_json(F.lit(json.dumps(found.column("word").to_pylist())), "array<string>")
    rest = F.filter(F.array_except("words", literal), lambda w: F.length(w) <= LONG)
    folded = let(vocabulary.rank_map(), lambda ranked: F.transform(rest, lambda w: fold(w, ranked)))
    return blocks.select("doc_ids", "ends", "numbers", "words", folded.alias("rest")).mapInArrow(assemble, schema)


def pieces_of(vocabulary: Vocabulary) -> Callable[[np.ndarray], np.ndarray]:
    """A function from ids to the bytes of their pieces, one after the other; ids that are not in the vocabulary have none."""
    names = [b""] * (max(vocabulary.ranks.values(), default=-1) + 1)
    for piece, rank in vocabulary.ranks.items():
        names[rank] = piece
    pieces, bounds = np.frombuffer(b"".join(names), np.uint8), np.cumsum([0, *map(len, names)])

    def of(ids: np.ndarray) -> np.ndarray:
        ids = ids[(ids >= 0) & (ids < len(bounds) - 1)]
        n = bounds[ids + 1] - bounds[ids]
        ends = np.cumsum(n)
        return pieces[np.repeat(bounds[ids] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)]

    return of


def decode(rows: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``rows`` with ids (array<int>) and decoded (binary) beside their other columns. Cast to a string, decoded is the text, if
    the ids are those of a whole text. A column named decoded is replaced."""
    of = pieces_of(vocabulary)
    others = [c for c in rows.columns if c != "decoded"]
    schema = StructType([*(rows.schema[c] for c in others), StructField("decoded", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [of(x.values.drop_null().to_numpy()).tobytes() if x.is_valid else b"" for x in part.column(part.schema.get_field_index("ids"))]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.binary())], names=[*part.schema.names, "decoded"])

    return rows.select(*others).mapInArrow(run, schema)


def report(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """The digest columns of the contract of op11, made where the ids are."""
    of = pieces_of(vocabulary)

    def digest(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = [x.values.to_numpy() for x in batch.column(1)]
        sums = [hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in lists], [hashlib.sha256(of(x).tobytes()).hexdigest() for x in lists]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, lists), pa.int64()), *map(pa.array, sums)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encode(docs, vocabulary, then=(digest, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"))
