"""MinHash near-duplicate classes with min-max hashing.

A document's set holds its distinct k-word shingles as 64-bit hashes (fewer words
than k: the whole sequence as one). Documents of equal sets form a class at once,
however many they are, and one of them stands for it. Each of ``HASHES``
permutations gives two values, the smallest and the largest; a band joins both of
``ROWS`` permutations, so half the hash evaluations fill the same bands, and a
pair of similarity J meets in a band with probability J ** (2 * ROWS). With 126
permutations in 42 bands, a pair at 0.8 is missed with probability 3e-6.
Minimum and maximum are draws without replacement, which tells in small sets
(3.6e-5 at 4 of 5). Sets of at most ``SMALL`` shingles have an exact path besides:
two sets that have m shingles in common share ``SHARED`` of the first n - m + SHARED
of each, in order of hash, so every choice of ``SHARED`` of these is a bucket as
well. Pairs of small sets are all found; a pair with a larger one is missed with
probability 4.5e-6 at worst (20 of 25).

Candidates are confirmed on the full sets in three rounds, so that no bucket is
ever expanded into all its pairs:

1. every class with its best hub (of the first classes of its buckets, the one
   met in most bands);
2. every class with its other hubs, where the components still differ;
3. in buckets whose classes (but for the hub) still lie in different components,
   those outside the most frequent one with all others of other components. Both sides
   are dealt into blocks of about ``BLOCK``; a task holds one block of each, counts
   intersections through the block's inverted list, and gives one link for
   a class and component, so no pairs are written out.

After that every pair that shares a bucket is linked, was held against each
other, or lies in one component already, so components are those of all links
found. Everything is keyed by class and band: groups of copies and of near
copies are only ever joined (where Spark splits large keys) or partially
aggregated, never gathered in one task. A bounded bitmap of the candidates' ids
stands before the join that fetches their texts, so texts of others are not
shuffled (with more than some millions of candidates the bitmap fills up, and
the join alone sorts them out). Copies are reduced to one row a class before
anything is exploded, and sets travel as six bytes a shingle.

An empty table gives an empty result. A text is one slice however long it is,
and its set the only thing that grows with it.

Nulls: a document without words or text has an empty set, n_shingles 0, and is
linked with nothing; its component is itself. A null doc_id never becomes a
component unless all of the class are null. Repeated rows are one class, and as
each row's doc_id equals the component_id, each is kept in the report; the stage
``drop_copies`` leaves one. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .shared import among, bitmap, discard, identity, materialize, without
from .textops import GRAPHIC, chained, hashed_words, mix, slices

HASHES, ROWS = 126, 3
SMALL, SHARED = 19, 3
PERCENT = 80
BLOCK = 256

_RNG = np.random.default_rng(17)
_FACTORS = _RNG.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _RNG.integers(1, 2**63, HASHES, dtype=np.uint64)

SIGNED = "doc_id long, mark long, n_shingles long, class long, bands array<bigint>"


def shingle_sets(column: pa.Array, k: int) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes."""
    hashes, first = hashed_words(column, GRAPHIC)
    grams = chained([hashes[i : max(len(hashes) - k + 1 + i, 0)] for i in range(k)]) if len(hashes) >= k else hashes[:0]
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(grams[a : b - k + 1]))
        elif b > a:
            out.append(chained([mix(hashes[a:a + 1] ^ np.uint64(b - a)), *[hashes[i : i + 1] for i in range(a + 1, b)]]))
        else:
            out.append(hashes[:0])
    return out


def class_of(s: np.ndarray) -> int:
    """A hash of the set, which stands for it."""
    if not len(s):
        return 0
    with np.errstate(over="ignore"):
        both = np.array([np.add.reduce(mix(s)), np.bitwise_xor.reduce(mix(s ^ np.uint64(0x5851F42D4C957F2D)))], np.uint64)
        return int(mix(chained([both[:1], both[1:]]) + np.uint64(len(s))).view(np.int64)[0])


def bands_of(sets: list[np.ndarray]) -> np.ndarray:
    """One row of bucket hashes, one a band, for each (not empty) set."""
    sizes = np.array([len(s) for s in sets])
    flat, starts = np.concatenate(sets), np.cumsum(sizes) - sizes
    values = np.empty((2 * HASHES, len(sets)), np.uint64)
    for j in range(HASHES):
        turned = flat * _FACTORS[j] + _SHIFTS[j]
        turned ^= turned >> np.uint64(32)
        values[2 * j] = np.minimum.reduceat(turned, starts)
        values[2 * j + 1] = np.maximum.reduceat(turned, starts)
    wide = 2 * ROWS
    number = lambda b: np.full(len(sets), b, np.uint64)
    return np.stack([chained([number(b), *[values[b * wide + i] for i in range(wide)]]) for b in range(HASHES // ROWS)], axis=1)


def small_buckets(sets: list[np.ndarray], percent: int) -> dict[int, np.ndarray]:
    """Of the small sets, by place in the list: more bucket hashes. Two sets with at least percent of either in common share one.

    With ``SHARED`` shingles in common or fewer asked for, there are none; at 80 percent such sets are linked only if equal.
    """
    out = {}
    sizes = np.array([len(s) for s in sets])
    for n in np.unique(sizes[sizes <= SMALL]).tolist():
        common = -(-percent * n // 100)
        if common < SHARED:
            continue
        at = np.flatnonzero(sizes == n)
        lead = np.stack([sets[i] for i in at])[:, : n - common + SHARED]
        number = np.full(len(at), HASHES // ROWS, np.uint64)
        rows = np.stack([chained([number, *[lead[:, c] for c in some]]) for some in combinations(range(lead.shape[1]), SHARED)], axis=1)
        out.update(zip(at.tolist(), rows))
    return out


def signatures(docs: DataFrame, k: int, percent: int = PERCENT) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            sets = shingle_sets(part.column("text"), k)
            full = [i for i, s in enumerate(sets) if len(s)]
            bands: list = [[]] * len(sets)
            if full:
                for i, row in zip(full, bands_of([sets[i] for i in full]).view(np.int64)):
                    bands[i] = row
                for i, row in small_buckets(sets, percent).items():
                    bands[i] = np.concatenate([bands[i], row.view(np.int64)])
            columns = [part.column("doc_id"), part.column("mark"), pa.array([len(s) for s in sets], pa.int64()), pa.array([class_of(s) for s in sets], pa.int64()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in SIGNED.split(", ")])

    return docs.select(*identity(docs), docs["text"].alias("text")).mapInArrow(run, SIGNED)


def packed(s: np.ndarray) -> bytes:
    """Six bytes of each hash of an ascending set, in its order."""
    return np.ascontiguousarray(s.view(np.uint8).reshape(-1, 8)[:, 2:]).tobytes()


def opened(x: bytes) -> np.ndarray:
    wide = np.zeros((len(x) // 6, 8), np.uint8)
    wide[:, 2:] = np.frombuffer(x, np.uint8).reshape(-1, 6)
    return wide.view(np.uint64).ravel()


def sets_of(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """class, shingles (packed) of the wanted classes (class, doc_id, mark of one document of each), as a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            own = [packed(s) for s in shingle_sets(part.column("text"), k)]
            yield pa.RecordBatch.from_arrays([part.column("class"), pa.array(own, pa.binary())], names=["class", "shingles"])

    wanted = wanted.select("class", F.col("doc_id").alias("__first"), F.col("mark").alias("__mark"))
    rows = docs.select(*identity(docs), docs["text"].alias("text"))
    rows = among(rows, F.struct("doc_id", "mark"), bitmap(wanted, F.struct("__first", "__mark")))
    found = rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("__first")) & (F.col("mark") == F.col("__mark")))
    sets = materialize(found.select("class", "text").mapInArrow(run, "class long, shingles binary"), "sets")
    if sets.count() == wanted.count():
        return sets
    once = materialize(sets.groupBy("class").agg(F.first("shingles").alias("shingles")), "sets")  # repeated rows
    discard(sets)
    return once


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b) of classes, those with 100 * intersection >= percent * union of the full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "set_a"):
            keep = []
            for x, y in zip(part.column("set_a").to_pylist(), part.column("set_b").to_pylist()):
                n = len(x) // 6 + len(y) // 6
                both = n - len(np.unique(np.concatenate([opened(x), opened(y)])))
                keep.append(both > 0 and 100 * both >= percent * (n - both))
            yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda n: sets.select(F.col("class").alias(n), F.col("shingles").alias(f"set_{n}"))
    return pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long")


def split_buckets(shared: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, the table they are read from) with bucket, class, root, minor (not of the bucket's most frequent component), n, minors: rows of buckets of several components."""
    placed = shared.join(roots, shared["class"] == roots["node"], "left").select("bucket", "class", F.coalesce("root", "class").alias("root"))
    placed = materialize(placed, "placed")
    counts = placed.groupBy("bucket", "root").agg(F.count("*").alias("n"))
    split = counts.groupBy("bucket").agg(F.max(F.struct("n", "root")).alias("x"), F.sum("n").alias("n"), F.count("*").alias("several")).where("several > 1")
    split = split.select("bucket", F.col("x.root").alias("major"), "n", (F.col("n") - F.col("x.n")).alias("minors"))
    return placed.join(split, "bucket").select("bucket", "class", "root", (F.col("root") != F.col("major")).alias("minor"), "n", "minors"), placed


def block_links(rows: DataFrame, sets: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between classes of a bucket in different components, one for each minor class and component in a block."""

    def compare(found: pa.Table) -> pa.Table:
        rows = sorted(found.to_pylist(), key=lambda r: r["class"])
        asked, held = [r for r in rows if r["asks"]], [r for r in rows if not r["asks"]]
        a, b = [], []
        if asked and held:
            own = [opened(r["shingles"]) for r in held]
            size = np.array([len(x) for x in own])
            root = np.array([r["root"] for r in held])
            keys, who = np.concatenate(own), np.repeat(np.arange(len(own)), size)
            order = np.argsort(keys, kind="stable")
            keys, who = keys[order], who[order]
            for r in asked:
                x = opened(r["shingles"])
                lo, n = np.searchsorted(keys, x), np.searchsorted(keys, x, "right")
                n = n - lo
                hit = who[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
                both = np.bincount(hit, minlength=len(own))
                near = np.flatnonzero((root != r["root"]) & (both > 0) & (100 * both >= percent * (len(x) + size - both)))
                for i in near[np.unique(root[near], return_index=True)[1]]:
                    a.append(r["class"])
                    b.append(held[i]["class"])
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    of = lambda n: F.ceil(F.col(n) / block).cast("int")
    deal = lambda role, n: F.pmod(F.xxhash64("class", F.lit(role)), of(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), of(n) - 1))
    asks = rows.where("minor").select("bucket", "class", "root", deal("asks", "minors").alias("ask_block"), each("n").alias("held_block"), F.lit(True).alias("asks"))
    held = rows.select("bucket", "class", "root", each("minors").alias("ask_block"), deal("held", "n").alias("held_block"), F.lit(False).alias("asks"))
    dealt = asks.unionByName(held).join(sets, "class")
    return dealt.groupBy("bucket", "ask_block", "held_block").applyInArrow(compare, "a long, b long")


def classes(docs: DataFrame, k: int, percent: int = PERCENT) -> DataFrame:
    """doc_id, mark, n_shingles, class, root (the component's smallest class), component_id of every row of ``docs``."""
    signed = materialize(signatures(docs, k, percent), "signatures")
    members = materialize(signed.drop("bands"), "members")
    # One row a class, with the document that stands for it: copies go before anything is exploded or joined.
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "mark")).alias("x")
    unique = signed.where("n_shingles > 0").groupBy("class").agg(least, F.first("bands").alias("bands"))
    unique = materialize(unique.select("class", "x.doc_id", "x.mark", "bands"), "classes")
    discard(signed)
    rows = unique.select("class", F.explode("bands").alias("bucket"))
    hubs = rows.groupBy("bucket").agg(F.min("class").alias("hub"), F.max("class").alias("last")).where("hub < last")
    hubs = materialize(hubs.select("bucket", "hub"), "hubs")
    shared = materialize(among(rows, F.col("bucket"), bitmap(hubs, F.col("bucket"))).join(hubs, "bucket"), "shared")
    owner = materialize(unique.drop("bands"), "owners")
    discard(unique, hubs)
    wanted = materialize(owner.join(shared.select("class").distinct(), "class", "left_semi"), "wanted")
    sets = sets_of(docs, wanted, k)

    met = materialize(shared.where("class <> hub").groupBy(F.col("hub").alias("a"), F.col("class").alias("b")).agg(F.count("*").alias("n")), "met")
    best = met.groupBy("b").agg(F.max(F.struct("n", "a")).alias("x")).select(F.col("x.a").alias("a"), "b")
    tried = materialize(best, "tried")
    links = [materialize(confirmed(tried, sets, percent), "links")]

    def apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
        of = lambda n: labels.select(F.col("node").alias(n), F.col("root").alias(f"root_{n}"))
        out = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
        return out.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")

    roots = components(links[0])
    second = materialize(apart(met.join(tried, ["a", "b"], "left_anti").select("a", "b"), roots), "second")
    links.append(materialize(confirmed(second, sets, percent), "links"))
    discard(roots, met, tried, second)
    roots = components(links[0].union(links[1]))

    # A bucket's hub was held against all its classes above, or lies in their component.
    rows, placed = split_buckets(shared.where("class <> hub"), roots)
    links.append(materialize(block_links(rows, sets, percent), "links"))
    discard(placed, sets, shared, wanted)
    if links[2].limit(1).count():
        discard(roots)
        roots = components(links[0].union(links[1]).union(links[2]))
    discard(*links)

    # Classes without a link are their own components; only the others are looked up by root.
    linked = owner.join(roots, owner["class"] == roots["node"]).select("class", "doc_id", "root")
    lowest = linked.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = materialize(linked.join(lowest, "root").select(F.col("class").alias("__class"), "root", "component_id"), "components")
    alone = owner.select(F.col("class").alias("__own"), F.col("doc_id").alias("__least"))
    out = members.join(alone, (members["class"] == alone["__own"]) & (members["n_shingles"] > 0), "left").join(named, F.col("__own") == F.col("__class"), "left")
    component = F.when(F.col("n_shingles") > 0, F.when(F.col("__class").isNotNull(), F.col("component_id")).otherwise(F.col("__least"))).otherwise(F.col("doc_id"))
    out = out.select("doc_id", "mark", "n_shingles", "class", F.when(F.col("n_shingles") > 0, F.coalesce("root", "class")).alias("root"), component.alias("component_id"))
    out = materialize(out, "components")
    discard(members, owner, named, roots)
    return out


def report(docs: DataFrame, k: int = 2, percent: int = PERCENT) -> DataFrame:
    """The digest columns of the contract of op4."""
    return classes(docs, k, percent).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_copies(docs: DataFrame, k: int = 5, percent: int = PERCENT) -> DataFrame:
    """Rows of ``docs``, unchanged, without near copies: of each component the row of the smallest doc_id stays.

    What goes is a written table of ids and hashes of texts. A bounded bitmap of it
    tells which rows have to meet it in a join, so most texts are not shuffled.
    """
    found = classes(docs, k, percent)
    every = found.where("root is not null")
    least = F.col("doc_id").eqNullSafe(F.col("component_id"))
    gone = every.where(~least).select("doc_id", "mark")
    again = every.where(least).groupBy("root").agg(F.min("mark").alias("stays"), F.count("*").alias("n")).where("n > 1").select("root", "stays")
    again = materialize(again, "again")
    if not again.limit(1).count():
        gone = materialize(gone, "gone")
        discard(found, again)
        return without(docs, gone)
    # Rows of equal doc_id in one component: the smallest hash of a text stays, once.
    kept = every.where(least).join(again, "root")
    gone = gone.union(kept.where("mark <> stays").select("doc_id", "mark"))
    once = materialize(kept.where("mark = stays").select("doc_id", "mark").distinct(), "once")
    repeated = docs.join(once.select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark")), docs["doc_id"].cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(docs["text"]) == F.col("__mark")))
    first = repeated.select(*[docs[c] for c in docs.columns], "__id", "__mark").dropDuplicates(["__id", "__mark"]).drop("__id", "__mark")
    gone = materialize(gone.union(once), "gone")
    discard(found, again)
    return without(docs, gone).union(first)


#: Every pair that shares a shingle is counted: for small tables only. doc_ids are taken to be different.
ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS shingle
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 1, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS MATERIALIZED (
  SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS MATERIALIZED (
  SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)
), e AS (
  SELECT x, y FROM l UNION SELECT y, x FROM l
), reach AS (
  SELECT x, y FROM e UNION SELECT r.x, e.y FROM reach r JOIN e ON e.x = r.y
), low AS (
  SELECT x AS doc_id, min(y) AS y FROM reach GROUP BY 1
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(low.y, d.doc_id))::BIGINT AS component_id, coalesce(low.y, d.doc_id) >= d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN low USING (doc_id)
"""
