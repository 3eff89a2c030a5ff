"""Mixing sources to target weights.

Every source has a share of the mix by its weight, held below ``most`` times its
own size; what is cut off goes to the other sources by weight (water filling).
A document of a source with repetition rate r = target / size is taken floor(r)
times, and once more if a hash of its id, read as a number in [0, 1), is below
the fraction of r. The hash has ``SEEDS`` seeds; a source uses the one whose total
comes nearest its target, as chance alone leaves a source of few documents far
off. That conditions the draws: the chance of an extra copy is the fraction of r
only nearly, and least nearly in a source of few documents. Reruns agree, no document needs to know of another, and nothing but sums
of sources is gathered.

Nulls: a null text has size 0; null sources are one source, the last; a null
doc_id draws as the empty id. Repeated rows each count and draw alike. An empty
table gives an empty mix; a source without words has target 0 and no copies. Sources
of equal cap by weight are taken in order of name. The table of sources, not of
documents, is put in order in one task. A very long text only counts by its words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import discard, materialize

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
SEEDS = 16


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """From (source, size) rows to one row a source: __source, source_size, target, __rate.

    A source is at its cap if its cap is not above what its weight gives it when
    all sources with a smaller cap per weight are capped. That is one ordered
    pass over the sources, which were summed before. The levels rise up to the first source not capped and fall after
    it, so the final level is their maximum.
    """
    per = sizes.groupBy(F.col("source").alias("__source")).agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("__source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), turn + 1)
    ranked = per.withColumn("w", w).withColumn("cap", F.col("source_size") * most)
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), F.col("__source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    level = (F.lit(share) * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(by_ratio), F.lit(0))) / (
        F.sum("w").over(whole) - F.coalesce(F.sum("w").over(by_ratio), F.lit(0))
    )
    leveled = ranked.withColumn("level", level)
    target = F.when(F.col("cap") <= F.col("w") * F.col("level"), F.col("cap").cast("double")).otherwise(F.col("w") * F.max("level").over(whole))
    out = leveled.withColumn("target", target)
    return out.select("__source", "source_size", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("__rate"))


def draws(doc_id: Column) -> Column:
    """``SEEDS`` numbers in [0, 1) from the id: eight of each of two SHA-256 hashes."""
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    digest = F.concat(*[F.sha2(F.concat(text, F.lit(f":mix{i}")).cast("binary"), 256) for i in range(SEEDS // 8)])
    return F.transform(F.sequence(F.lit(0), F.lit(SEEDS - 1)), lambda i: F.conv(F.substring(digest, i * 8 + 1, F.lit(8)), 16, 10).cast("long") / F.lit(4294967296.0))


def copies(doc_id: Column, rate: Column, seed: Column) -> Column:
    """floor(rate), and one more with the fraction's probability."""
    return (F.floor(rate) + F.when(F.element_at(draws(doc_id), seed + 1) < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def seeded(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """The table of ``targets`` with __seed, the seed whose total is nearest the target (the first of equals)."""
    per = materialize(targets(sizes, weights, share, most), "targets")
    joined = sizes.select("doc_id", "source", "size").join(per, F.col("source").eqNullSafe(F.col("__source")))
    extra = joined.select("__source", "size", (F.col("__rate") - F.floor("__rate")).alias("part"), draws(F.col("doc_id")).alias("draws"))
    sums = [F.sum(F.when(F.col("draws")[i] < F.col("part"), F.col("size")).otherwise(0)).alias(f"s{i}") for i in range(SEEDS)]
    found = extra.groupBy("__source").agg(*sums).withColumnRenamed("__source", "__own")
    rows = per.join(found, F.col("__source").eqNullSafe(F.col("__own")))
    off = lambda i: F.abs(F.floor("__rate") * F.col("source_size") + F.col(f"s{i}") - F.col("target"))
    best = F.least(*[F.struct(off(i).alias("off"), F.lit(i).alias("seed")) for i in range(SEEDS)])
    out = materialize(rows.select("__source", "source_size", "target", "__rate", best["seed"].alias("__seed")), "seeds")
    discard(per)
    return out


def plan(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """One row a document: doc_id, size, source_size, target, taken, copies.

    Only ids, sources and sizes are kept of the scan of the texts; the table of
    sources is joined by whatever way its measured size allows.
    """
    sizes = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    per = seeded(sizes, weights, share, most)
    joined = sizes.join(per, F.col("source").eqNullSafe(F.col("__source")), "left")
    made = joined.withColumn("copies", copies(F.col("doc_id"), F.col("__rate"), F.col("__seed")))
    return made.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, copy_column: str = "mix_copy") -> DataFrame:
    """The mix itself: each document's row as often as it is taken, numbered from 1 in ``copy_column``, which replaces one of that name."""
    source = docs["source"]
    sizes = materialize(docs.select(docs["doc_id"].alias("doc_id"), source.alias("source"), word_count(docs["text"]).alias("size")), "sizes")
    per = seeded(sizes, weights, share, most)
    discard(sizes)
    per = per.select(*[F.col(c).alias(f"__mix_{c}") for c in per.columns])
    joined = docs.join(per, source.eqNullSafe(F.col("__mix___source")), "left")
    number = copies(docs["doc_id"], F.col("__mix___rate"), F.col("__mix___seed"))
    again = F.explode(F.when(number > 0, F.sequence(F.lit(1).cast("long"), number)).otherwise(F.expr("array()").cast("array<bigint>")))
    return joined.select(*[docs[c] for c in docs.columns if c != copy_column], again.alias(copy_column))


ORACLE = r"""
WITH sizes AS MATERIALIZED (
  SELECT doc_id, source, coalesce(source, '') || CASE WHEN source IS NULL THEN '0' ELSE '1' END AS s, coalesce(doc_id::VARCHAR, '') AS d,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents
), per AS MATERIALIZED (
  SELECT s, any_value(source) AS source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY s
), weighted AS MATERIALIZED (
  SELECT s, source, source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM per
), turned AS MATERIALIZED (
  SELECT *, row_number() OVER (ORDER BY (2 * source_size)::DOUBLE / w, source NULLS LAST) AS turn FROM weighted
), leveled AS MATERIALIZED (
  SELECT a.s, a.source_size, a.w, 2 * a.source_size AS cap,
         (1.5::DOUBLE * (SELECT sum(source_size) FROM turned)::DOUBLE - coalesce((SELECT sum(2 * b.source_size) FROM turned AS b WHERE b.turn < a.turn), 0)::DOUBLE)
         / ((SELECT sum(w) FROM turned) - coalesce((SELECT sum(b.w) FROM turned AS b WHERE b.turn < a.turn), 0))::DOUBLE AS level
  FROM turned AS a
), goal AS MATERIALIZED (
  SELECT s, source_size, CASE WHEN cap::DOUBLE <= w * level THEN cap::DOUBLE ELSE w * (SELECT max(level) FROM leveled) END AS target FROM leveled
), rated AS MATERIALIZED (
  SELECT s, source_size, target, CASE WHEN source_size > 0 THEN target / source_size::DOUBLE ELSE 0.0 END AS rate FROM goal
), ids AS MATERIALIZED (
  SELECT DISTINCT d, unnest(range(16)) AS k FROM sizes
), draw AS MATERIALIZED (
  SELECT d, k, ('0x' || substr(sha256(d || ':mix' || (k // 8)::VARCHAR), ((k % 8) * 8 + 1)::INTEGER, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS u FROM ids
), drawn AS MATERIALIZED (
  SELECT z.s, w.k, sum(CASE WHEN w.u < r.rate - floor(r.rate) THEN z.size ELSE 0 END) AS extra
  FROM sizes AS z JOIN rated AS r ON z.s = r.s JOIN draw AS w ON w.d = z.d GROUP BY z.s, w.k
), seed AS MATERIALIZED (
  SELECT d.s, min(struct_pack(off := abs(floor(r.rate) * r.source_size + d.extra - r.target), k := d.k)).k AS k FROM drawn AS d JOIN rated AS r ON d.s = r.s GROUP BY d.s
)
SELECT z.doc_id, z.size, r.source_size, r.target,
       (z.size * (floor(r.rate) + CASE WHEN w.u < r.rate - floor(r.rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM sizes AS z JOIN rated AS r ON z.s = r.s JOIN seed AS e ON e.s = r.s JOIN draw AS w ON w.d = z.d AND w.k = e.k
"""
