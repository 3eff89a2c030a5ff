"""Reachability from many roots at once, without a row a (root, node).

Sixty-four roots share a long: a node's word has a bit for each root of its group that reaches it, and words of
neighbours are joined by or, an aggregate with a partial step. A round moves only the bits that are new, so a node's
rows are as many as the rounds in which it gains bits, not as many as its roots. Depths are kept as what became new in
each round. Counts of reached nodes come from the words' bits; pairs are made only where they are asked for.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed, forget, numbered
from .temporal import as_of

ROUNDS_TO_MERGE = 8


def grouped(roots: DataFrame) -> DataFrame:
    """root, group, bit: 64 roots a group, in order of their names."""
    rows = numbered(roots.select("root").where("root is not null").distinct(), ["root"], "n")
    return rows.select("root", F.expr("(n - 1) div 64").alias("group"), F.expr("cast((n - 1) % 64 as int)").alias("bit"))


def reach(edges: DataFrame, roots: DataFrame, max_depth: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(layers, places): places is as ``grouped`` gives it; layers is node, group, depth, bits: the roots (bits) of the group that
    reach the node over edges (src, dst) in ``depth`` steps and not in fewer. A root isn't reached by itself.
    """
    edges = checkpointed(edges.select("src", "dst").where("src is not null and dst is not null and src <> dst").distinct())
    places = checkpointed(grouped(roots))
    one = F.expr("shiftleft(1L, bit)")
    frontier = checkpointed(places.groupBy(F.col("root").alias("node"), "group").agg(F.bit_or(one).alias("bits")))
    seen, layers, depth = frontier, [], 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = frontier.join(edges, frontier["node"] == edges["src"]).groupBy(F.col("dst").alias("node"), "group").agg(F.bit_or("bits").alias("come"))
        step = step.join(seen.select("node", "group", F.col("bits").alias("had")), ["node", "group"], "left")
        fresh = F.col("come").bitwiseAND(F.bitwise_not(F.coalesce("had", F.lit(0).cast("long"))))
        frontier = checkpointed(step.select("node", "group", F.lit(depth).alias("depth"), fresh.alias("bits")).where("bits <> 0"))
        if not frontier.limit(1).count():
            break
        layers.append(frontier)
        if len(layers) == ROUNDS_TO_MERGE:
            whole = checkpointed(reduce(DataFrame.union, layers))
            forget(*layers[:-1])
            layers = [whole]
        both = seen.select("node", "group", "bits").union(frontier.select("node", "group", "bits"))
        old, seen = seen, checkpointed(both.groupBy("node", "group").agg(F.bit_or("bits").alias("bits")))
        forget(old)
    if not layers:
        return frontier.limit(0).select("node", "group", F.lit(0).alias("depth"), "bits"), places
    return reduce(DataFrame.union, layers), places


def pairs(layers: DataFrame, places: DataFrame) -> DataFrame:
    """root, node, depth of every root and node it reaches."""
    bits = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda b: F.call_function("getbit", "bits", b) == 1)
    rows = layers.select("node", "group", "depth", F.explode(bits).alias("bit"))
    return rows.join(places, ["group", "bit"]).select("root", "node", "depth")


def counts(layers: DataFrame, places: DataFrame) -> DataFrame:
    """root, reached, farthest: how many nodes each root reaches and in how many steps the last of them; 0 for none.

    Words are counted bit by bit within a partition, so a group's rows are 64 a depth before they are shuffled.
    """
    each = [F.sum(F.call_function("getbit", "bits", F.lit(b)).cast("long")).alias(f"n{b}") for b in range(64)]
    by_depth = layers.groupBy("group", "depth").agg(*each)
    rows = by_depth.select("group", "depth", F.posexplode(F.array(*[f"n{b}" for b in range(64)])).alias("bit", "n")).where("n > 0")
    found = rows.groupBy("group", "bit").agg(F.sum("n").alias("reached"), F.max("depth").alias("farthest"))
    return places.join(found, ["group", "bit"], "left").select("root", F.coalesce("reached", F.lit(0)).alias("reached"), F.coalesce("farthest", F.lit(0)).alias("farthest"))


def dependencies(relations: DataFrame, roots: DataFrame, at: str, relation_type: str | None = None, max_depth: int | None = None, reverse: bool = False) -> tuple[DataFrame, DataFrame]:
    """What ``reach`` gives over the relations active at a time, or over their reverse (dependents)."""
    src, dst = ("target_id", "source_id") if reverse else ("source_id", "target_id")
    return reach(as_of(relations, at, relation_type).select(F.col(src).alias("src"), F.col(dst).alias("dst")), roots, max_depth)
