"""Trees at once: depths, sizes, pre- and post-order numbers, and roll-ups for every node of a forest.

Pointers to ancestors are doubled, so rounds grow with the logarithm of the depth and not with the number of roots or
levels; a round is two joins on a node and one aggregate with a partial step, so a node with a third of all children is
spread. Numbers turn every subtree into a range: totals of any number of measures are differences of running sums.

A node's parent is its last active one, as everywhere. Nodes on a cycle, or below one, raise a ``ValueError``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed, forget, running
from .temporal import is_active, last_by


def forest(edges: DataFrame, at: str) -> DataFrame:
    """node, parent (null for roots), seq of the edge: every node of the active hierarchy once."""
    active = edges.where(is_active(at))
    up = last_by(active, ["child_id"], ["seq"], ["parent_id", "seq"]).select(F.col("child_id").alias("node"), F.col("parent_id").alias("parent"), "seq")
    tops = active.select(F.col("parent_id").alias("node")).distinct().join(up.select("node"), "node", "left_anti")
    return up.unionByName(tops.select("node", F.lit(None).cast("string").alias("parent"), F.lit(None).cast("bigint").alias("seq")))


def doubled(rows: DataFrame, pointer: str, along: dict[str, Column] | None = None, below: dict | None = None) -> DataFrame:
    """Folds values along pointers by doubling them. rows: node, the pointer (null at the end of a way), and the values named.

    along: how a node's value takes in that of the node it points to, a Column of ``<name>`` and ``far_<name>``; at the end it is
    that of the whole way. below: F.sum, F.max or F.min, by which a node's value takes in those of all nodes that lead to it.
    """
    along, below = along or {}, below or {}
    names = [*along, *below]
    state = checkpointed(rows.select("node", F.col(pointer).alias("far"), *names))
    rounds = max(2, state.count()).bit_length() + 1
    for _ in range(rounds):
        if not state.where("far is not null").limit(1).count():
            return state.drop("far")
        far = state.select(F.col("node").alias("far"), F.col("far").alias("next"), *[F.col(n).alias(f"far_{n}") for n in along])
        step = state.join(far, "far", "left")
        if below:
            low = state.where("far is not null").groupBy(F.col("far").alias("node")).agg(*[kind(n).alias(f"low_{n}") for n, kind in below.items()])
            step = step.join(low, "node", "left")
        merge = {F.sum: lambda a, b: a + F.coalesce(b, F.lit(0)), F.max: F.greatest, F.min: F.least}
        new = checkpointed(step.select(
            "node", F.col("next").alias("far"), *[F.when(F.col("far").isNull(), F.col(n)).otherwise(c).alias(n) for n, c in along.items()],
            *[merge[kind](F.col(n), F.col(f"low_{n}")).alias(n) for n, kind in below.items()],
        ))
        forget(state)
        state = new
    raise ValueError("the hierarchy has a cycle")


def tour(nodes: DataFrame) -> DataFrame:
    """node, parent, root, depth, size, pre, post of a forest (node, parent, seq), all numbers from 1 but the depth, which is 0 at roots.

    pre numbers nodes in the order of a walk, children in order of seq, trees in order of their roots; the subtree of a node has
    the numbers from pre to pre + size - 1. post numbers them in the order in which the walk leaves them.
    """
    nodes = checkpointed(nodes.select("node", "parent", "seq"))
    one = F.lit(1).cast("long")
    up = doubled(nodes.select("node", "parent", F.when(F.col("parent").isNull(), 0).otherwise(one).alias("depth"), F.coalesce("parent", "node").alias("root"), one.alias("size")),
                 "parent", {"depth": F.col("depth") + F.col("far_depth"), "root": F.col("far_root")}, {"size": F.sum})
    # Before a node in its parent's order come the subtrees of its earlier siblings.
    placed = checkpointed(running(nodes.join(up, "node"), ["parent", "seq", "node"], ["size"]))
    first = placed.groupBy(F.col("parent").alias("of")).agg(F.min("before_size").alias("start"))
    offset = placed.join(first, F.col("parent").eqNullSafe(F.col("of"))).select("node", "parent", (F.col("before_size") - F.col("start") + 1).alias("pre"))
    pre = doubled(offset, "parent", {"pre": F.col("pre") + F.col("far_pre")})
    out = up.join(pre, "node").join(nodes.select("node", "parent"), "node")
    # All that the walk has left before: what it has met before, less the ancestors still open, and the node's own subtree.
    return out.select("node", "parent", "root", "depth", "size", "pre", (F.col("pre") - F.col("depth") + F.col("size") - 1).alias("post"))


def subtree_totals(toured: DataFrame, values: DataFrame, names: list[str]) -> DataFrame:
    """node and, for each name, the total of ``values`` (node and the names) over the node's subtree; missing ones count 0."""
    numbered = checkpointed(toured.select("node", "pre", "size"))
    zero = lambda n: F.coalesce(n, F.lit(0).cast(values.schema[n].dataType)).alias(n)
    summed = checkpointed(running(numbered.join(values.select("node", *names), "node", "left").select("node", "pre", *[zero(n) for n in names]), ["pre"], names))
    upto = summed.select(F.col("pre").alias("last"), *[(F.col(f"before_{n}") + F.col(n)).alias(f"upto_{n}") for n in names])
    rows = numbered.withColumn("last", F.col("pre") + F.col("size") - 1).join(summed.select("node", *[f"before_{n}" for n in names]), "node").join(upto, "last")
    return rows.select("node", *[(F.col(f"upto_{n}") - F.col(f"before_{n}")).alias(n) for n in names])


def subtree_sizes(edges: DataFrame, at: str) -> DataFrame:
    """node, size (descendants, the node left out) of every node of the active hierarchy."""
    return tour(forest(edges, at)).select("node", (F.col("size") - 1).alias("size"))


def rollup_forest(edges: DataFrame, obs: DataFrame, metric_id: str, at: str) -> DataFrame:
    """entity_id, child_count, sum, avg, max, min, count, latest of every node with children, rolled up from the leaves.

    A leaf has its latest value, or 0; an inner node rolls its children's rolled values up. Leaves are folded into their parents
    first, in one aggregate, so that pointers are doubled among inner nodes only: sums, greatest and least are folded upwards, the
    average of averages is a total weighted by the numbers of siblings on the way, and the latest is the value of the leaf that
    the last children lead to. Totals are of a node's own leaves, not differences of sums over the whole forest.
    """
    up = last_by(edges.where(is_active(at)), ["child_id"], ["seq"], ["parent_id", "seq"]).select(F.col("child_id").alias("node"), F.col("parent_id").alias("parent"), "seq")
    own = last_by(obs.where(F.col("metric_id") == metric_id), ["entity_id"], ["seq"], ["value"]).select(F.col("entity_id").alias("node"), "value")
    inner = up.where("parent is not null").select(F.col("parent").alias("node"), F.lit(True).alias("inner")).distinct()
    nodes = checkpointed(up.join(own, "node", "left").join(inner, "node", "left").select("node", "parent", "seq", F.coalesce("inner", F.lit(False)).alias("inner"), F.coalesce("value", F.lit(0.0)).alias("value")))
    leaf = F.when(~F.col("inner"), F.col("value"))
    last = F.max_by(F.struct("node", "value", "inner"), F.struct("seq", "node"))
    kids = nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(
        F.count("*").alias("child_count"), last.alias("last"), F.coalesce(F.sum(leaf), F.lit(0.0)).alias("sum"), F.max(leaf).alias("high"), F.min(leaf).alias("low"),
    )
    base = checkpointed(kids.join(nodes.where("inner").select("node", "parent"), "node", "left"))
    forget(nodes)
    shares = base.select(F.col("node").alias("parent"), (1.0 / F.col("child_count")).alias("weight"))
    weighed = base.join(shares, "parent", "left").select("node", "parent", F.coalesce("weight", F.lit(1.0)).alias("weight"), "sum", "high", "low")
    folded = doubled(weighed, "parent", {"weight": F.col("weight") * F.col("far_weight")}, {"sum": F.sum, "high": F.max, "low": F.min})
    means = base.join(folded.select("node", "weight"), "node").select("node", "parent", (F.col("sum") / F.col("child_count") * F.col("weight")).alias("mean"))
    means = doubled(means, "parent", None, {"mean": F.sum})
    ends = doubled(base.select("node", F.when(F.col("last.inner"), F.col("last.node")).alias("onward"), F.col("last.value").alias("latest")), "onward", {"latest": F.col("far_latest")})
    out = base.select("node", "child_count").join(folded, "node").join(means, "node").join(ends, "node")
    return out.select(
        F.col("node").alias("entity_id"), "child_count", "sum", (F.col("mean") / F.col("weight")).alias("avg"), F.col("high").alias("max"), F.col("low").alias("min"),
        F.col("child_count").cast("double").alias("count"), "latest",
    )
