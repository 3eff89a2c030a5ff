"""Ordered traversals, components and lineage.

Fix-points are frontier loops: a step joins the frontier with the edges, keeps one
row a node, drops visited ones by an anti join and writes the result, so work is
in proportion to the edges reached, on trees and dense graphs alike.
Breadth-first discovery order equals the order of (depth, array of edge seqs).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed, forget, numbered
from .temporal import as_of, last_by, parent_of


MERGE_AT = 6


def _merged(parts: list[DataFrame]) -> list[DataFrame]:
    """Written tables as one, once there are several: plans stay short however deep a graph is, and a row is rewritten rarely."""
    if len(parts) < MERGE_AT:
        return parts
    whole = checkpointed(reduce(DataFrame.union, parts))
    forget(*parts[:-1])  # the last is still the frontier
    return [whole]


def descend(edges: DataFrame, roots: DataFrame, max_depth: int | None = None, stored: bool = False) -> DataFrame:
    """root, node, depth, path, order of all nodes reached over edges (src, dst, seq) from each root, the root itself left out.

    Every node comes once, by its first-found path; nodes at ``max_depth`` are returned, not expanded. Edges that are
    ``stored`` (a written table of these columns) aren't written again; nor are others for a depth of one or two.
    """
    if not stored and (max_depth is None or max_depth > 2):
        edges = checkpointed(edges.select("src", "dst", "seq"))
    start = roots.select("root").distinct()
    frontier = start.select("root", F.col("root").alias("node"), F.array("root").alias("path"), F.array().cast("array<bigint>").alias("order"))
    found, depth = [], 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = frontier.join(edges, frontier["node"] == edges["src"]).select("root", F.col("dst").alias("node"), F.concat("order", F.array("seq")).alias("order"), F.concat("path", F.array("dst")).alias("path"))
        step = step.groupBy("root", "node").agg(F.min(F.struct("order", "path")).alias("x")).where("root <> node")
        if found:
            step = step.join(reduce(DataFrame.union, found).select("root", "node"), ["root", "node"], "left_anti")
        frontier = checkpointed(step.select("root", "node", F.lit(depth).alias("depth"), "x.path", "x.order"))
        if not frontier.limit(1).count():
            break
        found = _merged([*found, frontier])
    if not found:
        return frontier.limit(0).withColumn("depth", F.lit(0)).select("root", "node", "depth", "path", "order")
    return reduce(DataFrame.union, found)


def ascend(up: DataFrame, starts: DataFrame | None = None, max_depth: int | None = None) -> DataFrame:
    """node, ancestor, distance, path from up (node, parent), one parent a node at most; a repeated node ends its chain."""
    up = checkpointed(up.select("node", "parent"))
    first = up if starts is None else up.join(starts.select("node").distinct(), "node", "left_semi")
    level = first.where("node <> parent").select("node", F.col("parent").alias("ancestor"), F.lit(1).alias("distance"), F.array("node", "parent").alias("path"))
    found, depth = [level], 1
    while max_depth is None or depth < max_depth:
        depth += 1
        hop = up.select(F.col("node").alias("ancestor"), F.col("parent").alias("next"))
        level = level.join(hop, "ancestor").where(~F.array_contains("path", F.col("next")))
        level = checkpointed(level.select("node", F.col("next").alias("ancestor"), F.lit(depth).alias("distance"), F.concat("path", F.array("next")).alias("path")))
        if not level.limit(1).count():
            break
        found = _merged([*found, level])
    out = reduce(DataFrame.union, found)
    return out if max_depth is None or max_depth > 0 else out.limit(0)


def depths(up: DataFrame) -> DataFrame:
    """node, depth: the number of steps from each node of up (node, parent) to the last one that isn't repeated.

    Pointer doubling: a round doubles the steps known of every node, so rounds grow with the logarithm of the depth. Nodes that
    lead into a cycle never end; only they are walked step by step.
    """
    up = checkpointed(up.select("node", "parent"))
    known = up.where("node <> parent").select("node", F.col("parent").alias("far"), F.lit(1).alias("depth"), F.lit(True).alias("open"))
    limit = max(2, up.count()).bit_length() + 1
    for _ in range(limit):
        onward = known.select(F.col("node").alias("far"), F.col("far").alias("__far"), F.col("depth").alias("__more"), F.col("open").alias("__open"))
        step = known.where("open").join(onward, "far", "left")
        step = step.select("node", F.coalesce("__far", "far").alias("far"), (F.col("depth") + F.coalesce("__more", F.lit(0))).alias("depth"), F.coalesce("__open", F.lit(False)).alias("open"))
        old, known = known, checkpointed(step.union(known.where("not open").select("node", "far", "depth", "open")))
        forget(old)
        if not known.where("open").limit(1).count():
            return known.select("node", "depth")
    rest = ascend(up, known.where("open")).groupBy("node").agg(F.max("distance").alias("depth"))
    return known.where("not open").select("node", "depth").union(rest)


def _down(edges: DataFrame, at: str) -> DataFrame:
    return as_of(edges, at).select(F.col("parent_id").alias("src"), F.col("child_id").alias("dst"), "seq")


def macro_descent(edges: DataFrame, roots: DataFrame, at: str, max_depth: int | None = None) -> DataFrame:
    return descend(_down(edges, at), roots, max_depth)


def micro_ascent(edges: DataFrame, at: str, starts: DataFrame | None = None, max_depth: int | None = None) -> DataFrame:
    return ascend(parent_of(edges, at).select(F.col("child_id").alias("node"), F.col("parent_id").alias("parent")), starts, max_depth)


def dependency_trace(relations: DataFrame, roots: DataFrame, at: str, relation_type: str | None = None, max_depth: int | None = None, reverse: bool = False) -> DataFrame:
    src, dst = ("target_id", "source_id") if reverse else ("source_id", "target_id")
    return descend(as_of(relations, at, relation_type).select(F.col(src).alias("src"), F.col(dst).alias("dst"), "seq"), roots, max_depth)


def blast_radius(edges: DataFrame, relations: DataFrame, roots: DataFrame, at: str, max_depth: int = 3) -> DataFrame:
    """root, node, direction, distance: ancestors, descendants and dependents; a node may come once a direction."""
    up = micro_ascent(edges, at, roots.select(F.col("root").alias("node")), max_depth)
    rows = [up.select(F.col("node").alias("root"), F.col("ancestor").alias("node"), F.lit("upward").alias("direction"), "distance", "path")]
    for direction, df in (("downward", macro_descent(edges, roots, at, max_depth)), ("lateral", dependency_trace(relations, roots, at, None, max_depth, True))):
        rows.append(df.select("root", "node", F.lit(direction).alias("direction"), F.col("depth").alias("distance"), "path"))
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def roots_of(edges: DataFrame, at: str) -> DataFrame:
    rows = as_of(edges, at)
    return rows.select(F.col("parent_id").alias("uid")).subtract(rows.select("child_id"))


def leaves_of(edges: DataFrame, at: str) -> DataFrame:
    rows = as_of(edges, at)
    return rows.select(F.col("child_id").alias("uid")).subtract(rows.select("parent_id"))


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node) over undirected links (a, b): smallest label of the neighbourhood, then pointer jumping."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = checkpointed(both)
    labels, last = both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("component")), both.limit(0)
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        low = labels.join(near, "node").select("node", "component", F.least("component", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("component").alias("next"))
        new = checkpointed(low.join(jump, "low").select("node", F.least("low", "next").alias("new"), F.col("component").alias("old")))
        forget(last)
        labels, last = new.select("node", F.col("new").alias("component")), new
        if not new.where("new <> old").limit(1).count():
            return labels


def clusters(relations: DataFrame, at: str, relation_type: str | None = None, least: int = 2) -> DataFrame:
    """component, size, cohesion (share of possible pairs that are linked), members (sorted) of the undirected active graph."""
    links = as_of(relations, at, relation_type).select(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b")).distinct()
    links = checkpointed(links)
    of = components(links)
    pairs = links.where("a <> b").join(of, links["a"] == of["node"]).groupBy("component").agg(F.count("*").alias("pairs"))
    groups = of.groupBy("component").agg(F.count("*").alias("size"), F.array_sort(F.collect_list("node")).alias("members")).where(F.col("size") >= least)
    possible = F.col("size") * (F.col("size") - 1) / 2
    out = groups.join(pairs, "component", "left").withColumn("cohesion", F.when(F.col("size") < 2, F.lit(0.0)).otherwise(F.coalesce("pairs", F.lit(0)) / possible))
    return out.select("component", "size", "cohesion", "members")


def ordered_clusters(found: DataFrame) -> DataFrame:
    """Clusters with place, from 1: the most cohesive first, equal ones in order of their components."""
    return numbered(found.withColumn("__least", -F.col("cohesion")), ["__least", "component"], "place").drop("__least")


def cluster_inferences(found: DataFrame) -> DataFrame:
    """inference_type, component, entity_ids, score, description of each cluster."""
    text = F.format_string("Cluster of %d entities with %.2f cohesion", "size", "cohesion")
    return found.select(F.lit("cluster").alias("inference_type"), "component", F.col("members").alias("entity_ids"), F.col("cohesion").alias("score"), text.alias("description"))


def predecessors(lineage: DataFrame) -> DataFrame:
    return lineage.where(F.col("lineage_type").isin("derived_from", "split_from")).select("entity_id", F.col("related_id").alias("predecessor"), "lineage_type", "seq")


def successors(lineage: DataFrame) -> DataFrame:
    """entity_id, successor: merged_into of the subject, then supersedes where it is the related one."""
    into = lineage.where("lineage_type = 'merged_into'").select("entity_id", F.col("related_id").alias("successor"), "lineage_type", "seq")
    over = lineage.where("lineage_type = 'supersedes'").select(F.col("related_id").alias("entity_id"), F.col("entity_id").alias("successor"), "lineage_type", "seq")
    return into.unionByName(over)


def full_lineage(lineage: DataFrame) -> DataFrame:
    """Every record under its subject and again under its related entity."""
    one = lineage.select(F.col("entity_id").alias("of"), *lineage.columns)
    return one.unionByName(lineage.select(F.col("related_id").alias("of"), *lineage.columns))


def trace_ancestry(lineage: DataFrame, starts: DataFrame | None = None, max_depth: int = 10) -> DataFrame:
    """node, ancestor, distance, path over each entity's first predecessor."""
    first = predecessors(lineage).withColumn("neg", -F.col("seq"))
    up = last_by(first, ["entity_id"], ["neg"], ["predecessor"])
    return ascend(up.select(F.col("entity_id").alias("node"), F.col("predecessor").alias("parent")), starts, max_depth)
