"""Trees at once against a plain walk."""

import random

import pytest

from stemma.operators import forest

AT = "2000-01-01 00:00:00"
EDGE = "seq long, parent_id string, child_id string, valid_from timestamp_ntz, valid_to timestamp_ntz"


def edges_of(spark, pairs):
    from datetime import datetime

    return spark.createDataFrame([(i, p, c, datetime(1999, 1, 1), None) for i, (p, c) in enumerate(pairs)], EDGE).repartition(3)


def shapes():
    rng = random.Random(1)
    yield "chain", [(f"n{i}", f"n{i + 1}") for i in range(70)]
    yield "star", [("top", f"n{i}") for i in range(300)]
    yield "random", [(f"n{rng.randrange(max(0, i - 8), i)}", f"n{i}") for i in range(1, 250)]
    yield "several", [(f"r{i % 5}", f"n{i}") for i in range(40)] + [(f"n{i}", f"m{i}") for i in range(0, 40, 3)]


def walk(pairs):
    kids, children = {}, set()
    for p, c in pairs:
        kids.setdefault(p, []).append(c)
        children.add(c)
    pre, post, out = [0], [0], {}

    def go(node, root, depth):
        pre[0] += 1
        mine = pre[0]
        size = 1 + sum(go(c, root, depth + 1) for c in kids.get(node, []))
        post[0] += 1
        out[node] = (root, depth, size, mine, post[0])
        return size

    for top in sorted({p for p, _ in pairs} - children):
        go(top, top, 0)
    return out, kids


@pytest.mark.parametrize("name, pairs", list(shapes()))
def test_tour_and_rollup(spark, name, pairs):
    want, kids = walk(pairs)
    edges = edges_of(spark, pairs)
    got = {r.node: (r.root, r.depth, r.size, r.pre, r.post) for r in forest.tour(forest.forest(edges, AT)).collect()}
    assert got == want
    if name == "star":
        return
    values = {n: float(i % 17) - 3 for i, n in enumerate(sorted(want)) if i % 5}
    obs = spark.createDataFrame([(i, "m", n, v) for i, (n, v) in enumerate(values.items())], "seq long, metric_id string, entity_id string, value double")

    def rolled(node):
        if node not in kids:
            v = values.get(node, 0.0)
            return v, v, v, v, v
        each = [rolled(c) for c in kids[node]]
        cols = list(zip(*each))
        return sum(cols[0]), sum(cols[1]) / len(each), max(cols[2]), min(cols[3]), each[-1][4]

    for r in forest.rollup_forest(edges, obs, "m", AT).collect():
        s, a, x, m, l = rolled(r.entity_id)
        assert (r.child_count, r.max, r.min, r["count"], r.latest) == (len(kids[r.entity_id]), x, m, len(kids[r.entity_id]), l)
        assert r.sum == pytest.approx(s) and r.avg == pytest.approx(a)


def test_cycle(spark):
    with pytest.raises(ValueError, match="cycle"):
        forest.tour(forest.forest(edges_of(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")]), AT))


def test_empty(spark):
    assert forest.tour(forest.forest(edges_of(spark, [("a", "b")]).limit(0), AT)).count() == 0


def test_small_totals_beside_large_ones(spark):
    """A tree's totals don't lose digits to the values of other trees."""
    edges = edges_of(spark, [("a", "a1"), ("a", "a2"), ("b", "b1"), ("b", "b2"), ("b2", "b3")])
    values = {"a1": 1e17, "a2": 3e17, "b1": 0.25, "b3": 0.5, "b2": 9.0}
    obs = spark.createDataFrame([(i, "m", n, v) for i, (n, v) in enumerate(values.items())], "seq long, metric_id string, entity_id string, value double")
    got = {r.entity_id: (r.sum, r.avg, r["latest"]) for r in forest.rollup_forest(edges, obs, "m", AT).collect()}
    assert got == {"a": (4e17, 2e17, 3e17), "b": (0.75, 0.375, 0.5), "b2": (0.5, 0.5, 0.5)}


def test_rollup_cycle(spark):
    obs = spark.createDataFrame([], "seq long, metric_id string, entity_id string, value double")
    with pytest.raises(ValueError, match="cycle"):
        forest.rollup_forest(edges_of(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")]), obs, "m", AT)
