"""Bit-parallel reachability against breadth-first search from each root."""

import random
from collections import deque

import pytest

from stemma.operators import reach


def plain(edges, roots, most=None):
    out = {}
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
    for root in roots:
        far, queue = {root: 0}, deque([root])
        while queue:
            n = queue.popleft()
            if most is None or far[n] < most:
                for m in near.get(n, ()):
                    if m not in far:
                        far[m] = far[n] + 1
                        queue.append(m)
        out |= {(root, n): d for n, d in far.items() if n != root}
    return out


@pytest.mark.parametrize("most, n_roots", [(None, 150), (2, 70), (0, 5)])
def test_plain(spark, most, n_roots):
    """More roots than bits of one long, cycles, loops, repeated edges and roots that reach nothing."""
    rng = random.Random(n_roots)
    edges = [(f"n{rng.randrange(200)}", f"n{rng.randrange(200)}") for _ in range(260)] + [("n1", "n1"), (None, "n2"), ("n3", None)]
    edges += edges[:20]
    roots = [f"n{i}" for i in range(n_roots - 1)] + ["nowhere"]
    want = plain([e for e in edges if None not in e], roots, most)
    e = spark.createDataFrame(edges, "src string, dst string").repartition(3)
    layers, places = reach.reach(e, spark.createDataFrame([(r,) for r in [*roots, roots[0], None]], "root string"), most)
    got = [tuple(r) for r in reach.pairs(layers, places).collect()]
    assert len(got) == len(want) and {(a, b): d for a, b, d in got} == want
    assert layers.count() <= max(1, len({(n, d) for (_, n), d in want.items()}) * -(-len(roots) // 64))
    for r in reach.counts(layers, places).collect():
        mine = [d for (root, _), d in want.items() if root == r.root]
        assert (r.reached, r.farthest) == (len(mine), max(mine, default=0))


def test_empty(spark):
    e = spark.createDataFrame([("a", "b")], "src string, dst string")
    for edges, roots in ((e.limit(0), [("a",)]), (e, [("b",)])):
        layers, places = reach.reach(edges, spark.createDataFrame(roots, "root string"))
        assert layers.count() == 0 and [tuple(r) for r in reach.counts(layers, places).collect()] == [(roots[0][0], 0, 0)]
