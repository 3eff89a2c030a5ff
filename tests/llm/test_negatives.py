"""Held against a plain version on made-up vectors, and against SQL on the given table."""

import random

import numpy as np
import pytest
from oracle import SF, assert_same
from pyspark.sql import functions as F

from stemma.llm import catalog, negatives

SCHEMA = "vec_id long, label int, embedding array<float>, rank string"


def plain(rows, k=5, low=80, high=100):
    use = [(i, (label + 1) % 10 if i % 7 == 0 else label, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, label, v, *_ in rows if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a, label, v in sorted({i: min((r for r in use if r[0] == i), key=lambda r: r[1:]) for i, *_ in use if i % 100 == 0}.values()):
        pos = sorted((-dot(v, w), i) for i, other, w in use if other == label and i != a)[:5]
        neg = sorted((-dot(v, w), i) for i, other, w in use if other != label)
        for p, i in pos:
            found = [(-s, n) for s, n in neg if low * -p <= 100 * -s <= high * -p][:k]
            out += [(a, i, r + 1, n, -p, s) for r, (s, n) in enumerate(found)]
    return sorted(out)


def mined(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = negatives.report(df) if not options else negatives.mine(df, F.col("vec_id") % 100 == 0, F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END"), **options)
    return sorted(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in got.collect())


def rows_of(seed, n=900, dims=6):
    rng = random.Random(seed)
    return [(i, rng.randrange(4), [rng.gauss(0.3, 0.3) for _ in range(dims)], "x") for i in range(n)]


def test_sql(spark):
    assert assert_same(catalog.op12_hard_negatives(spark, SF), negatives.ORACLE) > 50


@pytest.mark.parametrize("cells", [1, 4])
def test_plain(spark, monkeypatch, cells):
    monkeypatch.setattr(negatives, "ROWS", 1000 // cells)
    monkeypatch.setattr(negatives, "ANCHORS", 6 // cells)
    rows = rows_of(1)
    want = plain(rows)
    assert len(want) > 100 and mined(spark, rows) == want


def test_copies(spark, monkeypatch):
    """A third of all rows is one vector, under different labels: ids alone decide, over many cells."""
    monkeypatch.setattr(negatives, "ROWS", 100)
    monkeypatch.setattr(negatives, "BITS", 3)
    rows = rows_of(2)
    hot = [0.5, 0.5, 0.5, 0.5, 0.5, 0.5]
    rows = [(i, label, hot if i % 3 == 0 else v, x) for i, label, v, x in rows]
    assert mined(spark, rows) == plain(rows)


def test_far_ids_and_large_components(spark):
    rng = random.Random(3)
    rows = [(i * 10**12 - 50 * 10**12, rng.randrange(2), [rng.choice([1e6, 2e6, 3e6]) for _ in range(4)], "x") for i in range(100)]
    assert mined(spark, rows) == plain(rows)


def test_odd_rows(spark):
    rows = rows_of(4, 300)
    rows += [(None, 1, [0.1] * 6, "x"), (1001, None, [0.1] * 6, "x"), (1002, 1, None, "x"), (1003, 1, [0.1, None], "x"), (1004, 1, [float("nan")], "x"), (1005, 1, [float("inf")], "x"), (1006, 1, [], "x"), (1007, 2, [0.9], "x")]
    rows += [rows[1]] * 20 + [rows[2]] * 3 + [rows[100]]  # repeated candidates, and a repeated anchor
    assert mined(spark, rows) == plain(rows)


def test_few(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(0, 1, [1.0], "x")]) == []
    assert mined(spark, [(0, 1, [1.0], "x"), (1, 1, [1.0], "x"), (2, 2, [0.9], "x"), (3, 2, [-1.0], "x")]) == plain([(0, 1, [1.0], "x"), (1, 1, [1.0], "x"), (2, 2, [0.9], "x")])


def test_other_window(spark):
    rows = rows_of(6, 500)
    got = mined(spark, rows, k=2, low=50, high=120)
    assert got == plain(rows, 2, 50, 120) and len(got) > 10
