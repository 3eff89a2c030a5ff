"""Held against SQL on the given tables and a plain version on made-up ones, with small blocks and segments."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from oracle import SF, assert_same

from stemma.llm import catalog, ranked
from stemma.llm.textops import pack, unpack

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k=10):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    n, total = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    asked: dict = {}
    for item, t in items:
        asked.setdefault(item, set()).update(terms(t))
    for item, ts in asked.items():
        scores = []
        for i, b in bags:
            s = 0
            for t in ts & b.keys():
                m = 10 + (90 * sum(b.values()) * n) // total
                s += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * b[t]) // (1000 * b[t] + 8 * m))
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def ranks(spark, docs, items, segment_bytes, block, k=10, items_a_block=256):
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, term string").repartition(2)
    q = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    n, total = ranked.totals(d)
    got = ranked.search(ranked.build_index(d, n, total, segment_bytes, block), q, n, total, k, items_a_block)
    return sorted((tuple(r) for r in got.collect()), key=repr)


def test_sql(spark):
    assert assert_same(catalog.op13_ranked_search(spark, SF), ranked.ORACLE) > 100


@pytest.mark.parametrize("segment_bytes, block, part", [(1 << 20, 128, 256), (3000, 4, 7), (500, 1, 100)])
def test_plain(spark, monkeypatch, segment_bytes, block, part):
    monkeypatch.setattr(ranked, "STRIDE", 2)
    rng = random.Random(block)
    vocabulary = [f"w{int(rng.paretovariate(0.7)) % 300}" for _ in range(400)]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 60)))) for i in range(400)]
    items = [(i, " ".join(rng.choices(vocabulary, k=12))) for i in range(20)]
    assert ranks(spark, docs, items, segment_bytes, block, 10, part) == plain(docs, items)


def test_ties_and_odd_rows(spark):
    """Copies tie and go by doc_id; null, empty and long texts, repeated rows and ids, letters beyond ASCII, unknown terms."""
    docs = [(i, "Alpha beta, gamma") for i in range(50, 0, -1)] + [(100, None), (101, ""), (102, "... !!"), (None, "alpha beta gamma"), (103, "ÉTÉ été Beta7"), (104, "alpha " * 20000), (105, "delta"), (105, "delta")]
    items = [(1, "ALPHA"), (2, "été delta"), (2, "beta7"), (3, "unknown"), (4, ""), (5, None), (None, "gamma delta")]
    assert ranks(spark, docs, items, 400, 3) == plain(docs, items)


def test_empty(spark):
    assert ranks(spark, [], [(1, "a")], 1000, 4) == []
    assert ranks(spark, [(1, "a b"), (2, "c")], [], 1000, 4) == []
    assert ranks(spark, [(1, None)], [(1, "a")], 1000, 4) == []


def test_bytes():
    values = np.array([0, 1, 127, 128, 16383, 16384, 2**21, 2**28 - 1, 2**28, 2**31])
    data, sizes = pack(values)
    assert list(unpack(data)) == list(values) and sizes.sum() == len(data)


def test_blocks_are_skipped():
    """A rare term in one document leaves the blocks of a frequent one closed, but for those in its range."""
    import pyarrow as pa

    n = 5000
    sizes = np.full(n, 100)
    docs = np.arange(n)
    rows = []
    for d, tf in ((docs, np.ones(n, np.int64)), (np.array([2500]), np.array([9]))):
        blocks = np.arange(0, len(d), 128)
        data, long = pack(np.stack([np.diff(d, prepend=0), tf], axis=1).ravel())
        begin = np.concatenate(([0], np.cumsum(long)[1::2][:-1]))
        rows.append({"firsts": d[blocks], "lasts": d[np.append(blocks[1:], len(d)) - 1], "most": np.maximum.reduceat(ranked.impact(tf, sizes[d], n, 100 * n), blocks), "starts": begin[blocks], "bytes": data.tobytes()})
    lists = ranked.Lists(pa.Table.from_pylist([{k: v if isinstance(v, bytes) else v.tolist() for k, v in r.items()} for r in rows]), sizes, n, 100 * n)
    found, scores = ranked.best(lists, [0, 1], [1, 8000], 1)
    assert list(found) == [2500] and len(lists.opened) < 20
