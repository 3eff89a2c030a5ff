"""Near duplicates against brute force: all pairs of full sets."""

import random
import re

import numpy as np
import pytest
from oracle import SF
from pyspark.sql import functions as F

from stemma.llm import neardup
from stemma.llm.graph import components
from stemma.llm.shared import among, bitmap, without


def brute(rows, k, percent=80):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)) and 100 * len(a & b) >= percent * len(a | b):
                root[top(i)] = top(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[top(i)] = min(low.get(top(i), d), d)
    return sorted((d, len(s), low[top(i)], d == low[top(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets)))


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = sorted(tuple(r) for r in neardup.report(docs).collect())
    assert got == brute(rows, 2)


def chain(n, edit):
    """Texts each of which is near the next only."""
    words = [f"w{i}" for i in range(60)]
    out = []
    for i in range(n):
        out.append(" ".join(words))
        words = [*words[edit:], *[f"x{i}_{j}" for j in range(edit)]]
    return out


def test_chains_copies_and_odd_rows(spark):
    texts = chain(12, 6) + ["One  two\tTHREE"] * 5 + ["one two three", "", None, "   ", "solo", "SOLO", "solo other", "a b c d e f", "a b c d e f " * 4000]
    rows = list(enumerate(texts, 100))
    rows.append((3, texts[5]))
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, class string, root int")
    got = sorted(tuple(r) for r in neardup.report(docs).collect())
    assert got == brute(rows, 2)
    assert len({r[2] for r in got if r[1] == 59}) == 1


def test_repeated_rows_and_nulls(spark):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (None, "a b c d e f g"), (None, "lone text"), (2, ""), (2, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in neardup.report(docs).collect()), key=str)
    assert got == sorted([(1, 6, 1, True)] * 2 + [(None, 6, 1, False), (None, 1, None, True), (2, 0, 2, True), (2, 0, 2, True)], key=str)
    left = [tuple(r) for r in neardup.drop_copies(docs).collect()]
    assert sorted(left, key=str) == sorted([rows[0], rows[3], rows[4], rows[5]], key=str)


def test_stage_keeps_one_of_each_group(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = neardup.drop_copies(docs)
    assert got.schema == docs.schema
    assert sorted(r["doc_id"] for r in got.collect()) == [d for d, _, _, kept in brute(rows, 5) if kept]


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert neardup.report(docs).collect() == []
    assert neardup.drop_copies(docs).collect() == []


@pytest.mark.parametrize("n", [1, 2, 37])
def test_components_of_a_path(spark, n):
    links = spark.createDataFrame([(i + 1, i) for i in range(n)], "a long, b long")
    assert sorted(tuple(r) for r in components(links).collect()) == [(i, 0) for i in range(n + 1)]


def test_blocks_find_what_hubs_miss(spark):
    """A bucket of many classes in blocks of two: all links between components come out."""
    texts = chain(9, 6) + [f"other {i} " * 3 for i in range(4)]
    sets = [neardup.shingle_sets(neardup.pa.array([t]), 2)[0] for t in texts]
    rows = [(1, i, i, i != 0, len(texts), len(texts) - 1) for i in range(len(texts))]
    rows = spark.createDataFrame(rows, "bucket long, class long, root long, minor boolean, n long, minors long")
    own = spark.createDataFrame([(i, bytearray(neardup.packed(x))) for i, x in enumerate(sets)], "class long, shingles binary")
    got = {(min(r), max(r)) for r in map(tuple, neardup.block_links(rows, own, 80, block=2).collect())}
    size = lambda a, b: (len(set(sets[a].tolist()) & set(sets[b].tolist())), len(set(sets[a].tolist()) | set(sets[b].tolist())))
    want = {(i, j) for j in range(len(texts)) for i in range(j) if 100 * size(i, j)[0] >= 80 * size(i, j)[1]}
    assert got == want and len(want) >= 8


def test_a_full_bitmap_only_lets_more_through(spark):
    rows = spark.range(5000)
    for most in (1 << 12, 1 << 20):
        bits = bitmap(rows.where("id % 7 = 0"), F.col("id"), most)
        assert bits[0].count() <= most // 64
        got = {r["id"] for r in among(rows, F.col("id"), bits).collect()}
        assert set(range(0, 5000, 7)) <= got and (most < 1 << 13 or len(got) < 1200)


def test_without_under_clashing_names(spark):
    rows = [(1, "a", 5, 7), (1, "b", 5, 7), (None, "a", 5, 7), (None, None, 5, 7), (2, "", 5, 7)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, mark int, __may int")
    gone = spark.createDataFrame(rows[1:2] + rows[3:4], docs.schema).select("doc_id", F.xxhash64("text").alias("mark"))
    got = without(docs, gone)
    assert got.schema == docs.schema and sorted(map(tuple, got.collect()), key=str) == sorted(rows[:1] + rows[2:3] + rows[4:], key=str)


def test_small_sets_always_meet():
    rng = random.Random(8)
    pairs = []
    for n in range(2, neardup.SMALL + 1):
        for _ in range(400):
            words = rng.sample(range(1, 2**62), n + 8)
            gone = rng.randint(0, n - 1)
            new = rng.randint(0, 4)
            a, b = set(words[:n]), set(words[gone : n + new]) if rng.random() < 0.5 else set(words[: n - gone] + words[n : n + new])
            if a != b and b and len(b) <= neardup.SMALL and 100 * len(a & b) >= 80 * len(a | b):
                pairs.append((a, b))
    assert len(pairs) > 500 and {len(a) for a, _ in pairs} >= set(range(4, neardup.SMALL + 1))
    sets = [np.array(sorted(s), np.uint64) for p in pairs for s in p]
    found = neardup.small_buckets(sets, 80)
    assert all(set(found[2 * i].tolist()) & set(found[2 * i + 1].tolist()) for i in range(len(pairs)))
    assert neardup.small_buckets([np.arange(n, dtype=np.uint64) for n in (0, 1, 2, 20)], 80) == {}


def test_many_small_texts(spark):
    rng = random.Random(9)
    base = [[f"w{rng.randint(0, 300)}" for _ in range(rng.randint(1, 22))] for _ in range(150)]
    texts = [*base, *base[:20]]
    for w in base:
        for _ in range(3):
            own = list(w)
            if rng.random() < 0.5:
                own.append(f"x{rng.randint(0, 5)}")
            else:
                own[rng.choice((0, -1))] = f"y{rng.randint(0, 5)}"
            texts.append(own)
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in neardup.report(docs).collect()) == brute(rows, 2)
