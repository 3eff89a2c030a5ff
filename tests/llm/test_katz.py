"""Katz backoff against a plain version with dictionaries, and its distributions against 1."""

import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from oracle import SF
from pyspark.sql import functions as F

from stemma.llm import catalog, katz


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + ["</s>"]


def plain(rows, held):
    train = [words(t) for d, t in rows if not held(d)]
    one, two, ctx = Counter(), Counter(), Counter()
    for w in train:
        one.update(w)
        pairs = list(zip(["<s>", *w], w))
        two.update(pairs)
        ctx.update(a for a, _ in pairs)
    n, v = sum(one.values()), len(one)

    def factor(counts):
        times = Counter(counts.values())
        low, e = katz.discounts([times[r] for r in range(1, 9)])
        return lambda c: c * (low[c - 1] if c <= 5 else (1 + 1 / c) ** e)

    k1, k2 = factor(one), factor(two)
    unknown = 1 - sum(k1(c) for c in one.values()) / n if n else 1.0

    def p1(w):
        return k1(one[w]) / n if one[w] else unknown

    after = defaultdict(list)
    for (a, b), c in two.items():
        after[a].append((b, c))
    alpha = {a: (1 - sum(k2(c) for _, c in x) / ctx[a]) / (1 - sum(p1(b) for b, _ in x)) for a, x in after.items()}

    def p2(a, w):
        return k2(two[a, w]) / ctx[a] if two[a, w] else alpha.get(a, 1.0) * p1(w)

    for a in list(after)[:5]:
        assert abs(sum(p2(a, w) for w in [*one, "never seen"]) - 1) < 1e-9
    out = []
    for d, t in rows:
        w = words(t)
        base = sum(math.log10((one[x] + 1) / (n + v + 1)) for x in w)
        out.append((d, held(d), len(w), sum(one[x] > 0 for x in w), base, sum(math.log10(p2(a, x)) for a, x in zip(["<s>", *w], w))))
    return sorted(out), n


def same(got, want):
    assert [g[:4] for g in got] == [w[:4] for w in want]
    for g, w in zip(got, want):
        assert g[4] == pytest.approx(w[4], rel=1e-9, abs=1e-9) and g[5] == pytest.approx(w[5], rel=1e-7, abs=1e-7)


def test_whole_table(spark):
    want, n = plain([(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()], lambda d: zlib.crc32(str(d).encode()) % 7 == 2)
    got = catalog.op5_lm_scoring(spark, SF).collect()
    assert {r["train_tokens"] for r in got} == {n}
    same(sorted((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["base_score"], r["score"]) for r in got), want)
    assert sum(w[5] for w in want if w[1]) > sum(w[4] for w in want if w[1])


def test_small_chunks_and_odd_rows(spark):
    rows = [(i, t) for i, t in enumerate(["a b c a b", "A B c d", None, "", "x y z", "a b c a b", "q " * 3000, "a x never c", "b d"])]
    docs = spark.createDataFrame([(d, t, 7) for d, t in rows], "doc_id long, text string, n int").repartition(3)
    scores, model, m = katz.score(docs, F.col("doc_id") >= 7, chunk_bytes=20)
    want, n = plain(rows, lambda d: d >= 7)
    same(sorted(tuple(r) for r in scores.collect()), want)
    assert m.n == n == model.where("order = 1").select("stats").rdd.map(lambda r: r[0][1]).sum()


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    scores, _, _ = katz.score(docs, F.lit(True))
    assert sorted(tuple(r) for r in scores.collect()) == [(1, True, 3, 0, 0.0, 0.0), (2, True, 1, 0, 0.0, 0.0)]
    scores, _, _ = katz.score(docs.limit(0), F.lit(False))
    assert scores.collect() == []
