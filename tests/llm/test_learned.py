"""Toxicity, quality and language: held-out accuracy, plain versions of their parts, and odd tables."""

import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stemma.llm import catalog, language, quality, toxicity

SMALL = "/root/testdata/sf0.01"


def joined(spark, name, column):
    got = catalog.queries()[name](spark, SMALL)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert got.count() == docs.count()
    other = spark.read.parquet(f"{SMALL}/labels.parquet") if column != "lang" else docs
    return got.join(other.select("doc_id", column), "doc_id").collect()


def test_toxicity(spark):
    rows = joined(spark, "op1_toxicity", "toxic")
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["predicted"] for r in held if not r["toxic"]) <= 2 and sum(r["predicted"] for r in held if r["toxic"]) >= sum(r["toxic"] for r in held) / 2


def test_quality(spark):
    rows = joined(spark, "op3_quality_classifier", "quality")
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["predicted"] == r["quality"] for r in held]) > 0.96
    assert np.mean([r["predicted"] for r in held if r["quality"]]) > 0.98


def test_language(spark):
    rows = joined(spark, "op9_language_id", "lang")
    assert np.mean([r["lang_pred"] == r["lang"] for r in rows if r["held_out"]]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_features():
    found, first = toxicity.features(pa.array(["One two-three", None, "", "One", "é"]))
    assert np.diff(first).tolist() == [3 + 3 * 0 + 2 + 1 + 1, 0, 0, 1, 1]
    assert found[0] == found[first[3]]


def test_ftrl_against_loop():
    rng = np.random.default_rng(2)
    data = [(np.unique(rng.integers(0, 9, 4)).tolist() + [9], int(rng.integers(0, 2))) for _ in range(60)]
    z, n = [0.0] * 10, [0.0] * 10
    a, b, l1, l2 = 0.5, 1.0, 0.4, 1.0
    model = toxicity.Ftrl(9, a, b, l1, l2)

    def w(i):
        one = 0.0 if i == 9 else l1
        return 0.0 if abs(z[i]) <= one else -(z[i] - math.copysign(one, z[i])) / ((b + math.sqrt(n[i])) / a + l2)

    for x, y in data:
        ws = {i: w(i) for i in x}
        g = 1 / (1 + math.exp(-sum(ws.values()))) - y
        for i in x:
            s = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / a
            z[i] += g - s * ws[i]
            n[i] += g * g
        model.learn(np.array(x), y)
    assert model.weights(np.arange(10)) == pytest.approx([w(i) for i in range(10)])


@pytest.mark.parametrize("stride", [quality.STRIDE, 1, 2])
def test_marginals_against_all_paths(monkeypatch, stride):
    monkeypatch.setattr(quality, "STRIDE", stride)
    rng = np.random.default_rng(4)
    first = np.array([0, 3, 3, 4, 9])
    scores, switch = rng.normal(size=9), rng.normal(size=(2, 2))
    bad, pairs, total = quality.marginals(scores, first, switch)
    want, edges, logs = np.zeros(9), np.zeros((2, 2)), 0.0
    for a, b in zip(first[:-1], first[1:]):
        paths = list(itertools.product((0, 1), repeat=b - a))
        weight = np.array([math.exp(sum(scores[a + i] * s for i, s in enumerate(p)) + sum(switch[x, y] for x, y in zip(p, p[1:]))) for p in paths])
        logs += math.log(weight.sum())
        for p, v in zip(paths, weight / weight.sum()):
            want[a:b] += v * np.array(p)
            for x, y in zip(p, p[1:]):
                edges[x, y] += v
    assert bad == pytest.approx(want) and pairs == pytest.approx(edges) and total == pytest.approx(logs)


def test_marginals_of_a_very_long_text():
    rng = np.random.default_rng(6)
    scores, switch = rng.normal(size=3 * quality.STRIDE + 5), rng.normal(size=(2, 2))
    first = np.array([0, 7, len(scores)])
    bad = quality.marginals(scores, first, switch)[0]
    for a, b in zip(first[:-1], first[1:]):
        states = [np.array([0.0, scores[a]])]
        for t in range(a + 1, b):
            states.append(np.array([0.0, scores[t]]) + np.logaddexp(states[-1][0] + switch[0], states[-1][1] + switch[1]))
        ahead, want = np.zeros(2), []
        for t in range(b - 1, a - 1, -1):
            both = states[t - a] + ahead
            want.append(math.exp(both[1] - np.logaddexp(*both)))
            ahead = np.logaddexp(switch[:, 0] + ahead[0], switch[:, 1] + scores[t] + ahead[1])
        assert bad[a:b] == pytest.approx(want[::-1])
    assert quality.apply_model({"w": rng.normal(size=3 * quality.NAMES + 1).tolist(), "switch": [1, 0, 0, 1], "curve": [-3, -1, 0, 2]}, pa.array(["a line\n" * 400_000])).shape == (1,)


def test_line_features_do_not_cross_texts():
    texts = ["one two\n\nTHREE!! THREE!!\n", None, "", "x | y | z", "a a a a\nb"]
    x, size, first = quality.line_features(pa.array(texts))
    assert np.diff(first).tolist() == [2, 0, 0, 1, 2]
    for i, t in enumerate(texts):
        own, own_size, _ = quality.line_features(pa.array([t], pa.string()))
        assert own == pytest.approx(x[first[i] : first[i + 1]]) and own_size.tolist() == size[first[i] : first[i + 1]].tolist()


def test_out_of_place_against_dictionaries():
    texts = {"aa": "the cat and the hat and that", "bb": "der hund und die katze und das haus", "cc": "ñandú año niño"}
    grams = lambda t: Counter(language.gram_codes(t).tolist())
    ranked = lambda t, size: [g for g, _ in sorted(grams(t).items(), key=lambda x: (-x[1], x[0]))][:size]
    for size in (5, 20, 400):
        profiles = {k: language.profile(language.gram_codes(t), size=size).tolist() for k, t in texts.items()}
        assert profiles == {k: ranked(t, size) for k, t in texts.items()}
        for t in [*texts.values(), "and", "zzz qqq", "Niño!"]:
            mine = ranked(t, size)
            apart = {k: sum(abs(i - p.index(g)) if g in p else size for i, g in enumerate(mine)) for k, p in profiles.items()}
            best = min(sorted(apart), key=apart.get)
            assert language.Judge(profiles, size)(t) == (best, pytest.approx(1 - apart[best] / (size * len(mine))))


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, "en", 1.0), (2, "", "en", 1.0), (3, "12 !!", None, 1.0), (4, "word " * 40_000, "en", 1.0), (None, "hello you", "en", 1.0), (4, "word " * 40_000, "en", 1.0)], "doc_id long, text string, lang string, score double")
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    some = spark.createDataFrame([(1, None, 1), (4, 1, 0), (4, 1, 0), (9, 0, 1), (2, 0, 1)], "doc_id long, toxic int, quality int")
    yes = F.lit(True)
    for labels in (none, some):
        assert toxicity.score(docs, toxicity.fit(docs, labels, yes)).count() == 6
        scores = quality.score(docs, quality.fit(docs, labels, yes)).collect()
        assert len(scores) == 6 and all(0 <= r["score"] <= 1 for r in scores)
    found = {r["doc_id"]: r["lang_pred"] for r in language.identify(docs, language.fit(docs, yes)).collect()}
    assert found == {1: "und", 2: "und", 3: "und", 4: "en", None: "en"}
    assert {r["lang_pred"] for r in language.identify(docs, {}).collect()} == {"und"}
    kept = language.keep_identified(docs, language.fit(docs, yes))
    assert kept.schema == docs.schema and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 4, 4]
    empty = docs.limit(0)
    assert language.identify(empty, language.fit(empty, yes)).collect() == [] and toxicity.score(empty, toxicity.fit(empty, some, yes)).collect() == []
    assert quality.score(empty, quality.fit(empty, some, yes)).collect() == []


def test_stage_drops_what_is_in_no_language(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang")
    odd = [(-1, "これは日本語の文章です" * 20, None), (-2, "", "en"), (-3, None, "en"), (-4, "12 34", "en")]
    rows = docs.union(spark.createDataFrame(odd, docs.schema))
    profiles = language.fit(docs, F.lit(True))
    kept = language.keep_identified(rows, profiles)
    assert kept.schema == rows.schema
    lang = {r["doc_id"]: r["lang"] for r in kept.collect()}
    assert set(lang) == {r["doc_id"] for r in docs.collect()}
    want = {r["doc_id"]: r["lang_pred"] for r in language.identify(rows, profiles).collect()}
    assert lang == {k: want[k] for k in lang}
    only = language.keep_identified(rows, profiles, ["fr"])
    assert {r["doc_id"] for r in only.collect()} == {k for k, v in lang.items() if v == "fr"}
