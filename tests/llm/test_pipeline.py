"""The pipeline's run() against a plain version of its five stages."""

import re
import struct
from hashlib import sha256

from oracle import SF
from test_neardup import brute
from test_secrets import base_spans

import corpus_pipeline
from stemma.llm import language


def grams(text):
    letters = re.sub(r"[^\w]|[\d_]", " ", text.lower())
    letters = "".join(c if c.isalpha() else " " for c in text.lower())
    padded = re.sub(" +", " ", f" {letters} ")
    return [padded[i : i + n] for n in (1, 2, 3) for i in range(len(padded) - n + 1) if padded[i : i + n] != " "]


def test_gram_codes():
    for text in ("Ab, cé!", "x", "  ß-ß ", "日本 go", "1 2 3", ""):
        own = [c for c in language.gram_codes(text).tolist()]
        want = [] if not any(c.isalpha() for c in text) else [sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g)) for g in grams(text)]
        assert own == want


def test_run(spark):
    docs = [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    bench = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = [d for d in docs if d["text"] and any(c.isalpha() for c in d["text"])]
    stay = {d for d, _, _, kept in brute([(d["doc_id"], d["text"]) for d in docs], 5) if kept}
    docs = [d for d in docs if d["doc_id"] in stay]

    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    windows = set()
    for t in bench:
        w = words(t)
        windows |= {tuple(w[i : i + 13]) for i in range(max(1, len(w) - 12))} if w else set()
    sizes = {len(w) for w in windows}
    clean = []
    for d in docs:
        w = words(d["text"])
        hit = {j for n in sizes for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in windows for j in range(i, i + n)}
        if not (hit and 20 * len(hit) >= len(w)):
            clean.append(d)
    assert len(clean) < len(docs)
    out = [r.asDict() for r in corpus_pipeline.run(spark, SF).collect()]
    assert {r["doc_id"] for r in out} <= {d["doc_id"] for d in clean}
    text = {d["doc_id"]: d["text"] for d in clean}
    for r in out:
        spans = sorted((a, b) for k, a, b in base_spans(text[r["doc_id"]]))
        assert len(re.findall(r"\[SECRET\]", r["text"])) >= bool(spans)
        assert not base_spans(r["text"]) and r["n_chars"] == len(r["text"])
        if "[SECRET]" not in r["text"]:
            assert r["text"] == text[r["doc_id"]]
    # The mix: each document as often as its source's rate and its hash say, by the texts after redaction.
    before = corpus_pipeline.secret_scans(spark, spark.createDataFrame([(d["doc_id"], d["text"], d["lang"], d["source"], d["n_chars"]) for d in clean], "doc_id long, text string, lang string, source string, n_chars long"), SF)
    rows = {r["doc_id"]: (r["source"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))) for r in before.collect()}
    total = {}
    for s, n in rows.values():
        total[s] = total.get(s, 0) + n
    names = sorted(total)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    goal, left, open_ = {}, 1.5 * sum(total.values()), set(names)
    while True:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if 2 * total[s] < weight[s] * level}
        if not full:
            break
        goal |= {s: 2.0 * total[s] for s in full}
        left -= sum(goal[s] for s in full)
        open_ -= full
    goal |= {s: weight[s] * level for s in open_}
    rate = {s: goal[s] / total[s] for s in names}

    def extra(d, k):
        u = struct.unpack(">I", sha256(f"{d}:mix{k // 8}".encode()).digest()[k % 8 * 4 :][:4])[0] / 2**32
        return u < rate[rows[d][0]] % 1

    seed = {}
    for s in names:
        mine = [(d, n) for d, (x, n) in rows.items() if x == s]
        seed[s] = min(range(16), key=lambda k: abs(int(rate[s]) * total[s] + sum(n for d, n in mine if extra(d, k)) - goal[s]))
    want = {d: int(rate[s]) + extra(d, seed[s]) for d, (s, _) in rows.items()}
    got = {}
    for r in out:
        got.setdefault(r["doc_id"], []).append(r["mix_copy"])
    assert {d: sorted(c) for d, c in got.items()} == {d: list(range(1, n + 1)) for d, n in want.items() if n}
