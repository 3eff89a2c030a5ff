"""The ids must be those of an independent implementation of the same vocabulary, and decode to the same bytes."""

import hashlib
import random

import numpy as np
import pytest
from oracle import SF
from pyspark.sql import functions as F

from stemma.llm import bpe, catalog

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def vocabulary():
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return bpe.Vocabulary.read(f.read(), P.PATTERN)


@pytest.fixture(scope="module")
def plain(vocabulary):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={}).encode_ordinary


def test_query(spark, plain):
    want = set()
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = plain(r.text or "")
        want.add((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    got = [tuple(r) for r in catalog.op11_byte_bpe(spark, SF).collect()]
    assert len(got) == len(want) and set(got) == want


@pytest.mark.parametrize("shared", [0, 40, 1 << 18])
def test_hard_texts(spark, vocabulary, plain, shared):
    """White space of every kind, contractions, letters and numbers of new and old scripts, long pieces, null, empty and repeated rows."""
    rng = random.Random(5)
    odd = [*"'stllab12!? \n\t\r\x85  　é漢字кнаا١²Ⅷ😀́​", chr(0x1C89), chr(0x10D40), chr(0x31350), chr(0x888), chr(0xE000), chr(0x10FFFF)]
    rows = [(i, "".join(rng.choice(odd) for _ in range(rng.randint(0, 60)))) for i in range(400)]
    rows += [(1000, None), (1001, ""), (1002, "a" * 3000), (1003, "Ab9+/xQ" * 700), (1004, " " * 4000 + "x"), (1005, "漢字" * 400), (1006, "the cat's"), (1006, "the cat's"), (None, "no id")]
    docs = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, ids int").repartition(3)
    got = bpe.encode(docs, vocabulary, block_bytes=2000, shared=shared)
    back = bpe.decode(got, vocabulary).select("doc_id", "ids", F.col("decoded").cast("string").alias("text")).collect()
    assert sorted(((r.doc_id, list(r.ids), r.text) for r in back), key=repr) == sorted(((i, plain(t or ""), t or "") for i, t in rows), key=repr)


def test_heap_is_fold(spark, vocabulary, plain):
    rng = random.Random(2)
    words = ["".join(rng.choice("abehrstin ") for _ in range(rng.randint(2, 400))).replace(" ", "e") for _ in range(200)]
    assert [bpe.heap_merged(w.encode(), vocabulary.ranks) for w in words] == [plain(w) for w in words]


def test_decode_odd(spark, vocabulary):
    df = spark.createDataFrame([(1, [0, 1], "x"), (2, [], "x"), (3, None, "x"), (4, [60000, None, 0, -1], "x")], "k int, ids array<int>, decoded string")
    assert sorted((r.k, bytes(r.decoded)) for r in bpe.decode(df, vocabulary).collect()) == [(1, b'!"'), (2, b""), (3, b""), (4, b"!")]


def test_empty(spark, vocabulary):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.report(docs, vocabulary).count() == 0
