"""Media columns against plain versions: sample by sample, and exact round trips."""

import hashlib
import struct
import zlib

import numpy as np
from oracle import SF

from stemma.llm import catalog, media


def payload(text):
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % 64 or 64 * (not raw))


def plain_adpcm(block):
    sample, index = struct.unpack_from("<hB", block)
    index, out = min(index, 88), [sample]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(media.STEPS[index])
            move = step >> 3
            for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
                move += part if code & bit else 0
            sample = max(-32768, min(32767, sample - move if code & 8 else sample + move))
            index = max(0, min(88, index + int(media.ADDS[code & 7])))
            out.append(sample)
    return out


def test_tables():
    assert (media.MULAW[0], media.MULAW[127], media.MULAW[255], media.MULAW[128]) == (-32124, 0, 0, 32124)
    assert (media.ALAW[0x55], media.ALAW[0xD5], media.ALAW[0x2A], media.ALAW[0xAA]) == (-8, 8, -32256, 32256)
    assert len(set(media.ALAW.tolist())) == 256 and len(set(media.MULAW.tolist())) == 255


def test_adpcm_blocks():
    data = np.random.default_rng(1).integers(0, 256, 64 * 50, dtype=np.uint8)
    assert media.adpcm_blocks(data).tolist() == [plain_adpcm(data[i : i + 64].tobytes()) for i in range(0, len(data), 64)]


def test_doubled_stays_in_its_clip():
    pcm = np.array([100, 200, 300, 400, -5, 32767, -32768], np.int16)
    both = media.doubled(pcm, np.array([0, 4]), np.array([4, 7]))
    assert both.tolist() == media.doubled(pcm[:4], np.array([0]), np.array([4])).tolist() + media.doubled(pcm[4:], np.array([0]), np.array([3])).tolist()
    assert both[::2].tolist() == pcm.tolist()


def check(rows, got):
    assert len(got) == len(rows)
    texts = {}
    for d, t in rows:
        texts.setdefault(d, t)
    for r in got:
        raw = payload(texts[r["doc_id"]])
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len((texts[r["doc_id"]] or "").encode()), len(raw), hashlib.sha256(raw).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(raw[-64:]) and r["media_sha256"] == hashlib.sha256(media.container(raw, "mulaw")).hexdigest()
        kinds = dict(x.split("=") for x in r["feature"].split(";"))
        wave = {"mulaw": [int(media.MULAW[b]) for b in raw], "alaw": [int(media.ALAW[b]) for b in raw], "adpcm": [s for i in range(0, len(raw), 64) for s in plain_adpcm(raw[i : i + 64])]}
        for k, x in wave.items():
            assert kinds[k] == f"{sum(v * v for v in x) // len(x)},{max(map(abs, x))},{sum((a < 0) != (b < 0) for a, b in zip(x, x[1:]))}"


def test_whole_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check(rows, catalog.op2_media_columns(spark, SF).collect())


def test_odd_texts(spark):
    rows = [(1, None), (2, ""), (3, "x" * 64), (4, "é" * 33), (5, "long " * 60_000), (6, "\x00\x01"), (None, "no id"), (3, "x" * 64)]
    docs = spark.createDataFrame([(*r, b"m") for r in rows], "doc_id long, text string, media binary")
    check(rows, media.read_back(media.store(docs)).collect())
    assert media.read_back(media.store(docs.limit(0))).collect() == []


def test_all_codecs_round_trip(spark):
    docs = spark.createDataFrame([(1, "hello " * 50), (2, "é")], "doc_id long, text string")
    for codec in ("mulaw", "alaw", "adpcm"):
        stored = media.store(docs, codec)
        assert {r["doc_id"]: media.parsed(bytes(r["media"])) for r in stored.collect()} == {i: (codec, 8000, payload(t)) for i, t in ((1, "hello " * 50), (2, "é"))}
        for to in (4000, 6000, 11025, 16000):
            for r in media.read_back(stored, to).collect():
                raw = payload("hello " * 50 if r["doc_id"] == 1 else "é")
                kind, rate, data = media.parsed(bytes(r["pcm"]))
                assert (kind, rate) == ("pcm", to)
                assert np.frombuffer(data, "<i2").tolist() == plain_resampled(media.expand(np.frombuffer(raw, np.uint8), codec).tolist(), to)


def plain_resampled(x, to, rate=8000):
    if to == 2 * rate:
        return media.doubled(np.array(x, np.int16), np.array([0]), np.array([len(x)])).tolist()
    if to <= rate // 2:
        x = [(x[max(i - 1, 0)] + 2 * x[i] + x[min(i + 1, len(x) - 1)]) >> 2 for i in range(len(x))]
    out = []
    for i in range(-(-len(x) * to // rate)):
        low, part = divmod(i * rate, to)
        out.append(x[low] + (x[min(low + 1, len(x) - 1)] - x[low]) * part // to)
    return out


def test_resampled_stays_in_its_clip():
    rng = np.random.default_rng(2)
    sizes = np.array([1, 64, 7, 121, 2])
    ends = np.cumsum(sizes)
    pcm = rng.integers(-32768, 32768, ends[-1]).astype(np.int16)
    for to in (4000, 5000, 8000, 12000):
        got, first = media.resampled(pcm, ends - sizes, ends, 8000, to)
        assert [got[a:b].tolist() for a, b in zip(first[:-1], first[1:])] == [plain_resampled(pcm[b - n : b].tolist(), to) for n, b in zip(sizes, ends)]


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert media.report(empty).count() == 0
