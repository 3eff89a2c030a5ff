"""Telephony audio in media columns: G.711 and IMA ADPCM in WAV containers.

``store`` puts bytes into a media column as 8-bit mu-law or A-law samples, or as
ADPCM blocks of 64 bytes; ``read_back`` parses the containers again, computes
digests and features, expands any of the three to 16-bit PCM and brings it to
another rate, as PCM WAV. The rate is doubled by a four-point half-band filter; any
other is reached by linear interpolation, after smoothing if it is lower.

mu-law and A-law are expanded by lookup in tables of 256 samples. ADPCM decodes
all blocks of a slice side by side: 120 steps in time, each a few numpy
operations across blocks. Slices hold about 256 KB of text, so memory does not
grow with the table.

Nulls: a null text is the empty payload, stored as 64 zero bytes; a null doc_id
stays null. Repeated rows are stored each; equal texts give equal values, as no
value depends on anything but the text. Other columns are not looked at. A very
long text is a slice of its own, stored whole. An empty table gives empty results.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import TIGHT, discard, materialize
from .textops import buffers, slices

UNIT = 64
RATE = 8000
PCM_RATE = 4000

#: Fixed values of the WAV registry: format tags.
TAGS = {"pcm": 1, "alaw": 6, "mulaw": 7, "adpcm": 17}

#: Fixed values of the IMA ADPCM format: step sizes, and what a code adds to the step index.
STEPS = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143,
     157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552,
     1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487,
     12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767]
)
ADDS = np.array([-1, -1, -1, -1, 2, 4, 6, 8])


def _mulaw_table() -> np.ndarray:
    code = ~np.arange(256) & 0xFF
    size = (((code & 15) << 3) + 132 << (code >> 4 & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def _alaw_table() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    place, low = code >> 4 & 7, (code & 15) << 4
    size = np.where(place == 0, low + 8, (low + 264) << np.maximum(place - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


def _adpcm_tables() -> tuple[np.ndarray, np.ndarray]:
    """For index * 16 + code: the change of the sample, and the next index times 16."""
    step, code = STEPS[:, None], np.arange(16)[None, :]
    size = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
    after = np.clip(np.arange(len(STEPS))[:, None] + ADDS[code & 7], 0, len(STEPS) - 1)
    return np.where(code & 8, -size, size).astype(np.int32).ravel(), (after * 16).astype(np.int32).ravel()


MULAW, ALAW = _mulaw_table(), _alaw_table()
CHANGE, AFTER = _adpcm_tables()


def adpcm_blocks(data: np.ndarray) -> np.ndarray:
    """PCM of blocks of 64 bytes, 121 samples each: one row a block. An index out of range is clipped."""
    blocks = data.reshape(-1, UNIT)
    sample = blocks[:, :2].copy().view("<i2").ravel().astype(np.int32)
    index = np.minimum(blocks[:, 2], len(STEPS) - 1).astype(np.int32) * 16
    body = np.ascontiguousarray(blocks[:, 4:].T)
    out = np.empty((121, len(blocks)), np.int16)
    out[0] = sample
    for t in range(120):
        code = body[t >> 1] >> 4 if t & 1 else body[t >> 1] & 15
        at = index + code
        sample = np.clip(sample + CHANGE[at], -32768, 32767)
        index = AFTER[at]
        out[t + 1] = sample
    return np.ascontiguousarray(out.T)


def expand(data: np.ndarray, codec: str) -> np.ndarray:
    if codec == "mulaw":
        return MULAW[data]
    if codec == "alaw":
        return ALAW[data]
    if codec == "adpcm":
        return adpcm_blocks(data).ravel()
    return data.view("<i2")


def doubled(pcm: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Twice the rate: between neighbours a, b, c, d goes (-a + 9b + 9c - d) / 16, rounded; clips repeat their edge samples."""
    x = pcm.astype(np.int32)
    left, right, far = x.copy(), x.copy(), x.copy()
    left[1:] = x[:-1]
    left[starts] = x[starts]
    right[:-1] = x[1:]
    right[ends - 1] = x[ends - 1]
    far[:-1] = right[1:]
    far[ends - 1] = x[ends - 1]
    out = np.empty(2 * len(x), np.int16)
    out[::2] = pcm
    out[1::2] = np.clip((9 * (x + right) - left - far + 8) >> 4, -32768, 32767)
    return out


def resampled(pcm: np.ndarray, starts: np.ndarray, ends: np.ndarray, rate: int, to: int) -> tuple[np.ndarray, np.ndarray]:
    """The clips at the rate ``to``, one after the other, and where each starts (one more at the end); samples are rounded down."""
    if to == 2 * rate:
        return doubled(pcm, starts, ends), np.append(2 * starts, 2 * len(pcm))
    x = pcm.astype(np.int64)
    n = ends - starts
    place = np.arange(len(x)) - np.repeat(starts, n)
    last = np.repeat(n, n) - 1
    for _ in range(max(0, (rate // to).bit_length() - 1)):  # 1 2 1 for each halving; clips repeat their edge samples
        left = np.where(place > 0, np.roll(x, 1), x)
        right = np.where(place < last, np.roll(x, -1), x)
        x = (left + 2 * x + right) >> 2
    sizes = -(-n * to // rate)
    first = np.append(0, np.cumsum(sizes))
    at = (np.arange(int(first[-1])) - np.repeat(first[:-1], sizes)) * rate
    own, top = np.repeat(starts, sizes), np.repeat(ends - 1, sizes)
    low = own + at // to
    high = np.minimum(low + 1, top)
    return (x[low] + (x[high] - x[low]) * (at % to) // to).astype(np.int16), first


def container(data: bytes, codec: str, rate: int = RATE) -> bytes:
    """A WAV file of one channel."""
    tag = TAGS[codec]
    if codec == "pcm":
        head = struct.pack("<HHIIHH", tag, 1, rate, 2 * rate, 2, 16)
    elif codec == "adpcm":
        head = struct.pack("<HHIIHHHH", tag, 1, rate, rate * UNIT // 121, UNIT, 4, 2, 121)
    else:
        head = struct.pack("<HHIIHHH", tag, 1, rate, rate, 1, 8, 0)
    samples = len(data) // 2 if codec == "pcm" else len(data) // UNIT * 121 if codec == "adpcm" else len(data)
    parts = b"WAVEfmt " + struct.pack("<I", len(head)) + head + b"fact" + struct.pack("<II", 4, samples) + b"data" + struct.pack("<I", len(data)) + data
    return b"RIFF" + struct.pack("<I", len(parts)) + parts


def parsed(media: bytes) -> tuple[str, int, bytes]:
    """Codec, rate and data of a container; chunks may stand in any order."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV container")
    at, codec, rate, data = 12, None, 0, None
    while at + 8 <= len(media):
        name, (size,) = media[at : at + 4], struct.unpack_from("<I", media, at + 4)
        if name == b"fmt ":
            tag, _, rate = struct.unpack_from("<HHI", media, at + 8)
            codec = next(k for k, v in TAGS.items() if v == tag)
        elif name == b"data":
            data = media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    if codec is None or data is None:
        raise ValueError("a WAV container without format or data")
    return codec, rate, data


def store(docs: DataFrame, codec: str = "mulaw") -> DataFrame:
    """doc_id, n_bytes, media: the text's UTF-8 bytes, padded with zeros to a positive multiple of 64, in a container."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            data, offsets = buffers(part.column("text"))
            sizes = np.diff(offsets)
            raw, out = data.tobytes(), []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                out.append(container(raw[a:b] + bytes(max(-(b - a) % UNIT, UNIT * (a == b))), codec))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(out, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def _clips(part: pa.RecordBatch) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Codecs, all data in one array, and each clip's start and end there."""
    found = [parsed(x) for x in part.column("media").to_pylist()]
    sizes = np.array([len(x[2]) for x in found])
    ends = np.cumsum(sizes)
    return [x[0] for x in found], np.frombuffer(b"".join(x[2] for x in found), np.uint8), ends - sizes, ends


def _stats(pcm: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """Of each clip: the mean square, the peak and the number of sign changes."""
    x = pcm.astype(np.int64)
    sizes = np.diff(starts, append=len(x))
    turns = np.zeros(len(x), np.int64)
    turns[1:] = (x[1:] < 0) != (x[:-1] < 0)
    turns[starts] = 0
    return [np.add.reduceat(x * x, starts) // sizes, np.maximum.reduceat(np.abs(x), starts), np.add.reduceat(turns, starts)]


READ = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pcm binary"


def read_back(stored: DataFrame, rate: int = PCM_RATE) -> DataFrame:
    """Digests and features of what is stored, and each clip as 16-bit PCM WAV at another rate.

    The feature gives for the bytes taken as mu-law, as A-law and as ADPCM: mean
    square, peak and zero crossings of the expanded samples. pcm is of the clip's
    own codec.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "media_text"):
            codecs, data, starts, ends = _clips(part)
            own = {k: expand(data, k) for k in ("mulaw", "alaw", "adpcm")}
            at = {"mulaw": starts, "alaw": starts, "adpcm": starts // UNIT * 121}
            stats = {k: _stats(own[k], at[k]) for k in own}
            wide = {k: resampled(own[k], at[k], np.append(at[k][1:], len(own[k])), RATE, rate) for k in set(codecs)}
            media, raw = part.column("media").to_pylist(), data.tobytes()
            rows = []
            for i, (codec, a, b) in enumerate(zip(codecs, starts.tolist(), ends.tolist())):
                payload, (samples, first) = raw[a:b], wide[codec]
                pcm = container(samples[first[i] : first[i + 1]].tobytes(), "pcm", rate)
                feature = ";".join(f"{k}={','.join(str(int(s[i])) for s in stats[k])}" for k in stats)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media[i]), hashlib.sha256(media[i]).hexdigest(), feature, pcm))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), *columns], names=[x.split()[0] for x in READ.split(", ")])

    return _sliceable(stored, run, READ)


def report(docs: DataFrame, rate: int = PCM_RATE) -> DataFrame:
    """The digest columns of the contract of op2, with the length and hash of the PCM. The media column is written and
    read back, and so is the column of resampled PCM."""
    stored = materialize(store(docs), "media", options=TIGHT)
    found = materialize(read_back(stored, rate), "pcm", options=TIGHT)
    discard(stored)
    return found.select(*found.columns[:-1], F.octet_length("pcm").cast("long").alias("pcm_bytes"), F.sha2("pcm", 256).alias("pcm_sha256"))


def _sliceable(stored: DataFrame, run, schema: str) -> DataFrame:
    """Apply ``run`` to batches with the media's bytes under the name by which slices are cut."""

    def named(batches):
        return run(pa.RecordBatch.from_arrays([*b.columns, b.column("media")], names=[*b.schema.names, "media_text"]) for b in batches)

    return stored.mapInArrow(named, schema)
