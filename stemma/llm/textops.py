"""Vectorised tokenising and hashing on Arrow text buffers.

Texts are handled as UTF-8 bytes. Lower-casing touches A-Z only, and both word
definitions used here treat every byte above 0x7F as a word byte, so working on
bytes gives the same words as working on code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 18

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of words `[^\x20\x09-\x0D]+`.
GRAPHIC = np.ones(256, bool)
GRAPHIC[[32, 9, 10, 11, 12, 13]] = False

#: Bytes of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`.
ALNUM = np.ones(256, bool)
ALNUM[:128] = False
ALNUM[48:58] = True
ALNUM[97:123] = True

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.concatenate(([np.uint64(1)], np.multiply.accumulate(np.full(4095, _BASE, np.uint64))))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offsets of each; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    column = column.cast(pa.large_binary())
    _, where, what = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(what, np.uint8) if what is not None and what.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches into slices of about ``limit`` bytes of text, so memory stays bounded."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = buffers(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
            end = min(max(end, at + 1), batch.num_rows)
            yield batch.slice(at, end - at)
            at = end


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and for each text the number of its first word (one more entry at the end)."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = kind[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    before &= ~edge[:n]
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after &= ~edge[1:]
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sizes = ends - starts
    most = int(sizes.max())
    powers = _POWERS if most <= len(_POWERS) else np.concatenate(([np.uint64(1)], np.multiply.accumulate(np.full(most, _BASE, np.uint64))))
    # From each word's start to the next one's; bytes between words count as 0 through their place.
    inside = data[starts[0] : ends[-1]]
    spans = np.diff(starts, append=ends[-1])
    place = np.arange(len(inside), dtype=np.int32) - np.repeat((starts - starts[0]).astype(np.int32), spans)
    place[place >= np.repeat(sizes.astype(np.int32), spans)] = len(powers)
    terms = _BYTE[inside] * np.append(powers, np.uint64(0))[place]
    return mix(np.add.reduceat(terms, starts - starts[0]) + sizes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def hashed_words(column: pa.Array, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all texts, and each text's first word."""
    data, offsets = buffers(column)
    data = LOWER[data]
    starts, ends, first = words(data, offsets, kind)
    return word_hashes(data, starts, ends), first


def chained(hashes: list[np.ndarray]) -> np.ndarray:
    """One hash for each row of equally long columns of hashes; order counts."""
    out = hashes[0]
    for h in hashes[1:]:
        out = mix(out * np.uint64(0xA24BAED4963EE407) + h)
    return out


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of seven bits, the lowest first, the last one of a value below 128; and how many bytes each value takes."""
    sizes = np.ones(len(values), np.int64)
    for bits in (7, 14, 21, 28):
        sizes += values >= 1 << bits
    ends = np.cumsum(sizes)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for i in range(int(sizes.max(initial=0))):
        has = sizes > i
        out[(ends - sizes)[has] + i] = ((values[has] >> (7 * i)) & 127) | np.where(sizes[has] > i + 1, 128, 0)
    return out, sizes


def unpack(data: np.ndarray) -> np.ndarray:
    if not len(data):
        return np.zeros(0, np.int64)
    last = np.flatnonzero(data < 128)
    first = np.concatenate(([0], last[:-1] + 1))
    place = np.arange(len(data)) - np.repeat(first, last - first + 1)
    return np.add.reduceat((data & 127).astype(np.int64) << (7 * place), first)
