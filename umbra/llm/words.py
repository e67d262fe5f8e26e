"""Words of whole texts as numpy arrays, straight from Arrow buffers.

Texts never become Python strings: a batch's UTF-8 bytes are classified by a table, word borders are where the
class changes, and each word gets a 64-bit hash (a polynomial over random byte codes, then a mixer). Null texts
count as empty. Work goes in chunks of about CHUNK bytes that hold whole texts, so memory stays bounded by the
chunk or by one very long text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_malloc_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
CHUNK = 2 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words [^\x20\x09-\x0D]+
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: Words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of lower-cased text: digits, a-z and all beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_rng = np.random.Generator(np.random.PCG64(20240229))
_CODES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    """The first n powers of the hash's base, modulo 2**64."""
    global _powers
    if len(_powers) < n:
        out = np.full(max(n, 256), _BASE, dtype=np.uint64)
        out[0] = 1
        _powers = np.multiply.accumulate(out)
    return _powers


@dataclass
class Words:
    """Words of consecutive texts: word i of text t has bounds[t] <= i < bounds[t + 1]."""

    data: np.ndarray  # the texts' bytes, lower-cased if asked for
    offsets: np.ndarray  # texts' byte borders in data
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    bounds: np.ndarray
    first: int  # index of the first text in its batch

    def text_of_words(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    _, at, data = texts.buffers()
    offsets = np.frombuffer(at, dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw, offsets


def span_hashes(data: np.ndarray, inside: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Hash of each span data[starts[i] : starts[i] + lengths[i]]; bytes between spans aren't inside."""
    n, begin = len(data), int(starts[0])
    power = powers(int(lengths.max()) + 1)
    place = np.arange(begin, n) - np.repeat(starts, np.diff(np.append(starts, n)))
    np.minimum(place, len(power) - 1, out=place)
    codes = _CODES[data[begin:]] * power[place]
    codes[~inside[begin:]] = 0
    return mix(np.add.reduceat(codes, starts - begin) ^ (lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def tokenize(raw: np.ndarray, offsets: np.ndarray, word: np.ndarray, lower: bool = True, first: int = 0) -> Words:
    """The words of the texts raw[offsets[t]:offsets[t + 1]]; word is SPACED or ALNUM."""
    low = offsets[0]
    offsets = offsets - low
    n = int(offsets[-1])
    data = raw[low : low + n]
    if lower:
        data = LOWER[data]
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return Words(data, offsets, none, none, np.zeros(0, dtype=np.uint64), np.zeros(len(offsets), dtype=np.int64), first)
    inside = word[data]
    edge = np.zeros(n + 1, dtype=bool)  # a text begins here
    edge[offsets] = True
    before = np.zeros(n, dtype=bool)
    before[1:] = inside[:-1]
    after = np.zeros(n, dtype=bool)
    after[:-1] = inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    bounds = np.searchsorted(starts, offsets)
    if not len(starts):
        return Words(data, offsets, starts, ends, np.zeros(0, dtype=np.uint64), bounds, first)
    hashes = span_hashes(data, inside, starts, ends - starts)
    return Words(data, offsets, starts, ends, hashes, bounds, first)


def chunks(texts: pa.Array, size: int = CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(bytes, offsets, index of the first text) of runs of whole texts, each of about size bytes or one text."""
    raw, offsets = buffers(texts)
    t, n = 0, len(offsets) - 1
    while t < n:
        end = int(np.searchsorted(offsets, offsets[t] + size, side="right")) - 1
        end = min(max(end, t + 1), n)
        yield raw, offsets[t : end + 1], t
        t = end


def trim() -> None:
    """Give freed memory back, which a worker that lives on would keep: Arrow's and the C library's."""
    pa.default_memory_pool().release_unused()
    if _malloc_trim:
        _malloc_trim(0)


def words(texts: pa.Array, word: np.ndarray, lower: bool = True, size: int = CHUNK) -> Iterator[Words]:
    """Words of a batch of texts, chunk by chunk."""
    for raw, offsets, first in chunks(texts, size):
        yield tokenize(raw, offsets, word, lower, first)
    if texts.nbytes > size:
        trim()


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive words; the last k - 1 places have none."""
    n = max(0, len(hashes) - k + 1)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        out = out * np.uint64(0xA0761D6478BD642F) + hashes[j : j + n]
    return mix(out)
