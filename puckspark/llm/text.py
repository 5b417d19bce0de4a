"""Words and word-window hashes of whole texts, computed over byte arrays.

A word is a run of bytes other than space and 0x09-0x0D; A-Z count as a-z. Texts are cut
into chunks of whole documents, so memory follows the chunk size or the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
SHINGLE_WORDS = 5

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
PUNCTUATION = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])
_ODD = np.uint64(0x9E3779B97F4A7C15)
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = _BYTE[_LOWER]  # a capital hashes like its small letter


def lowered(raw: np.ndarray) -> np.ndarray:
    """Bytes with A-Z as a-z."""
    return _LOWER[raw]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    """1, m, m^2, ... modulo 2^64 for an odd m."""
    out = np.full(max(n, 1), _ODD)
    out[0] = 1
    return np.multiply.accumulate(out)


def byte_chunks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row offsets) of consecutive rows; null counts as empty."""
    texts = texts.fill_null("")
    if len(texts) == 0:
        return
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset: texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + CHUNK_BYTES, "right")) - 1)
        yield first, raw[ends[first]: ends[last]], ends[first: last + 1] - ends[first]
        first = last


def word_spans(raw: np.ndarray, rows: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the number of words before each row's end (with a leading 0);
    ``gap`` tells for every byte whether it separates words."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(rows), np.int64)
    inside = ~gap[raw]
    edge = np.zeros(len(raw) + 1, dtype=bool)
    edge[rows] = True  # words end with their row
    before = np.concatenate(([False], inside[:-1])) & ~edge[:-1]
    starts = np.flatnonzero(inside & ~before)
    after = np.concatenate((inside[1:], [False])) & ~edge[1:]
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, rows)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, prefixes: tuple[int, ...] = ()) -> list[np.ndarray]:
    """64-bit hashes of all words, then of their first bytes for each length in ``prefixes`` (a shorter word whole)."""
    if not len(starts):
        return [np.zeros(0, np.uint64)] * (1 + len(prefixes))
    length = ends - starts
    step = powers(int(length.max()) + 1)
    first = starts[0]
    body = raw[first: ends[-1]]
    place = np.arange(first, ends[-1]) - np.repeat(starts, np.diff(np.append(starts, ends[-1])))
    upto = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[body] * step[np.minimum(place, len(step) - 1)])))
    out = [mix(upto[ends - first] - upto[starts - first] + length.astype(np.uint64))]
    for k in prefixes:
        part = upto[np.minimum(starts + k, ends) - first] - upto[starts - first]
        out.append(mix(part + np.uint64(k * int(_ODD) % 2**64)))
    return out


def window_hashes(words: np.ndarray, size: int = SHINGLE_WORDS) -> np.ndarray:
    """Distinct hashes, ascending, of the windows of ``size`` words of one document; a shorter
    document is one window, a document without words has none."""
    if not len(words):
        return words
    if len(words) < size:
        return mix((words * powers(len(words))).sum(keepdims=True) + np.uint64(len(words) * int(_ODD) % 2**64))
    total, weight = np.zeros(len(words) - size + 1, np.uint64), powers(size)
    for k in range(size):
        total += words[k: len(words) - size + 1 + k] * weight[k]
    return np.unique(mix(total + np.uint64(size * int(_ODD) % 2**64)))


def document_words(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, word hashes) of every row."""
    for first, raw, rows in byte_chunks(texts):
        starts, ends, upto = word_spans(raw, rows)
        hashes = word_hashes(raw, starts, ends)[0]
        for i in range(len(rows) - 1):
            yield first + i, hashes[upto[i]: upto[i + 1]]
