"""Words of Arrow text columns as arrays: places and 64-bit hashes, computed on the UTF-8 bytes without per-row Python."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Text bytes worked on at a time; a longer text is a piece of its own.
PIECE = 2 << 20
#: Places of a word with table values of their own; values beyond are computed.
PLACES = 64
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers whose bits all depend on all bits (the finaliser of SplitMix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def space_bytes() -> np.ndarray:
    """Whether a byte is white space, by byte."""
    space = np.zeros(256, bool)
    space[[0x20, *range(0x09, 0x0E)]] = True
    return space


def byte_values(seed: int = 0) -> np.ndarray:
    """A random-looking value for each place in a word (the first PLACES of them) and byte; A-Z have the values of a-z."""
    value = mix(np.arange(1, PLACES * 256 + 1, dtype=np.uint64) * _STEP + np.uint64(seed)).reshape(PLACES, 256)
    value[:, 65:91] = value[:, 97:123]
    return value


def pieces(column: pa.Array, limit: int = PIECE):
    """(first row, bytes, offsets) for consecutive rows of a string column with about limit bytes; null is empty."""
    data = column.cast(pa.large_binary()).fill_null(b"")
    if not len(data):
        return
    offsets = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
    whole = np.frombuffer(data.buffers()[2], np.uint8) if data.buffers()[2] is not None and data.buffers()[2].size else np.zeros(0, np.uint8)
    row = 0
    while row < len(data):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, whole[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of the words: runs of bytes other than space and \\t to \\r, within a row."""
    inside = ~space_bytes()[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    full = offsets[:-1][offsets[1:] > offsets[:-1]]
    first[full] = inside[full]
    ends = offsets[1:][offsets[1:] > offsets[:-1]] - 1
    last[ends] = inside[ends]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(offsets, start, "right") - 1


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word with A-Z lower-cased: the sum of a random-looking value for every place and byte, mixed with
    the length (tabulation). No algebra links the places, so words built to cancel out in a polynomial do not meet."""
    value, n = byte_values(seed), len(data)
    place = np.ones(n, np.int32)  # sums up to a byte's place in the word that it is in or behind
    place[start] -= np.diff(start, prepend=-1).astype(np.int32)
    place = np.cumsum(place, dtype=np.int32)
    far = np.flatnonzero(place >= PLACES)
    at = np.minimum(place, PLACES - 1)
    at *= 256
    at += data
    each = value.ravel().take(at)
    if len(far):
        each[far] = mix(mix(place[far].astype(np.uint64) * _STEP + np.uint64(seed)) + value[0][data[far]])
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(each, out=sums[1:])
    return mix(sums[end] - sums[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def sequence_values(words: np.ndarray, place: np.ndarray) -> np.ndarray:
    """What each word adds to the hash of a sequence in which it stands at that place; sums of these are hashes of sequences."""
    return mix(words + (place.astype(np.uint64) + np.uint64(1)) * _STEP)


def hashed_words(column: pa.Array, limit: int = PIECE):
    """(first row, number of rows, word hashes, bounds) per piece; the words of the piece's row k are bounds[k] to bounds[k + 1]."""
    for row, data, offsets in pieces(column, limit):
        start, end, of = word_spans(data, offsets)
        n = len(offsets) - 1
        yield row, n, word_hashes(data, start, end), np.searchsorted(of, np.arange(n + 1))
