"""Vectorised hashing of words and word shingles over Arrow string columns.

Words are runs of bytes other than space and \\x09-\\x0D, with A-Z lower-cased. A text's
shingles are its runs of five words; a text of one to four words is one shingle. Hashes are
64 bits wide and depend on nothing but the text, so every executor agrees on them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes hashed at once. A longer text is cut at white space.
CHUNK = 1 << 21

_U = np.uint64
_PRIME = _U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = np.asarray(x, dtype=np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def stream(seed: int, n: int) -> np.ndarray:
    """n well-spread 64-bit values."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=np.uint64) + _U(seed) * _U(1_000_003)) * _PRIME)


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = stream(11, 256)
_BYTE[65:91] = _BYTE[97:123]
_BYTE[_SPACE] = 0
_STEP = stream(12, 8) | _U(1)
_POWER = np.ones(1, dtype=np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWER
    if len(_POWER) < n:
        with np.errstate(over="ignore"):
            _POWER = np.cumprod(np.full(max(n, 1 << 16), _PRIME | _U(1), dtype=np.uint64))
    return _POWER[:n]


#: Byte classes for shapes: lower-case letters (and bytes beyond ASCII), capitals and digits; other bytes are their own class.
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[97:123] = _CLASS[128:] = 97
_CLASS[65:91] = 65
_CLASS[48:58] = 48
_SHAPE = stream(13, 256)
_SHAPE[_SPACE] = 0


def _hash_words(data: np.ndarray, edges: np.ndarray, shape: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes, and where each word starts. edges: offsets in data at which a word must end.

    With ``shape``, a word stands for the classes of its bytes, runs of one class taken as one.
    """
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    solid = ~_SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    cut = edges[(edges > 0) & (edges < len(data))]
    first[cut] = solid[cut]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    with np.errstate(over="ignore"):
        width = np.diff(np.append(starts, len(data)))
        if shape:
            kind = _CLASS[data]
            turn = first.copy()
            turn[1:] |= kind[1:] != kind[:-1]
            turn &= solid
            runs = np.cumsum(turn)
            runs[starts[0]:] -= np.repeat(runs[starts], width)
            runs[:starts[0]] = 0
            values = np.where(turn, _SHAPE[kind] * _powers(int(runs.max()) + 1)[runs], _U(0))
            return mix(np.add.reduceat(values, starts)), starts
        place = np.arange(len(data), dtype=np.int64)
        place[starts[0]:] -= np.repeat(starts, width)
        values = _BYTE[data] * _powers(int(max(width.max(), starts[0])) + 1)[place]
        return mix(np.add.reduceat(values, starts)), starts


def words_of(data: np.ndarray, edges: np.ndarray, shape: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts) of the words of the texts data[edges[i]:edges[i + 1]]."""
    n = len(edges) - 1
    hashes, counts, i = [], np.zeros(n, np.int64), 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(edges, edges[i] + CHUNK, side="right")) - 1)
        lo, hi = int(edges[i]), int(edges[j])
        while lo < hi:
            end = hi
            if hi - lo > CHUNK and j == i + 1:
                spaces = np.flatnonzero(_SPACE[data[lo:lo + CHUNK]])
                later = () if len(spaces) else np.flatnonzero(_SPACE[data[lo + CHUNK:hi]])
                end = lo + int(spaces[-1]) + 1 if len(spaces) else lo + CHUNK + int(later[0]) + 1 if len(later) else hi
            found, starts = _hash_words(data[lo:end], edges[i:j + 1] - lo, shape)
            hashes.append(found)
            inner = np.searchsorted(starts, np.clip(edges[i:j + 1] - lo, 0, end - lo))
            counts[i:j] += np.diff(inner)
            lo = end
        i = j
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), counts


_EXACT = stream(14, 256)


def segments_of(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts as words with the white space behind them, byte for byte.

    Returns hashes of the segments, whether each holds a line end, and segments of each text.
    """
    lo, hi = int(edges[0]), int(edges[-1])
    counts = np.zeros(len(edges) - 1, np.int64)
    if lo == hi:
        return np.zeros(0, np.uint64), np.zeros(0, bool), counts
    data, edges = data[lo:hi], edges - lo
    solid = ~_SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    first[edges[:-1][edges[:-1] < len(data)]] = True
    starts = np.flatnonzero(first)
    place = np.arange(len(data), dtype=np.int64) - np.repeat(starts, np.diff(np.append(starts, len(data))))
    with np.errstate(over="ignore"):
        hashes = mix(np.add.reduceat(_EXACT[data] * _powers(int(place.max()) + 1)[place], starts))
    lines = np.logical_or.reduceat(data == 10, starts)
    return hashes, lines, np.diff(np.searchsorted(starts, edges))


def join_words(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the runs of ``width`` words."""
    n = len(words) - width + 1
    with np.errstate(over="ignore"):
        out = np.full(n, _U(width) * _PRIME, dtype=np.uint64)
        for k in range(width):
            out += words[k:k + n] * _STEP[k]
    return mix(out)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    edges = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, edges


def shingle_sets(column: pa.Array, width: int = 5) -> Iterator[np.ndarray]:
    """For each row its distinct shingle hashes, sorted; none for a text without words."""
    raw, edges = text_buffers(column)
    words, counts = words_of(raw, edges)
    at = 0
    for n in counts.tolist():
        own = words[at:at + n]
        at += n
        if n >= width:
            yield np.unique(join_words(own, width))
        elif n:
            yield join_words(own, n)
        else:
            yield own
