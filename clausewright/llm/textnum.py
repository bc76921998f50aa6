"""Words, word hashes and shingle hashes of whole Arrow text columns, as numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_PLACE = _rng.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWERS: list[np.ndarray] = []


def release() -> None:
    """Give freed memory back to the system at the end of a task; the worker lives on with what its pools hold."""
    _POWERS.clear()
    pa.default_memory_pool().release_unused()


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finalizer."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, up to n or more; kept at the largest size asked for."""
    if not _POWERS or len(_POWERS[0]) < n:
        size, out = 1 << n.bit_length(), []
        for base in (_BASE, pow(_BASE, -1, 2**64)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            out.append(np.multiply.accumulate(x))
        _POWERS[:] = out
    return _POWERS


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, and where each begins and the last ends; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]] if len(column) and column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, at - at[0]


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about ``most`` bytes of text; a longer text is a run of its own."""
    at = text_bytes(batch.column(column))[1]
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def word_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+, and the index of the first word of each text (and the end)."""
    solid = np.zeros(len(data) + 2, bool)
    solid[1:-1] = ~_SPACE[data]
    begin, end = solid[1:-1] & ~solid[:-2], solid[1:-1] & ~solid[2:]
    inner = at[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    begin[inner] = solid[1:-1][inner]
    end[inner - 1] = solid[1:-1][inner - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, at)


def lower(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z lower-cased."""
    return _LOWER[data]


def _summed(data: np.ndarray, up: np.ndarray) -> np.ndarray:
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
    return total


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool, most: int = 1 << 19) -> np.ndarray:
    """A hash of each word; bytes are read in runs of whole words of about ``most`` bytes, a longer word in parts."""
    up, down = _powers(most + 1)
    out = np.empty(len(starts), np.uint64)
    fold = (lambda x: _LOWER[x]) if lower else (lambda x: x)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + most, "right")))
        a, b = int(starts[i]), int(ends[j - 1])
        if b - a <= most:
            total = _summed(fold(data[a:b]), up)
            out[i:j] = (total[ends[i:j] - a] - total[starts[i:j] - a]) * down[starts[i:j] - a]
        else:
            value = 0
            for at in range(a, b, most):
                value += int(_summed(fold(data[at : min(at + most, b)]), up)[-1]) * pow(_BASE, at - a, 2**64)
            out[i] = value % 2**64
        i = j
    return mix(out + (ends - starts).astype(np.uint64))


def windows(words: np.ndarray, k: int) -> np.ndarray:
    """A hash for each run of k words, whichever text they are in."""
    if len(words) < k:
        return np.zeros(0, np.uint64)
    total = np.full(len(words) - k + 1, k, np.uint64)
    for j in range(k):
        total += words[j : len(words) - k + 1 + j] * _PLACE[j]
    return mix(total)


def shingle_sets(column: pa.Array, k: int, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct k-word shingle hashes of each text in turn, and where each text's begin (and the end).

    k is at most 50. A text with fewer than k words has its whole sequence as one shingle; one without words has none.
    """
    data, at = text_bytes(column)
    starts, ends, first = word_spans(data, at)
    words = word_hashes(data, starts, ends, lower)
    runs = windows(words, k)
    count = np.diff(first)
    short = (count > 0) & (count < k)
    sizes = np.where(count >= k, count - k + 1, short.astype(np.int64))
    begin = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(begin[-1], np.uint64)
    for i in np.flatnonzero(sizes):
        a, b = begin[i], begin[i + 1]
        if short[i]:
            w = words[first[i] : first[i + 1]]
            out[a] = mix(np.array([(w * _PLACE[8 : 8 + len(w)]).sum() + np.uint64(1000 + len(w))], np.uint64))[0]
        else:
            part = out[a:b]
            part[:] = runs[first[i] : first[i] + b - a]
            part.sort()
    if len(out) == 0:
        return out, begin
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    new[begin[:-1][sizes > 0]] = True
    return out[new], np.concatenate([[0], np.cumsum(new)])[begin]
