"""Hashed words and word shingles of whole Arrow text columns, in vector operations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes hashed at once; a longer single text is taken whole.
BLOCK_BYTES = 1 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)
_STEP_INVERSE = np.uint64(pow(int(_STEP), -1, 1 << 64))
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_BYTE_VALUE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTE_VALUE[65:91] = _BYTE_VALUE[97:123]
#: The same without ASCII punctuation: behind a word it then leaves the hash as it is.
_PLAIN_VALUE = _BYTE_VALUE.copy()
_PLAIN_VALUE[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 0
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """Spread 64-bit values; a salt gives an independent spread."""
    with np.errstate(over="ignore"):
        h = h + np.uint64(salt)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_STEP, _STEP_INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            with np.errstate(over="ignore"):
                _POWERS[k] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]


def _word_hashes(data: np.ndarray, offsets: np.ndarray, values: np.ndarray = _BYTE_VALUE) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, words before each text) of texts that lie behind each other in ``data``."""
    if len(data) == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    total, starts, ends, inverse = _runs(data, offsets, values)
    with np.errstate(over="ignore"):
        raw = (total[ends] - total[starts]) * inverse[starts]
    return mix(raw), np.searchsorted(starts, offsets)


def _runs(data: np.ndarray, offsets: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, ...]:
    """(running polynomial of the bytes, word starts, word ends, factors that undo a start)."""
    n = len(data)
    white = _WHITE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    start = ~white
    start[1:] &= white[:-1] | edge[1:n]
    end = ~white
    end[:-1] &= white[1:] | edge[1:n]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    power, inverse = _powers(n)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(values[data] * power, out=total[1:])
    return total, starts, ends, inverse


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in small parts, so that what a task derives from its rows stays small too."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def text_blocks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, UTF-8 bytes, offsets) of consecutive rows of a text column; null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK_BYTES, "right")) - 1)
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def plain_words(texts: pa.Array, whole: bool = False) -> Iterator:
    """Hashes of the words of each text in order, A-Z lower-cased, punctuation behind a word left out.

    With ``whole`` the words of consecutive texts together, with the number of words before each.
    """
    for _, data, offsets in text_blocks(texts):
        words, before = _word_hashes(data, offsets, _PLAIN_VALUE)
        if whole:
            yield words, before
        else:
            for i in range(len(before) - 1):
                yield words[before[i] : before[i + 1]]


def plain_terms(texts: pa.Array, prefixes: tuple[int, ...] = (4, 5, 6)) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of the plain words of each text and of the first bytes of longer words."""
    for _, data, offsets in text_blocks(texts):
        if len(data) == 0:
            yield from (np.zeros(0, np.uint64) for _ in offsets[1:])
            continue
        total, starts, ends, inverse = _runs(data, offsets, _PLAIN_VALUE)
        with np.errstate(over="ignore"):
            kinds = [mix((total[ends] - total[starts]) * inverse[starts])]
            for n in prefixes:
                # A word without so many bytes stands for itself.
                to = np.minimum(starts + n, ends)
                kinds.append(np.where(starts + n < ends, mix((total[to] - total[starts]) * inverse[starts], n), kinds[0]))
        before = np.searchsorted(starts, offsets)
        terms = np.stack(kinds, axis=1)
        for i in range(len(before) - 1):
            yield np.unique(terms[before[i] : before[i + 1]])


def shingle_sets(texts: pa.Array, width: int = 5) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text: ``width`` words, or all words of a shorter text; none without words."""
    factors = mix(np.arange(1, width + 1, dtype=np.uint64))
    for _, data, offsets in text_blocks(texts):
        words, before = _word_hashes(data, offsets)
        n = len(words)
        with np.errstate(over="ignore"):
            rolled = np.zeros(max(0, n - width + 1), np.uint64)
            for k in range(width if n >= width else 0):
                rolled += words[k : n - width + 1 + k] * factors[k]
            rolled = mix(rolled)
            for i in range(len(before) - 1):
                lo, hi = before[i], before[i + 1]
                if hi - lo >= width:
                    yield np.unique(rolled[lo : hi - width + 1])
                elif hi > lo:
                    yield mix(np.array([(words[lo:hi] * factors[: hi - lo]).sum()], np.uint64), int(hi - lo))
                else:
                    yield np.zeros(0, np.uint64)
