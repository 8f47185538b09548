"""Weighted acyclic automata over word sequences: counts of n-grams as numpy arrays, for use inside tasks.

A transducer reads a language and up to ``DEPTH`` words and gives a count.
States are the distinct prefixes of its sequences; they are made from sorted
sequences, each adding the states behind the prefix that it shares with the
one before. Per level the arcs lie in order, with the number of arcs behind
each, so a prefix is a range of sequences and its weight their sum.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words of the longest sequence.
DEPTH = 3
_CODEC = pa.Codec("zstd", compression_level=1)


class Transducer(NamedTuple):
    """Sorted distinct sequences, one column of symbols per level, with their weights.

    Column 0 numbers ``langs``; the others number ``words`` from 1, and 0 ends
    a sequence. Both lists are in byte order, so numbers compare as they do.
    """

    langs: list[bytes]
    words: list[bytes]
    columns: list[np.ndarray]
    weights: np.ndarray

    def __len__(self) -> int:
        return len(self.weights)

    def new_states(self) -> list[np.ndarray]:
        """Per level the positions of the sequences that add a state there."""
        return new_states(self.columns)

    def position(self, bound: Sequence[bytes]) -> int:
        """Number of sequences before ``bound`` (language, then words, empty at the end)."""
        local = []
        for level, symbol in enumerate(bound):
            known, first = (self.langs, 0) if level == 0 else (self.words, 1)
            if level and not symbol:
                local.append(0)
                continue
            at = bisect_left(known, symbol)
            local.append(at + first)
            if at == len(known) or known[at] != symbol:
                break  # every sequence is told apart by this symbol
        local += [0] * (len(bound) - len(local))
        low, high = 0, len(self)
        for column, wanted in zip(self.columns, local, strict=True):
            low, high = (low + int(np.searchsorted(column[low:high], wanted, s)) for s in ("left", "right"))
            if low == high:
                break
        return low

    def part(self, low: int, high: int) -> Transducer:
        """The sequences low..high-1 with the symbols that they use."""
        columns = [c[low:high] for c in self.columns]
        used = np.unique(np.concatenate(columns[1:])) if high > low else np.zeros(0, np.int64)
        used = used[used > 0]
        langs = np.unique(columns[0])
        renamed = [np.searchsorted(langs, columns[0])]
        renamed += [np.where(c > 0, np.searchsorted(used, c) + 1, 0) for c in columns[1:]]
        return Transducer(
            [self.langs[i] for i in langs.tolist()], [self.words[i - 1] for i in used.tolist()], renamed, self.weights[low:high]
        )

    def encode(self) -> bytes:
        """Arcs and fan-outs of every level, and the weights, compressed."""
        starts = self.new_states()
        arrays = [_bytes(self.langs), _bytes(self.words)]
        for level, column in enumerate(self.columns):
            arrays.append(column[starts[level]])
            if level < DEPTH:
                arrays.append(np.diff(np.append(np.searchsorted(starts[level + 1], starts[level]), len(starts[level + 1]))))
        arrays.append(self.weights)
        return _pack(arrays)


def new_states(columns: list[np.ndarray]) -> list[np.ndarray]:
    """Per level the positions of sorted sequences whose prefix differs from the sequence before."""
    changed = np.zeros(len(columns[0]), bool)
    changed[:1] = True
    out = []
    for column in columns:
        changed = changed.copy()
        changed[1:] |= column[1:] != column[:-1]
        out.append(np.flatnonzero(changed))
    return out


def _bytes(names: list[bytes]) -> np.ndarray:
    """Names with a line feed behind each; neither words nor, escaped, languages hold one."""
    return np.frombuffer(b"".join(n.replace(b"\\", b"\\\\").replace(b"\n", b"\\n") + b"\n" for n in names), np.uint8)


def _names(data: np.ndarray) -> list[bytes]:
    out = data.tobytes().split(b"\n")[:-1]
    if any(b"\\" in name for name in out):
        out = [b"\\".join(p.replace(b"\\n", b"\n") for p in name.split(b"\\\\")) for name in out]
    return out


def _pack(arrays: list[np.ndarray]) -> bytes:
    """Arrays of non-negative integers, each in the narrowest type that holds it."""
    kinds = ["<u1", "<u2", "<u4", "<u8"]
    head, body = [len(arrays)], []
    for array in arrays:
        top = int(array.max()) if len(array) else 0
        kind = next(i for i, bits in enumerate((8, 16, 32, 64)) if top < 1 << bits)
        head += [kind, len(array)]
        body.append(array.astype(kinds[kind]).tobytes())
    raw = np.array(head, "<u8").tobytes() + b"".join(body)
    return len(raw).to_bytes(8, "little") + _CODEC.compress(raw, asbytes=True)


def _unpack(data: bytes) -> list[np.ndarray]:
    raw = _CODEC.decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)
    (n,) = np.frombuffer(raw, "<u8", 1)
    head = np.frombuffer(raw, "<u8", 2 * int(n), 8).astype(np.int64)
    at, out = 8 + 16 * int(n), []
    for kind, length in head.reshape(-1, 2).tolist():
        array = np.frombuffer(raw, ["<u1", "<u2", "<u4", "<u8"][kind], length, at)
        at += array.nbytes
        out.append(array)
    return out


def decode(data: bytes) -> Transducer:
    langs, words, *levels, weights = _unpack(data)
    labels = [a.astype(np.int64) for a in levels[::2]]
    fans = levels[1::2]
    columns: list[np.ndarray] = []
    for level, label in enumerate(labels):
        columns.append(label)
        if level < DEPTH:
            columns = [np.repeat(c, fans[level]) for c in columns]
    return Transducer(_names(langs), _names(words), columns, weights.astype(np.int64))


def merged(langs: list[bytes], words: list[bytes], columns: list[np.ndarray], weights: np.ndarray) -> Transducer:
    """The transducer of sequences in any order; weights of equal ones add up."""
    widths = [max(1, len(langs)), *[len(words) + 1] * DEPTH]
    product = 1
    for width in widths:
        product *= width
    if product < 1 << 62:
        key = columns[0].astype(np.int64)
        for column, width in zip(columns[1:], widths[1:], strict=True):
            key = key * width + column
        order = np.argsort(key, kind="stable")
    else:
        order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    first = new_states(columns)[-1]
    total = np.add.reduceat(weights[order], first) if len(first) else weights[:0]
    return Transducer(langs, words, [c[first] for c in columns], total)


def union(parts: list[Transducer]) -> Transducer:
    """One transducer for all parts; weights of equal sequences add up."""
    langs, lang_at = _common([p.langs for p in parts])
    words, word_at = _common([p.words for p in parts])
    columns = [np.concatenate([at[p.columns[0]] for p, at in zip(parts, lang_at, strict=True)])]
    for level in range(1, DEPTH + 1):
        named = [np.append(0, at + 1)[p.columns[level]] for p, at in zip(parts, word_at, strict=True)]
        columns.append(np.concatenate(named))
    return merged(langs, words, columns, np.concatenate([p.weights for p in parts]))


def _common(lists: list[list[bytes]]) -> tuple[list[bytes], list[np.ndarray]]:
    """All names in byte order, and where each list's names are in it."""
    names, at = sorted_names(pa.array([n for names in lists for n in names], pa.large_binary()))
    return names, np.split(at, np.cumsum([len(names) for names in lists])[:-1])


def sorted_names(values: pa.Array) -> tuple[list[bytes], np.ndarray]:
    """Distinct values in byte order, and the place of every value among them."""
    coded = values.dictionary_encode()
    order = pc.array_sort_indices(coded.dictionary).to_numpy().astype(np.int64)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return coded.dictionary.take(pa.array(order)).to_pylist(), place[coded.indices.to_numpy()] if len(order) else order
