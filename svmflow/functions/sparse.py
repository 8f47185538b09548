"""Arrow feature columns as numpy matrices, for use inside tasks."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

# Columns of a dense working matrix; wider data is multiplied in strips.
STRIP_COLUMNS = 4096

# Cells of one block of a kernel matrix inside a task: what rows meet is added up block by block.
KERNEL_CELLS = 1 << 20

# The feature column in Arrow, every part nullable.
FEATURES_ARROW = pa.list_(pa.field("element", pa.struct([("idx", pa.int32()), ("val", pa.float64())])))


class SparseRows(NamedTuple):
    """Rows of (idx, val) pairs, end to end, with the offsets between rows."""

    offsets: np.ndarray
    idx: np.ndarray
    val: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def rows(self, start: int, stop: int) -> SparseRows:
        lo, hi = self.offsets[start], self.offsets[stop]
        return SparseRows(self.offsets[start : stop + 1] - lo, self.idx[lo:hi], self.val[lo:hi])

    def take(self, at: np.ndarray) -> SparseRows:
        """The rows at the given positions."""
        lengths = np.diff(self.offsets)[at]
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        from_ = np.repeat(self.offsets[:-1][at] - offsets[:-1], lengths) + np.arange(offsets[-1])
        return SparseRows(offsets, self.idx[from_], self.val[from_])

    def row_numbers(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.offsets))

    def square_norms(self) -> np.ndarray:
        return np.bincount(self.row_numbers(), weights=self.val * self.val, minlength=len(self))

    def dense(self, columns: np.ndarray) -> np.ndarray:
        """Values at the given sorted indices; indices not asked for are left out."""
        out = np.zeros((len(self), len(columns)))
        if len(columns) and len(self.idx):
            at = np.minimum(np.searchsorted(columns, self.idx), len(columns) - 1)
            hit = columns[at] == self.idx
            out[self.row_numbers()[hit], at[hit]] = self.val[hit]
        return out


def from_arrow(features: pa.Array | pa.ChunkedArray) -> SparseRows:
    """Feature column (list of idx/val structs) to ``SparseRows`` without a Python loop."""
    if isinstance(features, pa.ChunkedArray):
        features = features.combine_chunks()
    if isinstance(features, pa.ChunkedArray):  # zero chunks
        features = pa.concat_arrays(features.chunks) if features.chunks else pa.array([], features.type)
    lengths = features.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    pairs = features.flatten()
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    idx = pairs.field("idx").to_numpy(zero_copy_only=False).astype(np.int64)
    val = pairs.field("val").to_numpy(zero_copy_only=False).astype(np.float64)
    return SparseRows(offsets, idx, val)


def column_strips(rows: SparseRows) -> Iterator[np.ndarray]:
    """The distinct indices of ``rows`` in sorted strips of bounded width."""
    columns = np.unique(rows.idx)
    for start in range(0, len(columns), STRIP_COLUMNS):
        yield columns[start : start + STRIP_COLUMNS]


class Against:
    """Rows that many blocks of others meet: their columns, norms and, within one strip, dense values are found once."""

    def __init__(self, rows: SparseRows):
        self.rows = rows
        self.norms = rows.square_norms()
        self.strips = list(column_strips(rows))
        self.held = rows.dense(self.strips[0]).T if len(self.strips) == 1 else None

    def __len__(self) -> int:
        return len(self.rows)


def cross_dots(a: SparseRows, b: SparseRows | Against) -> np.ndarray:
    """Dot product of every row of ``a`` with every row of ``b``."""
    b = b if isinstance(b, Against) else Against(b)
    out = None
    for strip in b.strips:
        part = a.dense(strip) @ (b.rows.dense(strip).T if b.held is None else b.held)
        out = part if out is None else np.add(out, part, out=out)
    return np.zeros((len(a), len(b))) if out is None else out


def square_distances(a: SparseRows, b: SparseRows | Against) -> np.ndarray:
    b = b if isinstance(b, Against) else Against(b)
    out = cross_dots(a, b)
    out *= -2.0
    out += a.square_norms()[:, None]
    out += b.norms[None, :]
    return np.maximum(out, 0.0, out=out)


def rbf(a: SparseRows, b: SparseRows | Against, gamma: float) -> np.ndarray:
    """exp(-gamma |x - z|^2) of every row of ``a`` with every row of ``b``, without a second matrix."""
    return rbf_in_place(square_distances(a, b), gamma)


def rbf_in_place(distances: np.ndarray, gamma: float) -> np.ndarray:
    distances *= -gamma
    return np.exp(distances, out=distances)
