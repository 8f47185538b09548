"""Dual C-SVC on one bounded block of rows: a small numpy helper used inside tasks.

Sequential minimal optimisation with second-order working pairs (Fan, Chen
and Lin, 2005). Kernel rows are computed as they are needed and kept in a
cache of fixed size, and rows at their bounds that cannot take part are set
aside until the others are done. It only ever sees a bounded number of rows;
anything larger is split up by the Spark jobs in ``operators``.
"""

from __future__ import annotations

from collections import OrderedDict

import numpy as np

from svmflow.functions.sparse import KERNEL_CELLS, STRIP_COLUMNS, Against, SparseRows, rbf, rbf_in_place

_TAU = 1e-12
# Fixed value: bytes of kernel rows that a solve keeps. The tasks of an executor each hold as much, and a second matrix
# of that size where cells share distances.
CACHE_BYTES = 32 << 20
# Steps between two looks for rows that can be set aside.
SHRINK_EVERY = 1000


class RbfKernel:
    """Rows of exp(-gamma |x - z|^2) over the active rows of a block.

    If the whole matrix fits the cache it is filled at once by a matrix
    product; otherwise each row is computed when it is first asked for, and
    the row that was not used for longest makes room.
    """

    def __init__(self, rows: SparseRows, gamma: float, cache_bytes: int = CACHE_BYTES, distances: np.ndarray | None = None):
        self.rows, self.gamma, self.cache_bytes = rows, gamma, cache_bytes
        self.norms = rows.square_norms()
        self.diagonal = np.ones(len(rows))
        self.matrix = None
        if distances is not None or 8 * len(rows) ** 2 <= cache_bytes:
            self.matrix = rbf(rows, rows, gamma) if distances is None else rbf_in_place(distances.copy(), gamma)
        self.columns = np.unique(rows.idx)
        self.dense = rows.dense(self.columns) if self.matrix is None and len(self.columns) <= STRIP_COLUMNS else None
        self.activate(np.arange(len(rows)))

    def activate(self, active: np.ndarray) -> None:
        """Rows that ``row`` covers from now on."""
        self.active = active
        self.part = self.dense[active] if self.dense is not None else None
        self.cache: OrderedDict[int, np.ndarray] = OrderedDict()
        self.held = max(2, self.cache_bytes // max(1, 8 * len(active)))

    def row(self, at: int) -> np.ndarray:
        """Kernel of the active row number ``at`` with all active rows."""
        i = int(self.active[at])
        if self.matrix is not None:
            line = self.matrix[i]
            return line if len(self.active) == len(line) else line[self.active]
        if i in self.cache:
            self.cache.move_to_end(i)
            return self.cache[i]
        if self.part is not None:
            dots = self.part @ self.dense[i]
        else:
            lo, hi = self.rows.offsets[i], self.rows.offsets[i + 1]
            wanted = np.zeros(len(self.columns))
            wanted[np.searchsorted(self.columns, self.rows.idx[lo:hi])] = self.rows.val[lo:hi]
            products = self.rows.val * wanted[np.searchsorted(self.columns, self.rows.idx)]
            dots = np.bincount(self.rows.row_numbers(), weights=products, minlength=len(self.rows))[self.active]
        line = np.exp(-self.gamma * np.maximum(self.norms[self.active] + self.norms[i] - 2.0 * dots, 0.0))
        if len(self.cache) >= self.held:
            self.cache.popitem(last=False)
        self.cache[i] = line
        return line

    def pulls(self, targets: np.ndarray, sources: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Weighted sums of the kernel of each target with the sources, in blocks."""
        out = np.zeros(len(targets))
        step = max(1, KERNEL_CELLS // max(1, len(sources)))
        taken = Against(self.rows.take(sources)) if self.matrix is None else None
        for lo in range(0, len(targets), step):
            block = targets[lo : lo + step]
            if self.matrix is not None:
                kernel = self.matrix[np.ix_(block, sources)]
            else:
                kernel = rbf(self.rows.take(block), taken, self.gamma)
            out[lo : lo + step] = kernel @ weights
        return out


class GivenKernel(RbfKernel):
    """A kernel matrix that is already there."""

    def __init__(self, matrix: np.ndarray):
        self.matrix, self.diagonal = matrix, np.diagonal(matrix)
        self.active = np.arange(len(matrix))
        self.rows = SparseRows(np.zeros(len(matrix) + 1, np.int64), np.zeros(0, np.int64), np.zeros(0))

    def activate(self, active: np.ndarray) -> None:
        self.active = active


def movable(alpha: np.ndarray, y: np.ndarray, c: float) -> tuple[np.ndarray, np.ndarray]:
    """Which rows may move up and which down along their label."""
    below, above = alpha < c, alpha > 0
    return np.where(y > 0, below, above), np.where(y > 0, above, below)


def solve(
    kernel: np.ndarray | RbfKernel,
    y: np.ndarray,
    c: float,
    eps: float,
    alpha: np.ndarray | None = None,
    gradient: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray]:
    """Alphas and gradient at which the largest KKT violation is below ``eps``.

    Starts from zero, or from a given point and its gradient, which may
    include the pull of fixed rows outside this block.
    """
    kernel = GivenKernel(kernel) if isinstance(kernel, np.ndarray) else kernel
    n = len(y)
    alpha = np.zeros(n) if alpha is None else alpha.copy()
    gradient = -np.ones(n) if gradient is None else gradient.copy()
    start, base = alpha.copy(), gradient.copy()
    active = np.arange(n)
    kernel.activate(active)
    while True:
        active = _descend(kernel, y, c, eps, alpha, gradient, active)
        if len(active) == n:
            return alpha, gradient
        # The rows set aside were right by an old gradient: bring theirs up to date and look again.
        aside = np.setdiff1d(np.arange(n), active)
        moved = np.flatnonzero(alpha != start)
        gradient[aside] = base[aside] + y[aside] * kernel.pulls(aside, moved, (y * (alpha - start))[moved])
        active = np.arange(n)
        kernel.activate(active)


def _descend(kernel: RbfKernel, y_all, c: float, eps: float, alpha_all, gradient_all, active: np.ndarray) -> np.ndarray:
    """Steps until the active rows meet the conditions; writes them back and returns those still active."""
    y, alpha, gradient, diagonal = y_all[active], alpha_all[active], gradient_all[active], kernel.diagonal[active]
    up, down = movable(alpha, y, c)
    steps = 0
    while True:
        score = -y * gradient
        up_score = np.where(up, score, -np.inf)
        i = int(np.argmax(up_score))
        gap = up_score[i] - score
        done = not (down.any() and up.any()) or np.max(gap, where=down, initial=-np.inf) < eps
        steps += 1
        if done or steps % SHRINK_EVERY == 0:
            alpha_all[active], gradient_all[active] = alpha, gradient
            if done:
                return active
            # A row that can only move one way, and is beyond what the other side offers, cannot be in a pair.
            lowest = np.min(score, where=down, initial=np.inf)
            keep = ~((up & ~down & (score < lowest)) | (down & ~up & (score > up_score[i])))
            if 2 * np.count_nonzero(keep) < len(keep):
                active = active[keep]
                kernel.activate(active)
                y, alpha, gradient, diagonal = y[keep], alpha[keep], gradient[keep], diagonal[keep]
                up, down = up[keep], down[keep]
                continue
        line_i = kernel.row(i)
        curve = np.maximum(diagonal[i] + diagonal - 2.0 * line_i, _TAU)
        gain = np.where(down & (gap > 0), gap * gap / curve, -np.inf)
        j = int(np.argmax(gain))
        # Move alpha_i by +step and alpha_j by -step along their labels, inside the box.
        room_i = c - alpha[i] if y[i] > 0 else alpha[i]
        room_j = alpha[j] if y[j] > 0 else c - alpha[j]
        step = min(gap[j] / curve[j], room_i, room_j)
        for row, sign, room in ((i, 1.0, room_i), (j, -1.0, room_j)):
            old = alpha[row]
            target = c if sign * y[row] > 0 else 0.0
            # Land exactly on the bound, so that bound tests stay exact.
            alpha[row] = target if step >= room else old + sign * y[row] * step
            alpha[row] = min(max(alpha[row], 0.0), c)
            up[row] = alpha[row] < c if y[row] > 0 else alpha[row] > 0
            down[row] = alpha[row] > 0 if y[row] > 0 else alpha[row] < c
        gradient += y * (line_i - kernel.row(j)) * step


def offset(alpha: np.ndarray, y: np.ndarray, gradient: np.ndarray, c: float) -> float:
    """rho of the decision function: mean over free rows, else middle of the bounds."""
    slope = y * gradient
    free = (alpha > 0) & (alpha < c)
    if free.any():
        return float(slope[free].mean())
    up, down = movable(alpha, y, c)
    # No free row: every rho between the two bounds is optimal. One side may be empty.
    low = slope[up].min() if up.any() else slope[down].max()
    high = slope[down].max() if down.any() else slope[up].min()
    return float((low + high) / 2.0)
