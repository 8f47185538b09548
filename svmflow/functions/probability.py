"""Class probabilities from pairwise decision values, for many rows at once.

Sigmoid per pair (Platt, 1999) and coupling of the pairs (Wu, Lin and Weng,
2004, second method).
"""

from __future__ import annotations

import numpy as np

# Clamp of pair probabilities, and stopping rule of the coupling.
MIN_PROBABILITY = 1e-7
TOLERANCE = 0.005
MIN_ROUNDS = 100


def pair_probability(decision: np.ndarray, prob_a: tuple[float, ...], prob_b: tuple[float, ...]) -> np.ndarray:
    """Chance of the first class of each pair: 1/(1+exp(A*f+B)), clamped."""
    z = decision * np.array(prob_a) + np.array(prob_b)
    small = np.exp(-np.abs(z))
    chance = np.where(z >= 0, small, 1.0) / (1.0 + small)
    return np.clip(chance, MIN_PROBABILITY, 1.0 - MIN_PROBABILITY)


def couple_pairs(chance: np.ndarray, pairs: list[tuple[int, int]], n_classes: int) -> np.ndarray:
    """Class probabilities (row, class) that fit the pair probabilities best.

    Minimises sum over pairs of (r_ji p_i - r_ij p_j)^2 with sum(p) = 1 by
    coordinate steps, all rows together; a row is left alone once it is done.
    """
    n = len(chance)
    if n_classes == 2:
        return np.column_stack([chance[:, 0], 1.0 - chance[:, 0]])
    r = np.zeros((n, n_classes, n_classes))
    for k, (i, j) in enumerate(pairs):
        r[:, i, j] = chance[:, k]
        r[:, j, i] = 1.0 - chance[:, k]
    q = -r * r.transpose(0, 2, 1)
    diagonal = np.arange(n_classes)
    q[:, diagonal, diagonal] = (r * r).sum(axis=1)

    p = np.full((n, n_classes), 1.0 / n_classes)
    active = np.arange(n)
    for _ in range(max(MIN_ROUNDS, n_classes)):
        qa, pa = q[active], p[active]
        qp = np.einsum("nij,nj->ni", qa, pa)
        pqp = (pa * qp).sum(axis=1)
        going = np.abs(qp - pqp[:, None]).max(axis=1) >= TOLERANCE / n_classes
        active, qa, pa, qp, pqp = active[going], qa[going], pa[going], qp[going], pqp[going]
        if not len(active):
            break
        for t in range(n_classes):
            step = (pqp - qp[:, t]) / qa[:, t, t]
            pa[:, t] += step
            scale = 1.0 + step
            pqp = (pqp + step * (step * qa[:, t, t] + 2.0 * qp[:, t])) / scale**2
            qp = (qp + step[:, None] * qa[:, t, :]) / scale[:, None]
            pa /= scale[:, None]
        p[active] = pa
    return p
