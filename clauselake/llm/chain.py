"""Forward and backward recursions of linear chains, for many sequences side by side.

Both the hidden Markov model and the conditional random field multiply, step by step, a row of state weights by a
transition matrix and by the weights of the symbol met. Rows are scaled to sum 1 at every step; the logarithms of the
scales add up to the logarithm of the whole. Sequences are ordered by length, so a step works on those still running.
"""

from __future__ import annotations

import numpy as np


class Layout:
    """Time-major order of the tokens of several sequences: step t of all sequences longer than t is contiguous."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths
        self.order = np.argsort(-lengths, kind="stable")
        ordered = lengths[self.order]
        longest = int(ordered[0]) if len(ordered) else 0
        self.active = np.searchsorted(-ordered, -np.arange(longest), side="left")  # sequences longer than t
        self.begin = np.concatenate([[0], np.cumsum(self.active)])
        starts = (np.cumsum(lengths) - lengths)[self.order]
        rank = np.arange(self.begin[-1]) - np.repeat(self.begin[:-1], self.active)
        step = np.repeat(np.arange(longest), self.active)
        self.source = starts[rank] + step if len(rank) else np.zeros(0, np.int64)  # token of each place
        self.rank = rank


def forward(layout: Layout, weights: np.ndarray, start: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scaled forward rows and scales; ``weights`` are the symbol weights per place (time-major)."""
    rows = np.empty_like(weights)
    scales = np.empty(len(weights), dtype=weights.dtype)
    for t, active in enumerate(layout.active):
        here = slice(layout.begin[t], layout.begin[t] + active)
        before = start[None, :] if t == 0 else rows[layout.begin[t - 1] : layout.begin[t - 1] + active] @ move
        row = before * weights[here]
        scale = row.sum(axis=1)
        scales[here] = scale
        rows[here] = row / scale[:, None]
    return rows, scales


def backward(layout: Layout, weights: np.ndarray, scales: np.ndarray, move: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Backward rows under the same scales; forward times backward is the posterior of the states."""
    rows = np.empty_like(weights)
    turned = np.ascontiguousarray(move.T)
    steps = len(layout.active)
    for t in range(steps - 1, -1, -1):
        active, begin = layout.active[t], layout.begin[t]
        following = layout.active[t + 1] if t + 1 < steps else 0
        rows[begin + following : begin + active] = end
        if following:
            n = layout.begin[t + 1]
            ahead = rows[n : n + following] * weights[n : n + following] / scales[n : n + following, None]
            rows[begin : begin + following] = ahead @ turned
    return rows


def pair_counts(layout: Layout, ahead: np.ndarray, back: np.ndarray, weights: np.ndarray, scales: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Expected transitions between states, summed over all steps of all sequences."""
    total = np.zeros_like(move)
    for t in range(1, len(layout.active)):
        active, n, p = layout.active[t], layout.begin[t], layout.begin[t - 1]
        arrived = back[n : n + active] * weights[n : n + active] / scales[n : n + active, None]
        total += ahead[p : p + active].T @ arrived
    return total * move


def per_sequence(layout: Layout, values: np.ndarray) -> np.ndarray:
    """Sums of time-major values by sequence, in the order the sequences were given."""
    out = np.zeros(len(layout.lengths))
    out[layout.order] = np.bincount(layout.rank, weights=values, minlength=len(layout.lengths)) if len(values) else 0
    return out
