from itertools import product

import numpy as np
import pytest

from clauselake.llm.chain import Layout, backward, forward, pair_counts, per_sequence


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_enumeration(seed):
    draws = np.random.default_rng(seed)
    states, lengths = 3, np.array([4, 0, 1, 5, 2])
    layout = Layout(lengths)
    weights = draws.random((int(lengths.sum()), states)) + 0.05
    start, move = draws.random(states), draws.random((states, states))
    placed = weights[layout.source]
    ahead, scales = forward(layout, placed, start, move)
    back = backward(layout, placed, scales, move, np.ones(states))
    posterior = np.empty_like(placed)
    posterior[layout.source] = ahead * back
    expected, moved, logs = np.zeros_like(weights), np.zeros((states, states)), np.zeros(len(lengths))
    at = 0
    for s, n in enumerate(lengths):
        paths = []
        for path in product(range(states), repeat=int(n)):
            value = start[path[0]] if n else 1.0
            for t, k in enumerate(path):
                value *= weights[at + t, k] * (move[path[t - 1], k] if t else 1)
            paths.append((path, value))
        total = sum(v for _, v in paths)
        logs[s] = np.log10(total)
        for path, value in paths:
            for t, k in enumerate(path):
                expected[at + t, k] += value / total
                if t:
                    moved[path[t - 1], k] += value / total
        at += n
    assert posterior == pytest.approx(expected)
    assert per_sequence(layout, np.log10(scales)) == pytest.approx(logs)
    assert pair_counts(layout, ahead, back, placed, scales, move) == pytest.approx(moved)
