"""Bayes audit: beliefs about each element are revised by the sizes of joins with random subsets of the likeliest."""

from __future__ import annotations

import numpy as np


def audit(truth: np.ndarray, budget: int, low: float = 0.25, high: float = 0.8, tolerance: float = 0.1, scale: float = 0.0, rate: float = 0.5, seed: int = 0) -> tuple[int, int, int, int]:
    """(right members, right others, wrong members, wrong others) after the budget.

    Two queries are spent on the prior. Each further one samples elements with belief near the top (or next to it, once
    some are certain) at `rate`, sees how many members the sample has (with Laplace noise of `scale`), and sets the beliefs
    of sampled and unsampled elements to their parts' shares; beliefs outside (low, high) become certain. Where all or
    none of the elements are sampled, their beliefs are rounded and nothing is spent.
    """
    rng = np.random.default_rng(seed)
    truth = np.asarray(truth, dtype=int)
    n = len(truth)
    if not n:
        return 0, 0, 0, 0
    noise = lambda: rng.laplace(0, scale) if scale else 0.0
    total = truth.sum()
    belief = np.full(n, np.clip(total * (1 + noise()), 0, n) / n)
    left = budget - 2
    while left >= 0:
        levels = np.unique(belief)[::-1]
        if levels[0] < 1:
            bar = levels[0] - tolerance
        elif len(levels) > 1:
            bar = levels[1] - tolerance
        else:
            break
        near = belief >= bar
        sampled = near & (rng.random(n) < rate)
        rest = near & ~sampled
        if not sampled.any() or not rest.any():
            belief[near] = belief[near] >= 0.5
            if np.isin(belief, (0, 1)).all():
                break
            continue
        expected = belief[near].sum()
        seen = truth[sampled].sum()
        seen = np.clip(seen * (1 + 0.1 * noise()), 0, sampled.sum())
        belief[sampled] = seen / sampled.sum()
        belief[rest] = (expected - seen) / rest.sum()
        belief[belief >= high] = 1
        belief[belief <= low] = 0
        if set(belief.tolist()) == {0.0, 1.0}:
            break
        left -= 1
    said_in, said_out = belief == 1, belief == 0
    right_in, right_out = int((said_in & (truth == 1)).sum()), int((said_out & (truth == 0)).sum())
    wrong_in, wrong_out = int((said_in & (truth == 0)).sum()), int((said_out & (truth == 1)).sum())
    return right_in, right_out, wrong_in if right_in else 0, wrong_out if right_out else 0
