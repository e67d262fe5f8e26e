"""Sum-tree audit: sizes and sums of joins leave few subsets as candidates; asking about one of them splits the set."""

from __future__ import annotations

import itertools
import math
import random
from bisect import bisect_right
from dataclasses import dataclass


def n_sum(numbers, target: int, n: int) -> list[list[int]]:
    """All n-subsets of the distinct numbers (not negative) with the given sum, in lexicographic order."""
    values = sorted(set(numbers))
    prefix = [0, *itertools.accumulate(values)]
    out: list[list[int]] = []

    def choose(start: int, left: int, need: int, taken: list[int]) -> None:
        if not need:
            if not left:
                out.append(taken)
            return
        for i in range(start, len(values) - need + 1):
            least = prefix[i + need] - prefix[i]
            most = values[i] + prefix[-1] - prefix[len(values) - need + 1] if need > 1 else values[i]
            if least > left:
                return
            if most >= left:
                choose(i + 1, left - values[i], need - 1, [*taken, values[i]])

    if 0 <= n <= len(values):
        choose(0, target, n, [])
    return out


def n_sum_pairs(pairs, target: int, n: int) -> list[list[tuple]]:
    """The same over (id, value) pairs: subsets of n pairs whose values have the sum."""
    items = sorted(set(pairs), key=lambda p: (p[1], p[0]))
    return [list(c) for c in itertools.combinations(items, n) if sum(v for _, v in c) == target]


def complexity(length: int, density: int) -> float:
    """log10 of length ** (length // density - 1); 0 for an empty set."""
    return (length // density - 1) * math.log10(length) if length > 0 else 0.0


def solve_size(low: int, high: int, budget: int, computation: float, density: int) -> int:
    """The largest length in [low, high) whose complexity stays within the computation for each query."""
    limit = math.log10(computation / budget)
    lengths = range(low, high)
    return max(low, low + bisect_right(lengths, limit, key=lambda n: complexity(n, density)) - 1) if lengths else 0


@dataclass
class Part:
    """A set of elements of which the number and sum of members are known; candidates: the subsets that these allow."""

    node: set[int]
    size: int
    total: int
    candidates: list[list[int]]

    @classmethod
    def of(cls, node: set[int], size: int, total: int) -> Part:
        return cls(node, size, total, n_sum(node, total, size))

    def worth(self, queries: int) -> float:
        """Elements that so many queries would resolve, were each candidate as likely as any other."""
        c = len(self.candidates)
        return len(self.node) * (1.0 if c <= queries else 1 - (1 - 1 / c) ** queries)

    def split(self, guess: set[int], size: int, total: int) -> tuple[Part, Part]:
        """The guessed part, of which size and total have been asked, and the rest, whose own follow."""
        return Part.of(guess, size, total), Part.of(self.node - guess, self.size - size, self.total - total)


def audit(x: set[int], y: set[int], budget: int, computation: float = 1e10, rng: random.Random | None = None) -> tuple[set[int], set[int]]:
    """(elements shown to be in y, elements shown not to be) after at most `budget` queries of (size, sum).

    Of the open parts the worthiest is always looked at next: one candidate left resolves it, else its first candidate is
    asked about. Without an open part, what is left of x is asked about, or a random part of it small enough to enumerate.
    """
    rng = rng or random.Random(0)
    members: set[int] = set()
    others: set[int] = set()
    parts: list[Part] = []
    left = budget

    def ask(node: set[int]) -> tuple[int, int]:
        nonlocal left
        left -= 1
        return len(node & y), sum(node & y)

    def resolve() -> None:
        for part in [p for p in parts if len(p.candidates) == 1]:
            parts.remove(part)
            members.update(part.candidates[0])
            others.update(part.node.difference(part.candidates[0]))

    while left > 0:
        if not parts:
            node = x - members - others
            if not node:
                break
            size, total = ask(node)
            if left and size > 1 and len(node) ** (size - 1) >= computation / left:
                n = solve_size(0, min(500, len(node) + 1), left, computation, max(1, len(node) // size))
                node = set(rng.sample(sorted(node), max(1, n)))
                size, total = ask(node)
            if len(node) ** max(size - 1, 0) >= computation:
                break  # no query is left to make it smaller
            parts.append(Part.of(node, size, total))
        else:
            best = max(parts, key=lambda p: p.worth(left))
            parts.remove(best)
            guess = set(best.candidates[0])
            parts.extend(best.split(guess, *ask(guess)))
        resolve()
    return members, others
