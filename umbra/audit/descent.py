"""Audits that descend a tree of subsets: each query tells how many members (or what sum) one part of a split holds.

One best-first search serves all variants; a Policy says what a query measures, how a node is split, which nodes are
looked at first, and how the budget ends.
"""

from __future__ import annotations

import heapq
import itertools
import random
from collections.abc import Callable
from dataclasses import dataclass

from umbra.audit.memo import Memo


@dataclass(frozen=True)
class Policy:
    """weight: of an element; split(node, found, left, rng) to two parts or None; two_sided: nodes near empty count as near full ones;
    strict: a query must leave the budget unexceeded (else the last one may spend it); empties: a popped node without members is a finding."""

    weight: Callable
    split: Callable
    two_sided: bool
    strict: bool = False
    empties: bool = True


def halves(node: list, found: float, left: int, rng: random.Random):
    middle = len(node) // 2
    return (node[:middle], node[middle:]) if middle else None


def one(_element) -> int:
    return 1


def value(element) -> int:
    return element[1]


def by_memo(memo: Memo) -> Callable:
    def split(node: list, found: int, left: int, rng: random.Random):
        n = len(node)
        k = n // 2 if memo.calls(n, found) < left else memo.best(n, found, max(left, 0))[1]
        if k in (0, n):
            return None
        mixed = rng.sample(node, n)
        return mixed[:k], mixed[k:]

    return split


BASELINE = Policy(one, halves, two_sided=False, empties=False)
IMPROVED = Policy(one, halves, two_sided=True)
SUM_ONLY = Policy(value, halves, two_sided=True)


def dynamic(memo: Memo) -> Policy:
    return Policy(one, by_memo(memo), two_sided=True, strict=True)


def audit(x: set, y: set, budget: int, policy: Policy, rng: random.Random) -> tuple[set, set]:
    """(elements shown to be in y, elements shown not to be) of x after at most `budget` queries, the first about all of x."""
    members, others = set(), set()
    if not x:
        return members, others
    size = lambda node: sum(map(policy.weight, node))
    ask = lambda node: sum(policy.weight(e) for e in node if e in y)
    order = itertools.count()

    def rank(found: float, whole: float) -> float:
        share = found / whole if whole else 0.0
        return max(share, 1 - share) if policy.two_sided else share

    start = rng.sample(sorted(x), len(x))
    calls = 1
    queue = [(-rank(ask(start), size(start)), next(order), ask(start), start)]
    while queue and calls <= budget:
        _, _, found, node = heapq.heappop(queue)
        while 0 < found < size(node) and (calls < budget if policy.strict else calls <= budget):
            parts = policy.split(node, found, budget - calls, rng)
            if parts is None or not all(size(p) for p in parts):
                break
            asked = 0 if size(parts[0]) < size(parts[1]) else 1  # the smaller; of equals the second
            calls += 1
            got = [0, 0]
            got[asked] = ask(parts[asked])
            got[1 - asked] = found - got[asked]
            ranks = [rank(g, size(p)) for g, p in zip(got, parts, strict=True)]
            on = 1 if ranks[1] > ranks[0] else 0
            off = 1 - on
            if got[off]:
                heapq.heappush(queue, (-ranks[off], next(order), got[off], parts[off]))
            else:
                others.update(parts[off])
            node, found = parts[on], got[on]
        # only whole findings count: a mixed node at the end of the budget shows nothing
        if calls <= budget:
            if found and found == size(node):
                members.update(e for e in node if policy.weight(e))
            elif not found and policy.empties:
                others.update(e for e in node if policy.weight(e))
    return members, others
