"""Simple tree matching of page skeletons (op6).

A skeleton is the tree of a page's elements that hold text, with a label (tag and
classes) each.  Two trees match where their labels are equal, from the root down, and
the children of matched nodes are aligned in order so that most nodes match: the
recursion of simple tree matching.  ``merge`` puts a tree into another one: matched
nodes become one, the others are inserted where they stand between their neighbours,
so every merged tree can be found again whole.

In a skeleton, children without elements of their own and of one label (paragraphs,
list items) are one node; neighbours of one label with elements of their own are one
repeated record if at least half of the larger one matches.  Trees of every size are
aligned in the same way.  Equal subtrees are compared once, a row of the alignment is one
numpy step, and only some rows are kept; children that all differ from each other and
have one label still take time by the product of their numbers.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import lru_cache
from math import isqrt

import numpy as np

#: Scores of pairs that are remembered.
KEPT = 1 << 20


class Node:
    __slots__ = ("label", "children", "into", "parent", "seen")

    def __init__(self, label: str, parent: Node | None = None):
        self.label, self.parent = label, parent
        self.children: list[Node] = []
        self.into: Node | None = None  # the node that this one has become
        self.seen = False

    def grow(self) -> None:
        """Takes its place among its parent's children, which are in the order of their first text."""
        node = self
        while node.parent is not None and not node.seen:
            node.seen = True
            node.parent.children.append(node)
            node = node.parent

    def now(self) -> Node:
        node = self
        while node.into is not None:
            node = node.into
        return node


class Pairs:
    """The nodes of two trees by kind (equal subtrees are of one kind), and how many nodes
    of two kinds match.  ``KEPT`` scores are remembered, others are computed again."""

    def __init__(self, a: Node, b: Node):
        self.kind: dict[int, int] = {}  # by a node's id
        self.label: list[str] = []
        self.below: list[tuple[int, ...]] = []
        self.size: list[int] = []
        self._numbers: dict[tuple, int] = {}
        self._number(a)
        self._number(b)
        self.score = lru_cache(KEPT)(self._score)

    def _number(self, node: Node) -> int:
        below = tuple(map(self._number, node.children))
        new = len(self.label)
        kind = self.kind[id(node)] = self._numbers.setdefault((node.label, below), new)
        if kind == new:
            self.label.append(node.label)
            self.below.append(below)
            self.size.append(1 + sum(self.size[k] for k in below))
        return kind

    def _score(self, x: int, y: int) -> int:
        if self.label[x] != self.label[y]:
            return 0
        if x == y:
            return self.size[x]
        xs, ys, head, tail = self._middle(x, y)
        ends = sum(self.size[k] for k in (*self.below[x][:head], *self.below[x][len(self.below[x]) - tail:]))
        row = None
        for row in self._rows(xs, ys, self._weights(ys)):
            pass
        return 1 + ends + (0 if row is None else int(row[0]))

    def places(self, a: Node, b: Node) -> list[tuple[int, int]]:
        """Which children of two matched nodes match, in order."""
        x, y = self.kind[id(a)], self.kind[id(b)]
        if x == y:
            return [(i, i) for i in range(len(self.below[x]))]
        xs, ys, head, tail = self._middle(x, y)
        n, m = len(self.below[x]), len(self.below[y])
        return [*((i, i) for i in range(head)), *((i + head, j + head) for i, j in self._path(xs, ys)), *((n - k, m - k) for k in range(tail, 0, -1))]

    def _middle(self, x: int, y: int) -> tuple[tuple[int, ...], tuple[int, ...], int, int]:
        """The children without the equal ones at either end, which match in a best alignment."""
        xs, ys, head, tail = self.below[x], self.below[y], 0, 0
        most = min(len(xs), len(ys))
        while head < most and xs[head] == ys[head]:
            head += 1
        while tail < most - head and xs[-1 - tail] == ys[-1 - tail]:
            tail += 1
        return xs[head:len(xs) - tail], ys[head:len(ys) - tail], head, tail

    def _weights(self, ys: tuple[int, ...]) -> Callable[[int], np.ndarray | None]:
        """Of a kind, how much of each of ``ys`` matches; None if no label does."""
        kinds = list(dict.fromkeys(ys))
        at = {k: i for i, k in enumerate(kinds)}
        spots = np.array([at[k] for k in ys], np.int64)
        by_label: dict[str, list[int]] = {}
        for i, k in enumerate(kinds):
            by_label.setdefault(self.label[k], []).append(i)

        @lru_cache(1 + KEPT // max(1, len(ys)))
        def of(x: int) -> np.ndarray | None:
            alike = by_label.get(self.label[x])
            if not alike:
                return None
            w = np.zeros(len(kinds), np.int64)
            w[alike] = [self.score(x, kinds[i]) for i in alike]
            return w[spots]

        return of

    @staticmethod
    def _rows(xs: tuple[int, ...], ys: tuple[int, ...], weights: Callable, row: np.ndarray | None = None) -> Iterator[np.ndarray]:
        """From the last of ``xs`` on: the best sums of the children from there, and from each of ``ys`` on."""
        row = np.zeros(len(ys) + 1, np.int64) if row is None else row
        for x in reversed(xs if len(ys) else ()):
            w = weights(x)
            if w is not None:
                best = np.maximum(row[:-1], w + row[1:])
                row = np.append(np.maximum.accumulate(best[::-1])[::-1], 0)
            yield row

    def _path(self, xs: tuple[int, ...], ys: tuple[int, ...]) -> list[tuple[int, int]]:
        """A best alignment; of all rows only every so many are kept, those between are computed again."""
        n, m, weights = len(xs), len(ys), self._weights(ys)
        if not n or not m:
            return []
        step = isqrt(n) + 1
        kept = {n: np.zeros(m + 1, np.int64)}
        for i, row in zip(range(n - 1, -1, -1), self._rows(xs, ys, weights), strict=True):
            if i % step == 0:
                kept[i] = row
        found, i, j = [], 0, 0
        while i < n and j < m:
            end = min(n, i - i % step + step)
            rows = [kept[end], *self._rows(xs[i:end], ys, weights, kept[end])]
            while i < end and j < m:
                here, below, w = rows[end - i], rows[end - i - 1], weights(xs[i])
                if w is not None and w[j] and here[j] == w[j] + below[j + 1]:
                    found.append((i, j))
                    i, j = i + 1, j + 1
                elif here[j] == below[j]:
                    i += 1
                else:
                    j += 1
        return found


def match(a: Node, b: Node, pairs: Pairs) -> int:
    """How many nodes match."""
    return pairs.score(pairs.kind[id(a)], pairs.kind[id(b)])


def _absorb(a: Node, b: Node, pairs: Pairs) -> None:
    b.into = a
    own = pairs.places(a, b)
    children: list[Node] = []
    i = j = 0
    for p, q in [*own, (len(a.children), len(b.children))]:
        children += a.children[i:p] + b.children[j:q]
        if p < len(a.children):
            _absorb(a.children[p], b.children[q], pairs)
            children.append(a.children[p])
        i, j = p + 1, q + 1
    a.children = children


def merge(a: Node, b: Node) -> None:
    """Puts ``b`` into ``a``, whose label is the same."""
    _absorb(a, b, Pairs(a, b))


def fold(nodes: list[Node]) -> None:
    """Makes repeated records one node below each of ``nodes``, which are in order of their beginnings."""
    for node in reversed(nodes):
        kept: list[Node] = []
        leaves: dict[str, Node] = {}
        last = None  # the last child with elements of its own
        for c in node.children:
            if not c.children:
                if c.label in leaves:
                    c.into = leaves[c.label]
                    continue
                leaves[c.label] = c
            else:
                if last is not None and last.label == c.label:
                    pairs = Pairs(last, c)
                    if 2 * match(last, c, pairs) >= max(pairs.size[pairs.kind[id(n)]] for n in (last, c)):
                        _absorb(last, c, pairs)
                        continue
                last = c
            kept.append(c)
        node.children = kept


def preorder(root: Node) -> list[Node]:
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(reversed(node.children))
    return out


def dumps(root: Node) -> str:
    def plain(a: Node) -> list:
        return [a.label, *map(plain, a.children)]

    return json.dumps(plain(root), separators=(",", ":"), ensure_ascii=False)


def loads(text: str) -> Node:
    def node(a: list) -> Node:
        out = Node(a[0])
        out.children = [node(x) for x in a[1:]]
        return out

    return node(json.loads(text))


def template(skeletons: list[str]) -> str:
    """One tree that holds all of them; the largest come first, so order of rows does not matter."""
    first, *others = sorted(set(skeletons), key=lambda t: (-len(t), t))
    root = loads(first)
    for t in others:
        merge(root, loads(t))
    return dumps(root)


def places(root: Node, numbers: dict[int, int], skeleton: Node) -> list[int]:
    """For each node of a skeleton, in preorder, the number of the template's node that
    it matches (else its parent's).  ``numbers`` are those of ``root``'s nodes by ``id``."""
    pairs = Pairs(root, skeleton)
    out: list[int] = []

    def walk(a: Node | None, b: Node, above: int) -> None:
        own = above if a is None else numbers[id(a)]
        out.append(own)
        found = {} if a is None else {j: i for i, j in pairs.places(a, b)}
        for j, c in enumerate(b.children):
            walk(a.children[found[j]] if a is not None and j in found else None, c, own)

    walk(root, skeleton, 0)
    return out
