"""Generalised suffix automaton of token sequences, and what streaming text through it yields."""

from __future__ import annotations

from collections.abc import Hashable, Iterable, Sequence

import numpy as np


class SuffixAutomaton:
    """Accepts every substring of the given sequences; `own` finds those of `least` tokens or more.

    Which sequences hold a state's substrings, and where, is read off the tree of suffix links: its ancestors mark a prefix's
    substrings, so memory stays near the sequences' size, however they repeat themselves.
    """

    def __init__(self, sequences: Iterable[Sequence[Hashable]], least: int = 1):
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]
        self.least = least
        self.sizes: list[int] = []
        self._paths: list[np.ndarray] = []
        for tokens in sequences:
            last, path = 0, []
            for token in tokens:
                last = self._extend(last, token)
                path.append(last)
            self.sizes.append(len(path))
            self._paths.append(np.array(path, np.int32))
        self._owners: list[list[int]] | None = None

    def _index(self) -> None:
        """Each state's sequences, its nearest ancestor that more of them hold, and its place in the tree of links."""
        n = len(self.next)
        owners: list[list[int]] = [[] for _ in range(n)]
        mark = [-1] * n
        for k, path in enumerate(self._paths):
            for state in path.tolist():
                while self.length[state] >= self.least and mark[state] != k:
                    mark[state] = k
                    owners[state].append(k)
                    state = self.link[state]
        order = sorted(range(1, n), key=self.length.__getitem__)
        jump, under = [0] * n, [1] * n
        for state in order:
            up = self.link[state]
            jump[state] = up if len(owners[up]) != len(owners[state]) else jump[up]
        for state in reversed(order):
            under[self.link[state]] += under[state]
        begin, free = [0] * n, [1] * n
        for state in order:
            up = self.link[state]
            begin[state] = begin[up] + free[up]
            free[up] += under[state]
        self._begin, self._under, self._jump = np.array(begin), under, jump
        self._places = [self._begin[path] for path in self._paths]
        self._owners = owners

    def _new(self, length: int, edges: dict, link: int) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _clone(self, p: int, q: int, token: Hashable) -> int:
        copy = self._new(self.length[p] + 1, dict(self.next[q]), self.link[q])
        while p != -1 and self.next[p].get(token) == q:
            self.next[p][token] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def _extend(self, last: int, token: Hashable) -> int:
        if token in self.next[last]:
            q = self.next[last][token]
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, q, token)
        new = self._new(self.length[last] + 1, {}, -1)
        p = last
        while p != -1 and token not in self.next[p]:
            self.next[p][token] = new
            p = self.link[p]
        if p == -1:
            self.link[new] = 0
        else:
            q = self.next[p][token]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, token)
        return new

    def matching(self, tokens: Sequence[Hashable]) -> list[tuple[int, int]]:
        """For each token, the length of the longest match that ends there, and its state."""
        out, state, length = [], 0, 0
        edges, link, size = self.next, self.link, self.length
        for token in tokens:
            while state and token not in edges[state]:
                state = link[state]
                length = size[state]
            to = edges[state].get(token)
            if to is not None:
                state = to
                length += 1
            out.append((length, state))
        return out

    def occurrences(self, state: int, length: int, sequence: int) -> list[tuple[int, int]]:
        """(start, end) in a sequence of the substring of that length that ends in the state."""
        if self._owners is None:
            self._index()
        at, lo = self._places[sequence], self._begin[state]
        return [(e + 1 - length, e + 1) for e in np.flatnonzero((at >= lo) & (at < lo + self._under[state])).tolist()]

    def own(self, tokens: Sequence[Hashable]) -> dict[int, list[tuple[int, int, int, int]]]:
        """Of each sequence: (start, end, start in it, end in it) of its own matches of at least `least` tokens that none of its own longer matches contains."""
        if self._owners is None:
            self._index()
        best: dict[int, dict[int, tuple[int, int]]] = {}
        for k, (n, state) in enumerate(self.matching(tokens), 1):
            seen: set[int] = set()
            while n >= self.least:
                for q in self._owners[state]:
                    if q not in seen:
                        seen.add(q)
                        best.setdefault(q, {})[k] = (n, state)
                state = self._jump[state]
                n = self.length[state]
        return {q: [(e - n, e, s, t) for e, (n, state) in ends.items() if ends.get(e + 1, (0, 0))[0] <= n for s, t in self.occurrences(state, n, q)] for q, ends in best.items()}
