"""Suffix automata of several sequences, and matching statistics of others against them."""

from __future__ import annotations

from collections.abc import Iterable, Iterator


class SuffixAutomaton:
    """All substrings of the sequences added so far, in at most two states a symbol. A state has its transitions, the
    length of its longest substring, and a link to the state of the longest suffix that stands elsewhere too."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]

    def _state(self, moves: dict, link: int, length: int) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, c: int) -> int:
        """The state after ``c`` from p, for substrings no longer than p's with ``c``; a copy takes over where that needs one."""
        q = self.next[p][c]
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(dict(self.next[q]), self.link[q], self.length[p] + 1)
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def add(self, symbols: Iterable[int]) -> None:
        last = 0
        for c in symbols:
            if c in self.next[last]:
                last = self._split(last, c)
                continue
            new, p = self._state({}, 0, self.length[last] + 1), last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = new
                p = self.link[p]
            if p >= 0:
                self.link[new] = self._split(p, c)
            last = new

    def statistics(self, symbols: Iterable[int]) -> Iterator[int]:
        """For each symbol the length of the longest substring that ends there and stands in an added sequence."""
        state, n = 0, 0
        for c in symbols:
            while state and c not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            if c in self.next[state]:
                state, n = self.next[state][c], n + 1
            yield n
