"""A generalised suffix automaton over the words of many passages."""

from __future__ import annotations


class Automaton:
    """Accepts every run of words of every passage.

    ``longest(ids)`` streams a text once and gives, at every word, the length of the
    longest run that ends there and occurs in some passage, with the state reached.
    ``places(state)`` lists (passage, position of the run's last word).
    """

    def __init__(self, passages: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[list[tuple[int, int]]] = [[]]
        for number, ids in enumerate(passages):
            last = 0  # every passage starts anew, so no run crosses two of them
            for at, word in enumerate(ids):
                last = self._extend(last, word, ends)
                ends[last].append((number, at))
        self._lay_out(ends)

    def _new(self, length: int, nxt: dict[int, int], link: int, ends: list) -> int:
        self.next.append(nxt)
        self.length.append(length)
        self.link.append(link)
        ends.append([])
        return len(self.next) - 1

    def _split(self, p: int, word: int, q: int, ends: list) -> int:
        """The state for the runs of q that also continue p; q itself if it has no longer ones."""
        if self.length[p] + 1 == self.length[q]:
            return q
        clone = self._new(self.length[p] + 1, dict(self.next[q]), self.link[q], ends)
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, word: int, ends: list) -> int:
        if (q := self.next[last].get(word)) is not None:
            return self._split(last, word, q, ends)
        cur, p = self._new(self.length[last] + 1, {}, 0, ends), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = cur
            p = self.link[p]
        if p >= 0:
            self.link[cur] = self._split(p, word, self.next[p][word], ends)
        return cur

    def _lay_out(self, ends: list[list[tuple[int, int]]]) -> None:
        """Orders all places by the tree of suffix links: the places of a state are one slice."""
        below: list[list[int]] = [[] for _ in self.link]
        for v, p in enumerate(self.link):
            if p >= 0:
                below[p].append(v)
        self._places: list[tuple[int, int]] = []
        self._from, self._to = [0] * len(self.link), [0] * len(self.link)
        stack = [(0, False)]
        while stack:
            v, left = stack.pop()
            if left:
                self._to[v] = len(self._places)
                continue
            self._from[v] = len(self._places)
            self._places += ends[v]
            stack.append((v, True))
            stack += [(w, False) for w in below[v]]

    def places(self, state: int) -> list[tuple[int, int]]:
        return self._places[self._from[state] : self._to[state]]

    def suffix(self, state: int, words: int) -> int:
        """The state of the last ``words`` words of a match in ``state`` that is at least as long."""
        while self.length[self.link[state]] >= words:
            state = self.link[state]
        return state

    def longest(self, ids):
        """Yields (matched length, state) for each word; -1 stands for a word of no passage."""
        nxt, link, length = self.next, self.link, self.length
        state = n = 0
        for word in ids:
            if word < 0:
                state = n = 0
            else:
                while (to := nxt[state].get(word)) is None and state:
                    state = link[state]
                    n = length[state]
                if to is None:
                    n = 0
                else:
                    state, n = to, n + 1
            yield n, state
