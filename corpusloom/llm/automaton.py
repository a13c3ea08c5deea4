"""A suffix automaton over words, for several reference texts at once."""

from __future__ import annotations

from collections.abc import Sequence


class SuffixAutomaton:
    """Accepts every run of words of the texts added; states number at most twice their words."""

    def __init__(self) -> None:
        self.step: list[dict] = [{}]
        self.back: list[int] = [-1]
        self.size: list[int] = [0]

    def _state(self, size: int, back: int, step: dict) -> int:
        self.step.append(step)
        self.back.append(back)
        self.size.append(size)
        return len(self.step) - 1

    def _split(self, p: int, word, q: int) -> int:
        """The part of state q that p reaches by `word` gets a state of its own."""
        twin = self._state(self.size[p] + 1, self.back[q], dict(self.step[q]))
        self.back[q] = twin
        while p >= 0 and self.step[p].get(word) == q:
            self.step[p][word] = twin
            p = self.back[p]
        return twin

    def _extend(self, last: int, word) -> int:
        q = self.step[last].get(word)
        if q is not None:
            return q if self.size[q] == self.size[last] + 1 else self._split(last, word, q)
        new, p = self._state(self.size[last] + 1, 0, {}), last
        while p >= 0 and word not in self.step[p]:
            self.step[p][word] = new
            p = self.back[p]
        if p >= 0:
            q = self.step[p][word]
            self.back[new] = q if self.size[q] == self.size[p] + 1 else self._split(p, word, q)
        return new

    def add(self, words: Sequence) -> None:
        last = 0
        for w in words:
            last = self._extend(last, w)

    def matching(self, words: Sequence) -> list[int]:
        """For each word, the length of the longest run that ends there and occurs in a text added."""
        at, n, out = 0, 0, []
        step, back, size = self.step, self.back, self.size
        for w in words:
            while at and w not in step[at]:
                at = back[at]
                n = size[at]
            if w in step[at]:
                at = step[at][w]
                n += 1
            else:
                n = 0
            out.append(n)
        return out
