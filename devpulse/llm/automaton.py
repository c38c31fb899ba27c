"""A generalised suffix automaton that is built online."""

from __future__ import annotations

from collections.abc import Hashable, Sequence


class SuffixAutomaton:
    """All substrings of the token sequences added so far."""

    def __init__(self) -> None:
        self.arcs: list[dict[Hashable, int]] = [{}]
        self.link = [-1]
        self.length = [0]

    def _split(self, p: int, token: Hashable, q: int) -> int:
        arcs, link = self.arcs, self.link
        clone = len(arcs)
        arcs.append(dict(arcs[q]))
        link.append(link[q])
        self.length.append(self.length[p] + 1)
        link[q] = clone
        while p >= 0 and arcs[p].get(token) == q:
            arcs[p][token] = clone
            p = link[p]
        return clone

    def extend(self, last: int, token: Hashable) -> int:
        """Add the sequence that ends in state ``last`` plus ``token``; returns its state."""
        arcs, link, length = self.arcs, self.link, self.length
        q = arcs[last].get(token)
        if q is not None:
            return q if length[q] == length[last] + 1 else self._split(last, token, q)
        state = len(arcs)
        arcs.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and token not in arcs[p]:
            arcs[p][token] = state
            p = link[p]
        if p >= 0:
            q = arcs[p][token]
            link[state] = q if length[q] == length[p] + 1 else self._split(p, token, q)
        return state

    def add(self, tokens: Sequence[Hashable]) -> list[int]:
        """Add a sequence; for each of its tokens the length of the longest run that ends there and also ended earlier.

        Earlier is an earlier sequence or an earlier place in this one.
        """
        last, matched = 0, []
        for i, token in enumerate(tokens, 1):
            met = token in self.arcs[last]
            last = self.extend(last, token)
            # a known arc: the whole beginning of the sequence was there before
            matched.append(i if met else self.length[self.link[last]])
        return matched
