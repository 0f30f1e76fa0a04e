"""Generalised suffix automaton of a few texts, and the longest runs that another text shares with each of them."""

from __future__ import annotations


class SuffixAutomaton:
    """States are sets of runs that end at the same places of the texts; `owners` of a state are the texts that have a prefix ending there."""

    def __init__(self, texts: list[str]):
        self.ways: list[dict[str, int]] = [{}]
        self.longest, self.link = [0], [-1]
        self.owners: dict[int, list[int]] = {}
        for number, text in enumerate(texts):
            at = 0
            for c in text:
                at = self._read(at, c)
                held = self.owners.setdefault(at, [])
                if not held or held[-1] != number:
                    held.append(number)
        self.children: dict[int, list[int]] = {}
        for state in range(1, len(self.link)):
            self.children.setdefault(self.link[state], []).append(state)
        self._texts: dict[int, frozenset[int]] = {}

    def _split(self, p: int, q: int, c: str) -> int:
        """The state of the runs of p followed by c, where those of q are longer."""
        ways, link = self.ways, self.link
        copy = len(ways)
        ways.append(dict(ways[q]))
        self.longest.append(self.longest[p] + 1)
        link.append(link[q])
        link[q] = copy
        while p >= 0 and ways[p].get(c) == q:
            ways[p][c] = copy
            p = link[p]
        return copy

    def _read(self, p: int, c: str) -> int:
        ways, longest, link = self.ways, self.longest, self.link
        q = ways[p].get(c)
        if q is not None:  # another text has come this way
            return q if longest[q] == longest[p] + 1 else self._split(p, q, c)
        new = len(ways)
        ways.append({})
        longest.append(longest[p] + 1)
        link.append(0)
        while p >= 0 and c not in ways[p]:
            ways[p][c] = new
            p = link[p]
        if p >= 0:
            q = ways[p][c]
            link[new] = q if longest[q] == longest[p] + 1 else self._split(p, q, c)
        return new

    def texts(self, state: int) -> frozenset[int]:
        """The texts that hold a state's runs; found once for each state that is asked for."""
        known, waiting = self._texts, [state]
        while waiting:
            s = waiting[-1]
            missing = [c for c in self.children.get(s, ()) if c not in known]
            if missing:
                waiting += missing
                continue
            waiting.pop()
            if s not in known:
                known[s] = frozenset(self.owners.get(s, ())).union(*(known[c] for c in self.children.get(s, ())))
        return known[state]

    def common_runs(self, text: str, least: int) -> dict[int, int]:
        """The length of the longest run that each of the automaton's texts shares with this one, from `least` characters on.

        One walk over the text; the longest match at each state, and the whole of each state behind it on the suffix links, then name
        the texts that hold them, longest first.
        """
        ways, longest, link = self.ways, self.longest, self.link
        state = size = 0
        best: dict[int, int] = {}
        for c in text:
            while c not in ways[state]:
                state = link[state]
                if state < 0:
                    break
                size = longest[state]
            if state < 0:
                state = size = 0
                continue
            state = ways[state][c]
            size += 1
            if size >= least and best.get(state, 0) < size:
                best[state] = size
        for state in list(best):
            above = link[state]
            while above > 0 and longest[above] >= least and best.get(above, 0) < longest[above]:
                best[above] = longest[above]
                above = link[above]
        out: dict[int, int] = {}
        for state, size in sorted(best.items(), key=lambda x: -x[1]):
            for number in self.texts(state):
                out.setdefault(number, size)
        return out
