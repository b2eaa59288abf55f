"""Path rules with ``*`` and a closing ``$`` as one automaton: all rules of a host in one walk over a path."""

from __future__ import annotations

from collections.abc import Iterable


class PathRules:
    """A trie of rules (allow, pattern); a rule matches a path that begins as it says.

    A node is a dictionary from characters to nodes; under ``None`` stands the node behind a ``*``, which
    stays open once it is reached.  The longest matching pattern decides, and allow wins ties.
    """

    def __init__(self, rules: Iterable[tuple[bool, str]]) -> None:
        self.root: dict = {}
        self.begun: dict[int, tuple[int, bool]] = {}  # by node: what matches once it is reached
        self.ended: dict[int, tuple[int, bool]] = {}  # and what matches only where the path ends
        self.nodes = [self.root]
        self.open: set[int] = set()
        for allow, pattern in rules:
            node, text = self.root, pattern.removesuffix("$")
            for c in text:
                key = None if c == "*" else c
                if key is None and id(node) in self.open:
                    continue  # one star says as much as several
                if key not in node:
                    node[key] = {}
                    self.nodes.append(node[key])  # keeps the ids unique
                    if key is None:
                        self.open.add(id(node[key]))
                node = node[key]
            marks = self.ended if text != pattern else self.begun
            marks[id(node)] = max(marks.get(id(node), (-1, False)), (len(pattern), allow))

    def allows(self, path: str) -> bool:
        best, live = (-1, True), self._reached(self.root)
        for c in path:
            for node in live:
                best = max(best, self.begun.get(id(node), best))
            if not live:
                return best[1]
            after: dict[int, dict] = {}
            for node in live:
                if id(node) in self.open:
                    after[id(node)] = node
                if c in node:
                    for x in self._reached(node[c]):
                        after[id(x)] = x
            live = list(after.values())
        for node in live:
            best = max(best, self.begun.get(id(node), best), self.ended.get(id(node), best))
        return best[1]

    @staticmethod
    def _reached(node: dict) -> list[dict]:
        out = [node]
        while None in out[-1]:
            out.append(out[-1][None])
        return out
