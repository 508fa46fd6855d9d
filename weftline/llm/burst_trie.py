"""Compact counting trie whose leaves are small hash containers that burst when they fill."""

from __future__ import annotations

from collections.abc import Iterator


class BurstTrie:
    """Counts (occurrences, records) per term.

    Inner nodes are dictionaries from one character to a child; a leaf is a
    container ``{suffix: [occurrences, records]}``. A container that holds more
    than ``burst_at`` suffixes is replaced by an inner node, so dense prefixes
    become paths and sparse ones stay in one flat container.
    """

    __slots__ = ("burst_at", "root")

    def __init__(self, burst_at: int = 512) -> None:
        self.burst_at = burst_at
        self.root: tuple[dict, dict] = ({}, {})

    def add(self, term: str, occurrences: int, records: int) -> None:
        children, container = self.root
        depth = 0
        while depth < len(term) and (child := children.get(term[depth])) is not None:
            children, container = child
            depth += 1
        suffix = term[depth:]
        cell = container.get(suffix)
        if cell is not None:
            cell[0] += occurrences
            cell[1] += records
            return
        container[suffix] = [occurrences, records]
        if len(container) > self.burst_at:
            self._burst(children, container)

    def _burst(self, children: dict, container: dict) -> None:
        """Move every suffix one character down, and again where that fills one child; the empty suffix stays."""
        for suffix in [s for s in container if s]:
            child = children.setdefault(suffix[0], ({}, {}))
            child[1][suffix[1:]] = container.pop(suffix)
        for grandchildren, moved in list(children.values()):
            if len(moved) > self.burst_at and any(moved):
                self._burst(grandchildren, moved)

    def leaves(self) -> Iterator[tuple[str, dict]]:
        """(prefix, container) of every node that holds terms, in trie order."""
        stack = [("", self.root)]
        while stack:
            prefix, (children, container) = stack.pop()
            if container:
                yield prefix, container
            stack.extend((prefix + c, children[c]) for c in sorted(children, reverse=True))
