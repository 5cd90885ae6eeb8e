"""Compressed radix trie over byte strings whose terminals keep owners, with spill by subtree."""

from __future__ import annotations

import pickle
import tempfile
from collections.abc import Iterable, Iterator
from typing import BinaryIO


class Terminal:
    """What ends at one string: the owner's rank and payload, how many rows, and every member."""

    __slots__ = ("best", "count", "members")

    def __init__(self) -> None:
        self.best: tuple | None = None
        self.count = 0
        self.members: list = []

    def add(self, rank: tuple, count: int, member) -> None:
        if self.best is None or rank < self.best:
            self.best = rank
        self.count += count
        self.members.append(member)


class _Node:
    __slots__ = ("children", "label", "spill", "terminal")

    def __init__(self, label: bytes) -> None:
        self.label = label
        self.children: dict[int, _Node] | None = None
        self.terminal: Terminal | None = None
        self.spill: BinaryIO | None = None


def _common(label: bytes, key: bytes, at: int) -> int:
    """Length of the common prefix of ``label`` and ``key[at:]``, by bisection."""
    low, high = 0, min(len(label), len(key) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if key.startswith(label[low:mid], at + low):
            low = mid
        else:
            high = mid - 1
    return low


class PatriciaTrie:
    """Insert strings; read each distinct string's terminal with ``terminals()``.

    ``budget`` bounds the bytes held in memory. Beyond it the heaviest subtree is
    written to a temporary file, later strings that reach it are appended there,
    and it is rebuilt by itself, by the same rule, once the input has ended.
    """

    NODE_COST = 400

    def __init__(self, budget: int = 96 << 20) -> None:
        self.budget = budget
        self.held = 0
        self.spills = 0
        self.root = _Node(b"")

    def insert(self, key: bytes, rank: tuple, count: int, member) -> None:
        node, at, size = self.root, 0, len(key)
        while True:
            if node.spill is not None:
                pickle.dump((key[at:], rank, count, member), node.spill)
                return
            if at == size:
                break
            children = node.children
            if children is None:
                children = node.children = {}
            child = children.get(key[at])
            if child is None:
                child = children[key[at]] = _Node(key[at:])
                self.held += len(child.label) + self.NODE_COST
                node, at = child, size
                break
            label = child.label
            if key.startswith(label, at):
                node, at = child, at + len(label)
                continue
            shared = _common(label, key, at)
            upper = children[key[at]] = _Node(label[:shared])
            child.label = label[shared:]
            upper.children = {child.label[0]: child}
            self.held += self.NODE_COST
            node, at = upper, at + shared
        if node.terminal is None:
            node.terminal = Terminal()
        node.terminal.add(rank, count, member)
        self.held += 100
        if self.held > self.budget:
            self._spill()

    @staticmethod
    def _walk(top: _Node, prefix: bytes = b"") -> Iterator[tuple[bytes, _Node]]:
        stack = [(prefix, top)]
        while stack:
            path, node = stack.pop()
            yield path, node
            if node.children:
                stack += [(path + c.label, c) for c in node.children.values()]

    @classmethod
    def _weight(cls, top: _Node) -> int:
        total, stack = 0, [top]
        while stack:
            node = stack.pop()
            total += len(node.label) + cls.NODE_COST + (100 * len(node.terminal.members) if node.terminal else 0)
            if node.children:
                stack += node.children.values()
        return total

    def _spill(self) -> None:
        node = self.root
        while True:
            open_ = [(self._weight(c), i) for i, c in (node.children or {}).items() if c.spill is None and c.children]
            if not open_:
                self.budget = max(self.budget, 2 * self.held)  # single strings only: nothing left to split
                return
            weight, first = max(open_)
            child = node.children[first]
            if len(node.children) == 1 and child.terminal is None:
                node = child
                continue
            break
        child.spill = tempfile.TemporaryFile()
        for path, inner in self._walk(child):
            if inner.spill is not None and inner is not child:
                inner.spill.seek(0)
                for suffix, rank, count, member in _records(inner.spill):
                    pickle.dump((path + suffix, rank, count, member), child.spill)
                inner.spill.close()
            if inner.terminal is not None:
                done = inner.terminal
                pickle.dump((path, done.best, done.count, done.members), child.spill)
        child.children = child.terminal = None
        self.held -= weight
        self.spills += 1

    def terminals(self) -> Iterator[Terminal]:
        """Every distinct string's terminal, spilled subtrees after those in memory."""
        spilled = []
        for _, node in self._walk_nodes():
            if node.spill is not None:
                spilled.append(node.spill)
            elif node.terminal is not None:
                yield node.terminal
        self.root = _Node(b"")
        self.held = 0
        for file in spilled:
            file.seek(0)
            part = PatriciaTrie(self.budget)
            part.insert_all(_records(file))
            file.close()
            yield from part.terminals()

    def insert_all(self, records: Iterable[tuple]) -> None:
        for suffix, rank, count, member in records:
            self.insert(suffix, rank, count, member)

    def _walk_nodes(self) -> Iterator[tuple[None, _Node]]:
        stack = [self.root]
        while stack:
            node = stack.pop()
            yield None, node
            if node.children:
                stack += node.children.values()


def flat_members(members: list) -> Iterator:
    """Members of a terminal; those that went through a spill are lists of members."""
    for m in members:
        if isinstance(m, list):
            yield from flat_members(m)
        else:
            yield m


def _records(file: BinaryIO) -> Iterator[tuple]:
    while True:
        try:
            yield pickle.load(file)
        except EOFError:
            return
