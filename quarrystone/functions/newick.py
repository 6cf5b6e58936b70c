"""Newick text to and from node lists, in plain Python."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

TOKEN = re.compile(r"\s*('(?:[^']|'')*'|\[[^\]]*\]|[(),:;]|[^\s(),:;'\[\]]+)")


@dataclass
class Tree:
    """Nodes by number; ``up`` of the root is -1. A child's number is larger than its parent's."""

    up: list[int] = field(default_factory=list)
    name: list[str] = field(default_factory=list)
    length: list[float | None] = field(default_factory=list)
    down: list[list[int]] = field(default_factory=list)

    def add(self, up: int, name: str = "", length: float | None = None) -> int:
        self.up.append(up)
        self.name.append(name)
        self.length.append(length)
        self.down.append([])
        if up >= 0:
            self.down[up].append(len(self.up) - 1)
        return len(self.up) - 1

    def leaves(self) -> list[int]:
        return [i for i, d in enumerate(self.down) if not d]

    def depths(self) -> list[int]:
        out = []
        for u in self.up:
            out.append(0 if u < 0 else out[u] + 1)
        return out

    def distances(self) -> list[float]:
        """Length of the way from the root to each node."""
        out: list[float] = []
        for u, x in zip(self.up, self.length):
            out.append((0.0 if u < 0 else out[u]) + (x or 0.0) * (u >= 0))
        return out

    def leaf_sets(self) -> list[frozenset[str]]:
        out: list[set[str]] = [set() if d else {n} for d, n in zip(self.down, self.name)]
        for i in range(len(self.up) - 1, 0, -1):
            out[self.up[i]] |= out[i]
        return [frozenset(s) for s in out]

    def leaf_counts(self) -> list[int]:
        out = [int(not d) for d in self.down]
        for i in range(len(self.up) - 1, 0, -1):
            out[self.up[i]] += out[i]
        return out

    def postorder(self) -> list[int]:
        out, stack = [], [(0, False)] if self.up else []
        while stack:
            node, done = stack.pop()
            if done or not self.down[node]:
                out.append(node)
            else:
                stack.append((node, True))
                stack.extend((c, False) for c in reversed(self.down[node]))
        return out


def parse(text: str) -> Tree:
    """A tree from Newick text; comments in brackets are skipped, quoted names unquoted."""
    tokens = [t for t in TOKEN.findall(text) if not t.startswith("[")]
    tree = Tree()
    node = tree.add(-1)
    at = 0
    while at < len(tokens):
        t = tokens[at]
        if t == "(":
            node = tree.add(node)
        elif t == ",":
            if tree.up[node] < 0:
                raise ValueError("a comma outside parentheses")
            node = tree.add(tree.up[node])
        elif t == ")":
            node = tree.up[node]
            if node < 0:
                raise ValueError("parentheses do not match")
        elif t == ":":
            at += 1
            tree.length[node] = float(tokens[at])
        elif t == ";":
            break
        else:
            tree.name[node] = t[1:-1].replace("''", "'") if t[0] == "'" else t
        at += 1
    if node != 0:
        raise ValueError("parentheses do not match")
    return tree


def label(text: str) -> str:
    """A name as it may stand in Newick text."""
    return re.sub(r"[^A-Za-z0-9_.@=|{}-]+", "_", text)


def write(tree: Tree, names: list[str] | None = None, lengths: bool = True) -> str:
    names = names or tree.name
    parts: dict[int, str] = {}
    for i in tree.postorder():
        inside = "(" + ",".join(parts.pop(c) for c in tree.down[i]) + ")" if tree.down[i] else ""
        tail = f":{tree.length[i]:.10g}" if lengths and tree.length[i] is not None and i else ""
        parts[i] = inside + label(names[i]) + tail
    return parts[0] + ";"
