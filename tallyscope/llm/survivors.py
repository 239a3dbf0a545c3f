"""Cheapest edits of a sequence by a Viterbi search that gives up its memory as survivors coalesce.

A path is a string of edits; of two paths equally cheap the ASCII-least counts. Each state keeps one
survivor, a leaf of a tree of back pointers with reference counts. A node that no survivor needs goes at
once, and as soon as all survivors share an ancestor, the edits up to it are decided and leave the tree. What
is kept is the unresolved part alone.

Tied paths are compared by their complete unresolved suffixes. Every label ends in an edit that uses up an
element, so two paths of one step never are prefixes of each other, and their order is that of their
parents, or of their last labels under one parent. Each survivor carries its place in that order: a
comparison of whole suffixes that is carried on from step to step instead of walked again.

A survivor that another one beats whatever comes goes as well; else a state that can't be left for good, such
as the one before the first output, would hold the tree together from its start.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

#: (next state, cost, label): how a step can leave a state.
Move = tuple[int, int, str]


class Node:
    __slots__ = ("parent", "label", "refs", "children")

    def __init__(self, parent: Node | None, label: str) -> None:
        self.parent, self.label, self.refs, self.children = parent, label, 0, []


class Survivors:
    """The search after some steps; ``emit`` gets each decided label, in order.

    ``catch_up[a][b]``: what a path in state b pays at most, beyond what one in state a pays, for whatever
    comes. A survivor dearer than another one by more than that can neither win nor tie.
    """

    def __init__(self, state: int, emit: Callable[[str], None], catch_up: Sequence[Sequence[int]] | None = None) -> None:
        self.root = Node(None, "")
        self.root.refs = 1
        self.leaves: dict[int, tuple[int, int, Node]] = {state: (0, 0, self.root)}  # cost, place in order, node
        self.emit, self.catch_up = emit, catch_up

    def step(self, moves: Sequence[Iterable[Move]]) -> None:
        """Use up one element; ``moves[state]`` are the ways on."""
        best: dict[int, tuple[int, int, str, Node]] = {}
        for state, (cost, place, node) in self.leaves.items():
            for to, more, label in moves[state]:
                way = (cost + more, place, label, node)
                old = best.get(to)
                if old is None or way[:3] < old[:3]:
                    best[to] = way
        if self.catch_up:
            reach = [min(way[0] + self.catch_up[a][b] for b, way in best.items()) for a in range(len(self.catch_up))]
            best = {to: way for to, way in best.items() if way[0] <= reach[to]}
        old_leaves, self.leaves = self.leaves, {}
        order = {key: i for i, key in enumerate(sorted({(w[1], w[2]) for w in best.values()}))}
        for to, (cost, place, label, parent) in best.items():
            node = Node(parent, label)
            node.refs = 1
            parent.refs += 1
            parent.children.append(node)
            self.leaves[to] = (cost, order[place, label], node)
        for _, _, node in old_leaves.values():
            self.release(node)
        self.settle()

    def release(self, node: Node) -> None:
        """Drop one reference; nodes without any go, up to the first one still needed."""
        node.refs -= 1
        while node.refs == 0 and node.parent is not None:
            parent = node.parent
            parent.children.remove(node)
            parent.refs -= 1
            node = parent

    def settle(self) -> None:
        """Emit what all survivors share."""
        root = self.root
        while root.refs == 1 and root.children:
            root = root.children[0]
            root.parent = None
            self.emit(root.label)
        self.root = root

    def suffix(self, node: Node) -> list[str]:
        """The unresolved labels up to a node."""
        out = []
        while node is not self.root:
            out.append(node.label)
            node = node.parent
        return out[::-1]

    def best(self, ends: dict[int, tuple[int, str]]) -> tuple[int, int, list[str]]:
        """The cheapest finish: state, cost and unresolved labels, the end's own last."""
        cost, _, label, state = min(
            (cost + ends[state][0], place, ends[state][1], state) for state, (cost, place, _) in self.leaves.items() if state in ends
        )
        return state, cost, [*self.suffix(self.leaves[state][2]), label]
