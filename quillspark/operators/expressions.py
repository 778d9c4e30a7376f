"""Feature programs: expression trees over columns, their flat form and their Columns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column

from ..functions.scalars import REGISTRY

PROGRAM_SCHEMA = "feature_id int, depth int, ops array<struct<op:string,depth:int>>, ids array<int>, name string"


@dataclass(frozen=True)
class Leaf:
    """An input column by its place."""

    index: int

    @property
    def depth(self) -> int:
        return 0

    def column(self, inputs: Sequence[Column]) -> Column:
        return inputs[self.index]

    def name(self, names: Sequence[str]) -> str:
        return names[self.index]


@dataclass(frozen=True)
class Call:
    """An operator on one or two trees."""

    op: str
    args: tuple[Leaf | Call, ...]

    @property
    def depth(self) -> int:
        return 1 + max(a.depth for a in self.args)

    def column(self, inputs: Sequence[Column]) -> Column:
        return REGISTRY[self.op].build(*(a.column(inputs) for a in self.args))

    def name(self, names: Sequence[str]) -> str:
        sign = REGISTRY[self.op].sign
        parts = [a.name(names) for a in self.args]
        return f"({sign.join(parts)})" if sign else f"{self.op}({','.join(parts)})"


Tree = Leaf | Call


@dataclass(frozen=True)
class Program:
    """A tree laid out flat: operators children first, each with the levels below its own, and leaves left to right."""

    depth: int
    ops: tuple[tuple[str, int], ...]
    ids: tuple[int, ...]


def encode(tree: Tree) -> Program:
    ops: list[tuple[str, int]] = []
    ids: list[int] = []

    def visit(node: Tree, below: int) -> None:
        if isinstance(node, Leaf):
            ids.append(node.index)
            return
        for arg in node.args:
            visit(arg, below - 1)
        ops.append((node.op, below - 1))

    visit(tree, tree.depth)
    return Program(tree.depth, tuple(ops), tuple(ids))


def decode(program: Program) -> Tree:
    """The tree whose flat form this is; all leaves are ``depth`` levels deep."""
    leaves = iter(program.ids)
    held: list[tuple[Tree, int]] = []  # finished trees with their heights
    for op, below in program.ops:
        arity = REGISTRY[op].arity
        while len(held) < arity or any(height != below for _, height in held[len(held) - arity :]):
            held.append((Leaf(next(leaves)), 0))
        args = tuple(tree for tree, _ in held[len(held) - arity :])
        del held[len(held) - arity :]
        held.append((Call(op, args), below + 1))
    if not program.ops:
        return Leaf(next(leaves))
    if len(held) != 1 or next(leaves, None) is not None:
        raise ValueError("not the flat form of a tree")
    return held[0][0]


def row(feature_id: int, tree: Tree, names: Sequence[str]) -> tuple:
    """A row of PROGRAM_SCHEMA."""
    program = encode(tree)
    return (feature_id, program.depth, [{"op": o, "depth": d} for o, d in program.ops], list(program.ids), tree.name(names))
