"""Syntax tree: one node class with a kind and named parts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any


class Node:
    def __init__(self, kind: str, **parts: Any) -> None:
        self.kind = kind
        self.parts = parts

    def __getattr__(self, name: str) -> Any:
        try:
            return self.__dict__["parts"][name]
        except KeyError:
            raise AttributeError(name) from None

    def get(self, name: str, default: Any = None) -> Any:
        return self.parts.get(name, default)

    def __repr__(self) -> str:
        return f"{self.kind}({', '.join(f'{k}={v!r}' for k, v in self.parts.items())})"

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Node) and (self.kind, self.parts) == (other.kind, other.parts)

    def __hash__(self) -> int:
        return hash(repr(self))

    def walk(self) -> Iterator[Node]:
        yield self
        for v in self.parts.values():
            for x in _flat(v):
                yield from x.walk()

    def map(self, f: Callable[[Node], Node]) -> Node:
        """A copy in which f was applied to every node, children first."""
        return f(Node(self.kind, **{k: _map(v, f) for k, v in self.parts.items()}))


def _flat(v: Any) -> Iterator[Node]:
    if isinstance(v, Node):
        yield v
    elif isinstance(v, (list, tuple)):
        for x in v:
            yield from _flat(x)


def _map(v: Any, f: Callable[[Node], Node]) -> Any:
    if isinstance(v, Node):
        return v.map(f)
    if isinstance(v, (list, tuple)):
        return type(v)(_map(x, f) for x in v)
    return v
