"""A property graph as DataFrames: one for each tag and one for each edge type.

A tag has `_vid` and its properties, one row for each vertex that carries it. An edge type has `_src`, `_rank`, `_dst`
and its properties, one row for each edge, kept once; reverse edges are the same rows with their ends swapped.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.errors import GraphError

KEYS = ("_src", "_rank", "_dst")


def alive(ttl: tuple[str, int] | None, now: int | None) -> Column | None:
    """A row lives until now is later than its TTL column plus the duration; null never expires.

    The column is compared with a number, so that the test reaches the scan.
    """
    if ttl is None or now is None:
        return None
    col, duration = ttl
    return F.col(col).isNull() | (F.col(col) >= F.lit(now - duration))


@dataclass(frozen=True)
class Table:
    name: str
    frame: DataFrame
    id: int = 0
    ttl: tuple[str, int] | None = None
    now: int | None = None

    @property
    def props(self) -> list[str]:
        return [c for c in self.frame.columns if c not in ("_vid", *KEYS)]

    def rows(self, expired: bool = False) -> DataFrame:
        """The rows, without expired ones unless they are asked for. The filter reaches the scan."""
        live = None if expired else alive(self.ttl, self.now)
        return self.frame if live is None else self.frame.where(live)


@dataclass(frozen=True)
class Graph:
    """now, in epoch seconds, decides what has expired; None switches expiry off."""

    tags: dict[str, Table] = field(default_factory=dict)
    edges: dict[str, Table] = field(default_factory=dict)

    @staticmethod
    def of(tags: dict[str, DataFrame], edges: dict[str, DataFrame], ttl: dict[str, tuple[str, int]] | None = None, now: int | None = None) -> Graph:
        ttl = ttl or {}
        made = [{n: Table(n, f, k, ttl.get(n), now) for k, (n, f) in enumerate(frames.items(), start)} for frames, start in ((tags, 1), (edges, 1 + len(tags)))]
        return Graph(*made)

    def tag(self, name: str) -> Table:
        if name not in self.tags:
            raise GraphError("TAG_NOT_FOUND", name)
        return self.tags[name]

    def edge(self, name: str) -> Table:
        if name not in self.edges:
            raise GraphError("EDGE_NOT_FOUND", name)
        return self.edges[name]


def checked(table: Table, props: list[str]) -> list[str]:
    for p in props:
        if p not in table.props:
            raise GraphError("PROP_NOT_FOUND", f"{table.name}.{p}")
    return props
