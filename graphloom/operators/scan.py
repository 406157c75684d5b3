"""Whole tables, and pages of them by key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.errors import GraphError
from graphloom.graph import KEYS, Graph, checked


def part_of(vid: Column, partitions: int) -> Column:
    """The partition, from 1, of a vertex: integers by remainder, strings by hash."""
    return F.pmod(F.xxhash64(vid), F.lit(partitions)) + 1


def int_part_of(vid: Column, partitions: int) -> Column:
    return F.pmod(vid, F.lit(partitions)) + 1


def _after(keys: list[str], cursor: tuple) -> Column:
    """Keys later than the cursor, in lexicographic order."""
    if len(cursor) != len(keys):
        raise GraphError("INVALID_PARM", "a cursor has one value for each key column")
    tests = []
    for n, key in enumerate(keys):
        same = [F.col(k) == F.lit(v) for k, v in zip(keys[:n], cursor, strict=False)]
        tests.append(reduce(lambda a, b: a & b, [*same, F.col(key) > F.lit(cursor[n])]))
    return reduce(lambda a, b: a | b, tests)


def _scan(rows: DataFrame, keys: list[str], props: list[str], part: tuple[int, int] | None, cursor: tuple | None, limit: int | None) -> DataFrame:
    if part:
        rows = rows.where(part_of(F.col(keys[0]), part[1]) == part[0])
    if cursor is not None:
        rows = rows.where(_after(keys, cursor))
    rows = rows.select(*keys, *props)
    return rows if limit is None else rows.orderBy(*keys).limit(limit)


def scan_vertices(graph: Graph, tag: str, props: list[str] | None = None, part: tuple[int, int] | None = None, cursor: tuple | None = None, limit: int | None = None, include_expired: bool = True) -> DataFrame:
    """A tag's rows by _vid. part: (partition, partitions). cursor: the last key of the page before; limit: the page's size."""
    table = graph.tag(tag)
    return _scan(table.rows(include_expired), ["_vid"], table.props if props is None else checked(table, props), part, cursor, limit)


def scan_edges(graph: Graph, edge: str, props: list[str] | None = None, part: tuple[int, int] | None = None, cursor: tuple | None = None, limit: int | None = None, include_expired: bool = True) -> DataFrame:
    """An edge type's rows by source, rank and destination."""
    table = graph.edge(edge)
    return _scan(table.rows(include_expired), list(KEYS), table.props if props is None else checked(table, props), part, cursor, limit)


def pages(scan, keys: list[str], limit: int, **options):
    """All pages of a scan, each a list of rows; scan is one of the functions above with its graph and table bound."""
    cursor = None
    while rows := scan(cursor=cursor, limit=limit, **options).collect():  # one page at a time
        yield rows
        if len(rows) < limit:
            return
        cursor = tuple(rows[-1][k] for k in keys)
