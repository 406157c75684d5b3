"""Expressions over a traversal: names, checks and the functions that plain SQL lacks.

Filters and SET items are SQL text or Columns. In text, `$^.tag.prop` is a property of the source vertex, `edge.prop` a
property of an edge, and `edge._src`, `edge._dst`, `edge._rank`, `edge._type` its key. Anything else that the engine
cannot answer where a traversal runs (input and variable properties, properties of the destination, tag properties,
aggregates) is refused.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.errors import GraphError
from graphloom.graph import Graph

SOURCE = "_source_{}"
EDGE = "_edge_{}"
_PSEUDO = ("_src", "_dst", "_rank", "_type")
_REFUSED = re.compile(r"\$-|\$\$|\$[A-Za-z_]\w*\.")
_STRING = re.compile(r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"")
_AGGREGATE = re.compile(r"(?i)\b(?:count|sum|avg|min|max|collect_list|collect_set|std|bit_and|bit_or|bit_xor)\s*\(")
_SOURCE = re.compile(r"\$\^\.(\w+)\.(\w+)")
_EDGE = re.compile(r"(?<![\w.`$^])([A-Za-z]\w*)\.(\w+)")


def bound(text: str, graph: Graph, edges: list[str]) -> str:
    """The text with references replaced by columns of a traversal's frame; raises for what is unknown or refused."""
    if _REFUSED.search(_STRING.sub("''", text)):
        raise GraphError("INVALID_FILTER", "only source vertex and edge properties can be used")
    if _AGGREGATE.search(_STRING.sub("''", text)):
        raise GraphError("INVALID_FILTER", "aggregates cannot be used")

    def source(m: re.Match[str]) -> str:
        if m[2] not in graph.tag(m[1]).props:
            raise GraphError("PROP_NOT_FOUND", m[0])
        return f"`{SOURCE.format(m[1])}`.`{m[2]}`"

    def edge(m: re.Match[str]) -> str:
        if m[1] not in graph.edges:
            if m[1] in graph.tags:
                raise GraphError("INVALID_FILTER", f"{m[0]}: tag properties need $^")
            return m[0]  # a lambda variable's field
        if m[1] not in edges:
            raise GraphError("INVALID_FILTER", f"{m[1]} is not traversed")
        if m[2] not in _PSEUDO and m[2] not in graph.edge(m[1]).props:
            raise GraphError("PROP_NOT_FOUND", m[0])
        return f"`{EDGE.format(m[1])}`.`{m[2]}`"

    out, at = [], 0
    for s in [*_STRING.finditer(text), None]:
        part = text[at : s.start() if s else len(text)]
        out.append(_SOURCE.sub(source, _EDGE.sub(edge, part)))
        if s:
            out.append(s.group())
            at = s.end()
    return "".join(out)


def sources(text: str) -> list[str]:
    """The tags whose properties the text refers to."""
    return list(dict.fromkeys(m[1] for m in _SOURCE.finditer(_STRING.sub("''", text))))


def true_only(condition: Column) -> Column:
    """Null counts as false."""
    return F.coalesce(condition, F.lit(False))


# What the expression language has and SQL spells differently.


def divide(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def modulo(a: Column, b: Column) -> Column:
    return F.try_mod(a, b)


def is_empty(value: Column) -> Column:
    """A value that its row lacks, by reading a property that the row's type does not have, is null here."""
    return value.isNull()


def increment(value: Column) -> Column:
    return value + 1


def decrement(value: Column) -> Column:
    return value - 1


def matches(value: Column, pattern: str) -> Column:
    """The whole value matches the regular expression."""
    return value.rlike(f"^(?:{pattern})$")


def xor(*parts: Column) -> Column:
    return reduce(lambda a, b: a != b, parts)


def distinct_list(*items: Column) -> Column:
    """A set literal."""
    return F.array_distinct(F.array(*items))


def comprehension(items: Column, where=None, to=None) -> Column:
    """[x IN items WHERE where(x) | to(x)]."""
    kept = F.filter(items, where) if where else items
    return F.transform(kept, to) if to else kept


def every(items: Column, test) -> Column:
    return F.forall(items, test)


def some(items: Column, test) -> Column:
    return F.exists(items, test)


def single(items: Column, test) -> Column:
    return F.size(F.filter(items, test)) == 1


def none(items: Column, test) -> Column:
    return ~F.exists(items, test)


def reduced(items: Column, start: Column, step) -> Column:
    return F.aggregate(items, start, step)
