"""Lookups by conditions on an index.

A context is a conjunction of column hints over the leading fields of one index and, if need be, a residual filter;
several contexts are alternatives, and a vertex or edge comes back once. An index is a covering view kept sorted by its
fields; where it has all columns that the lookup needs, the view is scanned instead of the table. Either way the hints
are plain comparisons that reach the Parquet scan.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.errors import GraphError
from graphloom.graph import KEYS, Graph, alive


@dataclass(frozen=True)
class Hint:
    """A field equal to a value (None finds nulls), or, with range, in the half-open interval [begin, end)."""

    field: str
    value: object = None
    begin: object = None
    end: object = None
    range: bool = False

    def column(self) -> Column:
        c = F.col(self.field)
        if not self.range:
            return c.isNull() if self.value is None else c == F.lit(self.value)
        tests = [t for t in (c >= F.lit(self.begin) if self.begin is not None else None, c < F.lit(self.end) if self.end is not None else None) if t is not None]
        return reduce(lambda a, b: a & b, tests, c.isNotNull())


@dataclass(frozen=True)
class Context:
    hints: tuple[Hint, ...] = ()
    filter: str | Column | None = None


@dataclass(frozen=True)
class View:
    """An index's fields, and its covering view if one is kept."""

    fields: tuple[str, ...]
    frame: DataFrame | None = None


def _checked(context: Context, fields: tuple[str, ...]) -> None:
    for n, h in enumerate(context.hints):
        if n >= len(fields) or h.field != fields[n]:
            raise GraphError("INVALID_OPERATION", f"hint {h.field}: hints follow the index's fields from the first")
        if h.range and n < len(context.hints) - 1:
            raise GraphError("INVALID_OPERATION", "a range must be the last hint")


def _mentioned(context: Context, props: list[str]) -> set[str]:
    """Properties that a filter may read; a Column's are not known, so all."""
    if context.filter is None:
        return set()
    if not isinstance(context.filter, str):
        return set(props)
    return {p for p in props if re.search(rf"(?<!\w){re.escape(p)}(?!\w)", context.filter)}


def lookup(graph: Graph, schema: str, contexts: list[Context], returns: list[str], view: View | None = None) -> DataFrame:
    """The rows of a tag or edge type that meet any of the contexts: columns `schema.column` for each name in returns.

    returns are properties and key columns (_vid, or _src, _rank, _dst). Rows are told apart by their keys, whether
    these are returned or not. A null filter result is false. Filters name properties bare or as schema.property.
    """
    if not contexts or not returns:
        raise GraphError("INVALID_OPERATION", "contexts and return columns are needed")
    table = graph.tags.get(schema) or graph.edge(schema)
    keys = ["_vid"] if schema in graph.tags else list(KEYS)
    for r in returns:
        if r not in (*keys, *table.props):
            raise GraphError("PROP_NOT_FOUND", f"{schema}.{r}")
    found = []
    for c in contexts:
        if view:
            _checked(c, view.fields)
        needed = {*returns, *(h.field for h in c.hints), *_mentioned(c, table.props), *([table.ttl[0]] if table.ttl and table.now is not None else [])}
        covered = view is not None and view.frame is not None and needed <= set(view.frame.columns)
        rows = view.frame if covered else table.frame
        live = alive(table.ttl, table.now)
        if live is not None:
            rows = rows.where(live)
        for h in c.hints:
            if h.field not in table.props:
                raise GraphError("PROP_NOT_FOUND", f"{schema}.{h.field}")
            rows = rows.where(h.column())
        if c.filter is not None:
            test = re.sub(rf"(?<!\w){re.escape(schema)}\.(?=\w)", "", c.filter) if isinstance(c.filter, str) else c.filter
            rows = rows.where(test)
        found.append(rows.select(*keys, *[r for r in returns if r not in keys]))
    rows = found[0] if len(found) == 1 else reduce(lambda a, b: a.unionByName(b), found).dropDuplicates(keys)
    return rows.select(*[F.col(r).alias(f"{schema}.{r}") for r in returns])


def covering(graph: Graph, schema: str, fields: list[str]) -> DataFrame:
    """What an index keeps: its fields and the keys, without expired rows, in the order of the fields, nulls last."""
    table = graph.tags.get(schema) or graph.edge(schema)
    keys = ["_vid"] if schema in graph.tags else list(KEYS)
    ttl = [table.ttl[0]] if table.ttl and table.ttl[0] not in fields else []
    rows = table.rows().select(*keys, *fields, *ttl)
    return rows.sortWithinPartitions(*[F.asc_nulls_last(f) for f in fields], *keys) if fields else rows


def contains_text(graph: Graph, schema: str, field: str, prefix: str | None = None, wildcard: str | None = None, regexp: str | None = None, fuzzy: str | None = None, distance: int = 2) -> DataFrame:
    """Rows whose string field starts with, matches or is close to a text: what a full-text index is asked for."""
    table = graph.tags.get(schema) or graph.edge(schema)
    value = F.lower(field)
    if prefix is not None:
        test = value.startswith(prefix.lower())
    elif wildcard is not None:
        test = value.rlike("^" + re.escape(wildcard.lower()).replace(r"\*", ".*").replace(r"\?", ".") + "$")
    elif regexp is not None:
        test = F.col(field).rlike(f"^(?:{regexp})$")
    elif fuzzy is not None:
        test = F.levenshtein(value, F.lit(fuzzy.lower()), distance) >= 0
    else:
        raise GraphError("INVALID_PARM", "one of prefix, wildcard, regexp, fuzzy")
    return table.rows().where(test)
