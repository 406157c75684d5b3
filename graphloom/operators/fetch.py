"""Properties of vertices and edges by key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.errors import GraphError
from graphloom.graph import KEYS, Graph, checked


def _refuse_both(vertex_props: object, edge_props: object) -> None:
    if (vertex_props is None) == (edge_props is None):
        raise GraphError("INVALID_OPERATION", "either vertex or edge properties")


def get_props(graph: Graph, keys: DataFrame, vertex_props: dict[str, list[str] | None] | None = None, edge_props: dict[str, list[str] | None] | None = None) -> DataFrame:
    """vertex_props: see vertices(); edge_props: see edges(). Exactly one of them."""
    _refuse_both(vertex_props, edge_props)
    return vertices(graph, keys, vertex_props) if edge_props is None else edges(graph, keys, edge_props)


def vertices(graph: Graph, vids: DataFrame, props: dict[str, list[str] | None]) -> DataFrame:
    """_vid and tag.prop columns of the vertices in vids (_vid) that have any of the tags; other tags' cells are null.

    props: for each tag its properties, None for all; empty for all tags. Repeated keys give repeated rows.
    """
    wanted = props or dict.fromkeys(graph.tags)
    out, cells, present = vids.select("_vid"), [], []
    for name, cols in wanted.items():
        table = graph.tag(name)
        cols = table.props if cols is None else checked(table, [c for c in cols if c not in ("_vid", "_tag")])
        out = out.join(table.rows().select("_vid", F.struct(F.lit(1).alias("_here"), *cols).alias(f"_t_{name}")), "_vid", "left")
        present.append(F.col(f"_t_{name}").isNotNull())
        cells += [F.col(f"_t_{name}.{c}").alias(f"{name}.{c}") for c in cols]
    return out.where(reduce(lambda a, b: a | b, present)).select("_vid", *cells)


def edges(graph: Graph, keys: DataFrame, props: dict[str, list[str] | None]) -> DataFrame:
    """_src, _rank, _dst and edge.prop columns of every key in keys; all null where there is no such edge.

    keys may have _type, the name of one edge type; a key then matches that type only.
    """
    wanted = props or dict.fromkeys(graph.edges)
    typed = "_type" in keys.columns
    out, cells = keys.select(*KEYS, *(["_type"] if typed else [])), []
    for name, cols in wanted.items():
        table = graph.edge(name)
        cols = table.props if cols is None else checked(table, [c for c in cols if c not in (*KEYS, "_type")])
        found = table.rows().select(*KEYS, F.struct(F.lit(1).alias("_here"), *cols).alias(f"_e_{name}"))
        if typed:
            found = found.withColumn("_type", F.lit(name))
        out = out.join(found, [*KEYS, *(["_type"] if typed else [])], "left")
        cells += [F.col(f"_e_{name}.{c}").alias(f"{name}.{c}") for c in cols]
    return out.select(*KEYS, *cells)
