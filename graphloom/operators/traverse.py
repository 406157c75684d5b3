"""Neighbours of vertices: source properties, edges of several types and directions, statistics, limits and samples.

One plan serves all start vertices: the edge types are united, filtered, and cut or aggregated by vertex. A limit is a
window over `_vid`. Start vertices few enough to be broadcast are joined first; of many, the edges are aggregated or cut
first, which Spark begins before it shuffles them, so that a vertex with very many edges is no task of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.errors import GraphError
from graphloom.functions import expr
from graphloom.graph import KEYS, Graph, checked
from graphloom.sources.files import materialize

OUT, IN, BOTH = "out", "in", "both"
_NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)
_INT_MAX, _INT_MIN = 9_223_372_036_854_775_807, -9_223_372_036_854_775_808


@dataclass(frozen=True)
class Hop:
    """An edge type and whether it is followed backwards."""

    edge: str
    reverse: bool = False


@dataclass(frozen=True)
class Stat:
    """function: SUM, COUNT, AVG, MIN or MAX of an edge property or `_rank`, over edges followed forwards."""

    alias: str
    edge: str
    prop: str
    function: str


@dataclass(frozen=True)
class Traversal:
    """What to bring back.

    tags, edges: None for none, or for each name its properties; a name with None has all of them. hops: the edges to
    follow, in order; without them every edge type in `direction`. limit counts a vertex's edges over all types, in the
    order of hops, then rank and destination; `sample` picks them at random instead, seeded, and only with a limit.
    Statistics cover the edges that the plain limit leaves, but all edges if sampled. With strict, statistics treat
    nulls and no edges as the storage layer did: one null makes SUM, AVG, MIN and MAX null, and without edges SUM is 0, MIN and MAX
    are the largest and smallest integers. chunk: how many edges a row of the nested form has at most.
    """

    direction: str = OUT
    hops: tuple[Hop, ...] = ()
    tags: dict[str, list[str] | None] | None = None
    edges: dict[str, list[str] | None] | None = None
    stats: tuple[Stat, ...] = ()
    filter: str | Column | None = None
    limit: int | None = None
    sample: int | None = None
    strict: bool = False
    chunk: int | None = None
    filter_tags: tuple[str, ...] = field(default=())


def hops_of(graph: Graph, t: Traversal) -> list[Hop]:
    if t.hops:
        for h in t.hops:
            graph.edge(h.edge)
        return list(t.hops)
    names = list(t.edges) if t.edges else sorted(graph.edges, key=lambda n: graph.edges[n].id)
    for n in names:
        graph.edge(n)
    if t.direction not in (OUT, IN, BOTH):
        raise GraphError("INVALID_PARM", f"direction {t.direction}")
    back = [Hop(n, True) for n in reversed(names)] if t.direction in (IN, BOTH) else []
    return back + [Hop(n) for n in names] if t.direction in (OUT, BOTH) else back


def start(spark: SparkSession, vids: DataFrame | Iterable) -> DataFrame:
    """A frame of distinct start vertices."""
    if isinstance(vids, DataFrame):
        return vids.select("_vid").distinct()
    values = list(vids)
    kind = "long" if values and isinstance(values[0], int) else "string"
    return spark.createDataFrame([(v,) for v in dict.fromkeys(values)], f"_vid {kind}")


def _props(graph: Graph, t: Traversal, edge: str) -> list[str]:
    if t.edges is None or edge not in t.edges and t.edges:
        return []
    wanted = t.edges.get(edge)
    table = graph.edge(edge)
    return [p for p in table.props] if wanted is None else checked(table, [p for p in wanted if p not in ("_src", "_dst", "_rank", "_type")])


def _condition(graph: Graph, t: Traversal) -> tuple[str | Column | None, list[str]]:
    """The filter, bound, and the tags of source vertices that it reads."""
    text = t.filter if isinstance(t.filter, str) else None
    names = list(dict.fromkeys(h.edge for h in hops_of(graph, t)))
    bound = expr.bound(text, graph, names) if text else t.filter
    return bound, list(dict.fromkeys([*(expr.sources(text) if text else ()), *t.filter_tags]))


def _every(graph: Graph, t: Traversal) -> DataFrame:
    """All edges of the hops, each at the vertex it is followed from; united, but not filtered."""
    parts = []
    for n, h in enumerate(hops_of(graph, t)):
        table = graph.edge(h.edge)
        near, far = ("_dst", "_src") if h.reverse else ("_src", "_dst")
        sign = "-" if h.reverse else "+"
        kind = table.id * (-1 if h.reverse else 1)
        row = F.struct(F.col(near).alias("_src"), F.lit(kind).alias("_type"), F.col("_rank"), F.col(far).alias("_dst"), *table.props)
        cols = [F.col(near).alias("_vid"), F.lit(n).alias("_ord"), F.lit(sign + h.edge).alias("_type"), F.col("_rank"), F.col(far).alias("_dst")]
        parts.append(table.rows().select(*cols, row.alias(expr.EDGE.format(h.edge))))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _passing(rows: DataFrame, condition: str | Column | None) -> DataFrame:
    """The rows for which the condition is true; a null is not. Bare, so that it reaches the scan."""
    return rows if condition is None else rows.where(condition)


def expand(graph: Graph, vids: DataFrame, t: Traversal) -> DataFrame:
    """One row for each edge that passes: _vid, _ord (place of its hop), _type, _rank, _dst and a struct for each edge type."""
    condition, tags = _condition(graph, t)
    rows = vids.join(_every(graph, t), "_vid")
    for tag in tags:
        table = graph.tag(tag)
        rows = rows.join(table.rows().select("_vid", F.struct(*table.props).alias(expr.SOURCE.format(tag))), "_vid", "left")
    return _passing(rows, condition).drop(*[expr.SOURCE.format(tag) for tag in tags])


def _small(vids: DataFrame) -> bool:
    """Whether Spark would broadcast the start vertices, by its own estimate and bound."""
    bound = int(vids.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760").rstrip("b"))
    return vids._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() <= bound


def _reduced(graph: Graph, vids: DataFrame, t: Traversal, reduce_rows: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """reduce_rows of the start vertices' edges, where it treats each vertex by itself.

    A few start vertices are joined first, by broadcast. Many would be joined by shuffle, which brings all edges of a
    vertex into one task: then edges are reduced first, which begins before the shuffle, and what is left is joined.
    """
    condition, tags = _condition(graph, t)
    if tags or _small(vids):
        return reduce_rows(expand(graph, vids, t))
    return reduce_rows(_passing(_every(graph, t), condition)).join(vids, "_vid", "left_semi")


def limited(rows: DataFrame, t: Traversal) -> DataFrame:
    """The rows within the limit. A negative limit is none."""
    if t.limit is None or t.limit < 0:
        return rows
    order = [F.col("_ord"), F.col("_rank"), F.col("_dst")]
    if t.sample is not None:
        order = [F.xxhash64(F.lit(t.sample), "_vid", "_ord", "_rank", "_dst"), *order]
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("_vid").orderBy(*order))).where(F.col("_n") <= t.limit).drop("_n")


def _stat(graph: Graph, s: Stat, strict: bool) -> Column:
    table = graph.edge(s.edge)
    if s.prop not in ("_rank", *table.props):
        raise GraphError("INVALID_STAT_TYPE", f"{s.edge}.{s.prop}: an edge property or _rank")
    kind = T.LongType() if s.prop == "_rank" else table.frame.schema[s.prop].dataType
    function = s.function.upper()
    if function not in ("SUM", "COUNT", "AVG", "MIN", "MAX"):
        raise GraphError("INVALID_STAT_TYPE", s.function)
    if function != "COUNT" and not isinstance(kind, _NUMBERS):
        raise GraphError("INVALID_STAT_TYPE", f"{function} of {kind.simpleString()}")
    of_type = F.col("_type") == F.lit(f"+{s.edge}")
    value = F.when(of_type, F.col(f"{expr.EDGE.format(s.edge)}.{s.prop}"))
    n = F.count(F.when(of_type, 1))
    if function == "COUNT":
        return n
    out = {"SUM": F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max}[function](value)
    if strict:
        empty = {"SUM": 0, "AVG": None, "MIN": _INT_MAX, "MAX": _INT_MIN}[function]
        out = F.when(n == 0, F.lit(empty)).when(F.count(value) == n, out)
    return out


def stats(graph: Graph, vids: DataFrame | Iterable, t: Traversal, spark: SparkSession | None = None) -> DataFrame:
    """One row for each start vertex, even without edges: _vid and the statistics."""
    vids = start(spark or next(iter(graph.edges.values())).frame.sparkSession, vids)
    aggregates = [_stat(graph, s, t.strict).alias(s.alias) for s in t.stats]
    found = _reduced(graph, vids, t, lambda rows: (limited(rows, t) if t.sample is None else rows).groupBy("_vid").agg(*aggregates))
    out = vids.join(found, "_vid", "left")
    for s in t.stats:
        f = s.function.upper()
        if f == "COUNT":
            out = out.withColumn(s.alias, F.coalesce(s.alias, F.lit(0)))
        elif t.strict and f != "AVG":
            out = out.withColumn(s.alias, F.coalesce(s.alias, F.lit({"SUM": 0, "MIN": _INT_MAX, "MAX": _INT_MIN}[f])))
    return out


def edges(graph: Graph, vids: DataFrame | Iterable, t: Traversal, spark: SparkSession | None = None) -> DataFrame:
    """One row for each neighbour: _vid, _type (signed name), _rank, _dst and the properties asked for as edge.prop.

    Unlike the nested form it stays flat for a vertex with very many edges.
    """
    vids = start(spark or next(iter(graph.edges.values())).frame.sparkSession, vids)
    rows = expand(graph, vids, t) if t.limit is None or t.limit < 0 else _reduced(graph, vids, t, lambda rows: limited(rows, t))
    names = list(dict.fromkeys(h.edge for h in hops_of(graph, t)))
    cols = [F.col(f"{expr.EDGE.format(n)}.{p}").alias(f"{n}.{p}") for n in names for p in _props(graph, t, n)]
    return rows.select("_vid", "_type", "_rank", "_dst", *cols)


def neighbors(graph: Graph, vids: DataFrame | Iterable, t: Traversal, spark: SparkSession | None = None) -> DataFrame:
    """One row for each start vertex, even if nothing is found.

    Columns: _vid; _stats, a struct; `_tag:name:props`, a struct that is null if the vertex lacks the tag;
    `_edge:+name:props` for each hop, an array of structs by rank and destination; _expr, always null.

    A row holds all edges of its vertex, which only a limit bounds. With t.chunk a vertex has a row for each so many of
    its edges, numbered from 0 in a column _chunk, and the same statistics and tags in each.
    """
    if t.chunk is not None and t.chunk < 1:
        raise GraphError("INVALID_PARM", "a chunk holds at least one edge")
    vids = start(spark or next(iter(graph.edges.values())).frame.sparkSession, vids)
    out = vids
    tags = {} if t.tags is None else t.tags or dict.fromkeys(sorted(graph.tags, key=lambda n: graph.tags[n].id))
    hops = hops_of(graph, t) if t.edges is not None or t.stats else []
    columns = ["_vid", "_stats"]
    if t.stats:
        found = stats(graph, vids, t)
        out = out.join(found.select("_vid", F.struct(*[s.alias for s in t.stats]).alias("_stats")), "_vid", "left")
    else:
        out = out.withColumn("_stats", F.lit(None).cast("struct<>"))
    for name, props in tags.items():
        table = graph.tag(name)
        props = table.props if props is None else checked(table, props)
        cell = f"_tag:{name}:{':'.join(props)}"
        out = out.join(table.rows().select("_vid", F.struct(*props).alias(cell) if props else F.lit(None).alias(cell)), "_vid", "left")
        columns.append(cell)
    if t.edges is not None:
        rows = expand(graph, vids, t) if t.limit is None or t.limit < 0 else _reduced(graph, vids, t, lambda rows: limited(rows, t))
        if t.chunk is not None:
            place = F.row_number().over(Window.partitionBy("_vid").orderBy("_ord", "_rank", "_dst"))
            rows = rows.withColumn("_chunk", F.floor((place - 1) / t.chunk).cast("long"))
            columns.insert(1, "_chunk")
        cells = []
        for n, h in enumerate(hops):
            props = (t.edges.get(h.edge) if t.edges else None) or graph.edge(h.edge).props
            wanted = [F.col(f"{expr.EDGE.format(h.edge)}.{p}").alias(p) for p in props if p in ("_src", "_type") or p not in KEYS]
            cell = F.struct("_rank", "_dst", *wanted)
            name = f"_edge:{'-' if h.reverse else '+'}{h.edge}:{':'.join(props)}"
            cells.append(F.sort_array(F.collect_list(F.when(F.col("_ord") == n, cell))).alias(name))
            columns.append(name)
        found = rows.groupBy("_vid", *(["_chunk"] if t.chunk is not None else [])).agg(*cells)
        out = out.join(found, "_vid", "left")
        if t.chunk is not None:
            out = out.withColumn("_chunk", F.coalesce("_chunk", F.lit(0).cast("long")))
    return out.withColumn("_expr", F.lit(None).cast("string")).select(*[f"`{c}`" for c in columns], "_expr")


def walk(graph: Graph, vids: DataFrame | Iterable, hops: int, t: Traversal, spark: SparkSession | None = None) -> DataFrame:
    """(_vid, _dst, _hop): each vertex first reached from a start vertex after 1 to `hops` hops. An extension.

    Each hop's new vertices are written to the checkpoint folder, so the plan stays short.
    """
    if hops < 1:
        raise GraphError("INVALID_PARM", "hops must be positive")
    begin = start(spark or next(iter(graph.edges.values())).frame.sparkSession, vids)
    seen = begin.select("_vid", F.col("_vid").alias("_dst"), F.lit(0).alias("_hop"))
    front = seen
    for n in range(1, hops + 1):
        step = expand(graph, front.select(F.col("_dst").alias("_vid")).distinct(), t).select(F.col("_vid").alias("_at"), F.col("_dst").alias("_to")).distinct()
        reached = front.select("_vid", F.col("_dst").alias("_at")).join(step, "_at").select("_vid", F.col("_to").alias("_dst")).distinct()
        front = materialize(reached.join(seen, ["_vid", "_dst"], "left_anti").withColumn("_hop", F.lit(n)), f"hop{n}")
        seen = seen.union(front)
    return seen.where("_hop > 0")
