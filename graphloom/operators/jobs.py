"""Statistics and clean-up jobs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.graph import KEYS, Graph
from graphloom.operators.scan import part_of


def statistics(graph: Graph) -> DataFrame:
    """(kind, name, count): rows of each tag and edge type, and distinct vertices and edges of the space.

    Vertices are told apart by grouping the union of the tags' ids, which merges on the map side first.
    """
    counts = [t.frame.agg(F.count(F.lit(1)).alias("count")).select(F.lit(kind).alias("kind"), F.lit(t.name).alias("name"), "count") for kind, tables in (("tag", graph.tags), ("edge", graph.edges)) for t in tables.values()]
    if graph.tags:
        ids = reduce(lambda a, b: a.union(b), [t.frame.select("_vid") for t in graph.tags.values()]).distinct()
        counts.append(ids.agg(F.count(F.lit(1)).alias("count")).select(F.lit("space").alias("kind"), F.lit("vertices").alias("name"), "count"))
    if graph.edges:
        total = reduce(lambda a, b: a.union(b), [t.frame.agg(F.count(F.lit(1)).alias("count")) for t in graph.edges.values()])
        counts.append(total.agg(F.sum("count").alias("count")).select(F.lit("space").alias("kind"), F.lit("edges").alias("name"), "count"))
    return reduce(lambda a, b: a.union(b), counts)


def correlativity(graph: Graph, partitions: int, part=part_of) -> DataFrame:
    """(part, other, out_share, in_share): how a partition's edges lead to and come from the others.

    Of the edges whose source is in a part, the share that ends in each other part; and of those same edges' number, the share of edges
    that come in from each other part. part gives a vertex's partition.
    """
    ends = reduce(lambda a, b: a.union(b), [t.frame.select(part(F.col("_src"), partitions).alias("s"), part(F.col("_dst"), partitions).alias("d")) for t in graph.edges.values()])
    pairs = ends.groupBy("s", "d").agg(F.count(F.lit(1)).alias("n"))  # at most partitions^2 rows
    total = pairs.groupBy("s").agg(F.sum("n").alias("total"))
    out = pairs.select(F.col("s").alias("part"), F.col("d").alias("other"), F.col("n").alias("out_n"), F.lit(0).alias("in_n"))
    into = pairs.select(F.col("d").alias("part"), F.col("s").alias("other"), F.lit(0).alias("out_n"), F.col("n").alias("in_n"))
    both = out.union(into).groupBy("part", "other").agg(F.sum("out_n").alias("out_n"), F.sum("in_n").alias("in_n"))
    shares = both.join(total.withColumnRenamed("s", "part"), "part")
    return shares.select("part", "other", (F.col("out_n") / F.col("total")).alias("out_share"), (F.col("in_n") / F.col("total")).alias("in_share"))


def vacuumed(graph: Graph) -> Graph:
    """The graph without expired rows and without rows whose key is null."""

    def clean(table, keys):
        return type(table)(table.name, table.rows().dropna(subset=list(keys)), table.id, table.ttl, table.now)

    return Graph({n: clean(t, ("_vid",)) for n, t in graph.tags.items()}, {n: clean(t, KEYS) for n, t in graph.edges.items()})


def dangling(graph: Graph) -> DataFrame:
    """(edge, _src, _rank, _dst, missing): edges one of whose ends has no tag. Deleting vertices leaves such edges."""
    ids = reduce(lambda a, b: a.union(b), [t.frame.select("_vid") for t in graph.tags.values()]).distinct()
    rows = []
    for t in graph.edges.values():
        for end in ("_src", "_dst"):
            rows.append(t.frame.join(ids.withColumnRenamed("_vid", end), end, "left_anti").select(F.lit(t.name).alias("edge"), *KEYS, F.lit(end).alias("missing")))
    return reduce(lambda a, b: a.union(b), rows)
