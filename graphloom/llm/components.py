"""Connected components by contraction to the neighbour of the smallest hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import discard, materialize


def _ranked(node: str) -> Column:
    """A node behind its hash: an order in which no path of some length keeps rising."""
    return F.struct(F.xxhash64(node).alias("h"), F.col(node).alias("n"))


def labels(edges: DataFrame) -> DataFrame:
    """(node long, root long) for every node of edges (a long, b long); root is one node of the component, for all the same.

    Each round maps every node to the first of itself and its neighbours, in the order of hashes, and contracts the
    edges to the nodes mapped to, so that a path shrinks to its local minima and a star vanishes in two rounds. All
    steps are aggregations with partial sums and equi-joins; nothing but whether edges remain reaches the driver.
    Null ends and loops are dropped; an empty input gives an empty result.
    """
    left = materialize(edges.select("a", "b").where("a <> b").distinct(), "edges")
    roots = None
    while True:
        both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy("a").agg(F.min(_ranked("b")).alias("b"))
        step = materialize(first.select(F.col("a").alias("node"), F.least(_ranked("a"), "b")["n"].alias("root")), "step")
        if roots is None:
            mapped_to = step
        else:
            to = step.select(F.col("node").alias("root"), F.col("root").alias("next"))
            mapped_to = roots.join(to, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
        of_a, of_b = (step.select(F.col("node").alias(x), F.col("root").alias(f"to_{x}")) for x in "ab")
        mapped = left.join(of_a, "a").join(of_b, "b").where("to_a <> to_b")
        rest = materialize(mapped.select(F.col("to_a").alias("a"), F.col("to_b").alias("b")).distinct(), "edges")
        older = [left, *([] if roots is None else [roots, step])]
        roots = step if roots is None else materialize(mapped_to, "roots")
        discard(*older)
        if rest.isEmpty():
            return roots
        left = rest


def components(edges: DataFrame) -> DataFrame:
    """As labels(), but root is the smallest node reachable."""
    found = labels(edges)
    least = found.groupBy("root").agg(F.min("node").alias("least"))
    return found.join(least, "root").select("node", F.col("least").alias("root"))
