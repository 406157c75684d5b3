"""What a write costs, whatever the size: how its rows are spread over tasks, and how often they are shuffled."""

import pytest
from pyspark.sql import functions as F

from graphloom.operators import mutate
from graphloom.operators.scan import part_of
from graphloom.plans import datasets
from graphloom.sources.store import Store


@pytest.fixture
def no_broadcast(spark):
    """As with tables that Spark would not broadcast by its own estimate."""
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


@pytest.mark.parametrize("bad", [-1, 5])
def test_refusing_partitions_leaves_rows_where_they_lie(spark, no_broadcast, bad):
    """A space of two partitions is not two tasks."""
    rows = spark.range(0, 4000, 1, 7).select(F.concat(F.lit("v"), "id").alias("_vid"), F.when(F.col("id") == bad, "NOT_NULLABLE").alias("_error"))
    good, failed = mutate.accepted(rows, ["_vid"], 2)
    refused = [r.part for r in failed.collect()]
    assert len(refused) == (bad == 5)
    spread = good.groupBy(F.spark_partition_id().alias("task")).agg(F.count(F.lit(1)).alias("n")).collect()
    assert sum(r.n for r in spread) == rows.where(~part_of(F.col("_vid"), 2).isin(refused)).count()
    assert len(spread) == 7


@pytest.fixture
def plans(monkeypatch):
    """The plans of what is written, by the name of its tag or edge type."""
    kept, write = {}, Store._write

    def seen(store, space, schema, rows, *rest, **options):
        kept[schema.name] = rows._jdf.queryExecution().executedPlan().toString()
        return write(store, space, schema, rows, *rest, **options)

    monkeypatch.setattr(Store, "_write", seen)
    return kept


def shuffles(plan):
    """Exchanges of rows, without that of the refused partitions."""
    return [x for x in plan.splitlines() if "Exchange hashpartitioning(" in x and "hashpartitioning(_part#" not in x]


def test_edges_that_are_numbered_are_shuffled_once(spark, no_broadcast, plans, tmp_path):
    """Equal lines of an order are told apart by their number, so nothing is grouped by key again, and none is lost."""
    lines = datasets.read(spark, "/root/testdata/sf0.001", "lineitem")
    lines.union(lines.where("l_orderkey % 3 = 0")).union(lines.where("l_orderkey % 3 = 0")).write.parquet(f"{tmp_path}/lineitem.parquet")
    edges = datasets.edge(spark, str(tmp_path), "contains")
    assert len(shuffles(plans["contains"])) == 1 and "Aggregate(key=[_src" not in plans["contains"]
    read = datasets.read(spark, str(tmp_path), "lineitem")
    assert edges.count() == read.count() == edges.select("_src", "_rank", "_dst").distinct().count()
    most = read.groupBy("l_orderkey", "l_partkey").count().agg(F.max("count")).first()[0]
    assert most >= 3 and edges.agg(F.max("_rank")).first()[0] == most
    kept = edges.select(F.substring("_src", 2, 20).cast("long").alias("l_orderkey"), "l_linenumber", "l_quantity", "l_shipdate")
    assert kept.exceptAll(read.select(*kept.columns)).count() == 0


def test_no_table_is_shuffled_by_partition(spark, no_broadcast, plans, tmp_path):
    """What neighbors_filter_edge and all other queries read: every table, as it is loaded."""
    store = datasets.new_store(spark)
    for name in (*datasets.TAGS, *datasets.EDGES):
        datasets.load(store, spark, "/root/testdata/sf0.001", name)
    assert set(plans) == {*datasets.TAGS, *datasets.EDGES}
    for plan in plans.values():
        assert "BroadcastHashJoin [_part#" in plan and "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
