"""The driver's tables as a property graph.

Vertex ids are a letter and the table's key. A lineitem becomes a `contains` edge from order to part; its rank numbers
the lines of one order and part over all columns, since the line number alone is not unique. The tables are loaded into
a store once, and queries read what it has written.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.catalog import Prop
from graphloom.graph import KEYS, Graph
from graphloom.sources.files import shared_dir
from graphloom.sources.store import Store, keys_of

#: A point in time, in epoch seconds (2024-01-20), and a TTL for events (10 days).
NOW = 1_705_708_800
TTL = 864_000
LINE = ["l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
#: The tables read by name below.
TAGS = {"customer": ("c", "c_custkey"), "supplier": ("s", "s_suppkey"), "part": ("p", "p_partkey"), "orders": ("o", "o_orderkey"), "nation": ("n", "n_nationkey"), "region": ("r", "r_regionkey")}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vid(prefix: str, key: str) -> Column:
    return F.concat(F.lit(prefix), F.col(key).cast("string"))


def _tag_rows(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prefix, key = TAGS[name]
    rows = read(spark, sf_dir, name)
    return rows.select(vid(prefix, key).alias("_vid"), *rows.columns)


def _edge_rows(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    zero = F.lit(0).cast("long").alias("_rank")
    if name == "contains":
        rank = F.expr(f"row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY {', '.join(LINE)})").cast("long")
        rows = read(spark, sf_dir, "lineitem").withColumn("_rank", rank)
        return rows.select(vid("o", "l_orderkey").alias("_src"), "_rank", vid("p", "l_partkey").alias("_dst"), "l_quantity", "l_extendedprice", "l_discount", "l_shipdate", "l_suppkey", "l_linenumber")
    if name == "placed":
        return read(spark, sf_dir, "orders").select(vid("c", "o_custkey").alias("_src"), zero, vid("o", "o_orderkey").alias("_dst"), "o_totalprice", "o_orderstatus", "o_orderdate", "o_orderpriority")
    if name == "supplied":
        rows = read(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("sum_qty"), F.count(F.lit(1)).alias("n"))
        return rows.select(vid("s", "l_suppkey").alias("_src"), zero, vid("p", "l_partkey").alias("_dst"), "sum_qty", "n")
    if name == "lives_in":
        return read(spark, sf_dir, "customer").select(vid("c", "c_custkey").alias("_src"), zero, vid("n", "c_nationkey").alias("_dst"), F.col("c_mktsegment").alias("segment"))
    if name == "based_in":
        return read(spark, sf_dir, "supplier").select(vid("s", "s_suppkey").alias("_src"), zero, vid("n", "s_nationkey").alias("_dst"), F.col("s_acctbal").alias("balance"))
    if name == "part_of":
        return read(spark, sf_dir, "nation").select(vid("n", "n_nationkey").alias("_src"), zero, vid("r", "n_regionkey").alias("_dst"), F.col("n_name").alias("name"))
    if name == "did":
        return read(spark, sf_dir, "events").select(vid("u", "user_id").alias("_src"), F.col("event_id").alias("_rank"), F.col("event_type").alias("_dst"), F.unix_timestamp("ts").alias("at"), "value")
    raise KeyError(name)


# The property type of each type that the tables have.
_TYPES = {"int": "INT32", "bigint": "INT64", "double": "DOUBLE", "string": "STRING", "date": "DATE", "timestamp_ntz": "DATETIME"}
SPACE = "shop"
#: Edge types whose keys _edge_rows makes unique, whatever the tables hold: by number, or by grouping.
UNIQUE = ("contains", "supplied")
#: One store for each application and folder of tables.
_stores: dict[tuple[str, str], Store] = {}


def new_store(spark: SparkSession) -> Store:
    """An empty store in the shared folder, with the space."""
    store = Store(spark, f"{shared_dir(spark)}/graphloom-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}-store")
    store.catalog.create_space(SPACE, 6, 1, "FIXED_STRING(32)")
    store.commit()
    return store


def load(store: Store, spark: SparkSession, sf_dir: str, name: str) -> None:
    """Creates a tag or edge type and inserts its rows, which lie sorted by key from then on."""
    kind = "tag" if name in TAGS else "edge"
    rows = (_tag_rows if kind == "tag" else _edge_rows)(spark, sf_dir, name)
    props = [f for f in rows.schema.fields if f.name not in ("_vid", *KEYS)]
    ttl = ("at", TTL) if name == "did" else (None, 0)
    store.catalog.create(SPACE, kind, name, [Prop(f.name, _TYPES[f.dataType.simpleString()], True) for f in props], *ttl)
    store.insert(SPACE, name, rows, unique=name in UNIQUE)


def stored(spark: SparkSession, sf_dir: str, names: tuple[str, ...]) -> Store:
    """The store of the driver's tables, with these of them loaded; each is loaded once an application."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _stores:
        _stores[key] = new_store(spark)
    store = _stores[key]
    for name in names:
        if name not in store.catalog.space(SPACE).schemas:
            load(store, spark, sf_dir, name)
    return store


def _frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as the store has it, with the types of its source: integers surface as 64-bit in the store."""
    store = stored(spark, sf_dir, (name,))
    schema, rows = store.catalog.schema(SPACE, name), store.frame(SPACE, name)
    return rows.select(*keys_of(schema), *[F.col(p.name).cast(p.parsed.stored).alias(p.name) for p in schema.latest.props])


def tag(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return _frame(spark, sf_dir, name)


def edge(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return _frame(spark, sf_dir, name)


EDGES = ("placed", "contains", "supplied", "lives_in", "based_in", "part_of", "did")


def graph(spark: SparkSession, sf_dir: str, tags: tuple[str, ...] = (), edges: tuple[str, ...] = (), now: int | None = None) -> Graph:
    """The graph of some tags and edge types; events expire if now is given."""
    return Graph.of({t: tag(spark, sf_dir, t) for t in tags}, {e: edge(spark, sf_dir, e) for e in edges}, {"did": ("at", TTL)}, now)
