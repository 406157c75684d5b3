"""The registered queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.catalog import Catalog, IndexField, Prop, Version
from graphloom.functions import expr
from graphloom.operators import fetch, jobs, kv, lookup, mutate, scan, traverse
from graphloom.operators.lookup import Context, Hint, View
from graphloom.operators.mutate import Update
from graphloom.operators.traverse import Hop, Stat, Traversal
from graphloom.plans.datasets import LINE, NOW, SPACE, TTL, edge, graph, load, new_store, read, stored, tag, vid
from graphloom.sources.files import shared_dir
from graphloom.sources.joblog import JobLog
from graphloom.sources.store import Store
from graphloom.streaming import feed
from graphloom.streaming.listener import Listener

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def renamed(df: DataFrame) -> DataFrame:
    """Columns named like tag.prop as tag_prop."""
    return df.toDF(*[c.replace(".", "_") for c in df.columns])


_CONTAINS = f"SELECT 'o' || l_orderkey AS _src, row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY {', '.join(LINE)}) AS _rank, 'p' || l_partkey AS _dst, * FROM lineitem"
_PLACED = "SELECT 'c' || o_custkey AS _src, CAST(0 AS BIGINT) AS _rank, 'o' || o_orderkey AS _dst, * FROM orders"

# Neighbours

_ORDER_STATS = (Stat("n", "placed", "_rank", "COUNT"), Stat("total", "placed", "o_totalprice", "SUM"), Stat("mean", "placed", "o_totalprice", "AVG"), Stat("least", "placed", "o_totalprice", "MIN"), Stat("most", "placed", "o_totalprice", "MAX"))


@query("SELECT 'c' || c_custkey AS _vid, count(o_orderkey) AS n, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 6) AS mean, min(o_totalprice) AS least, max(o_totalprice) AS most FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def neighbors_stats(spark, d):
    g = graph(spark, d, ("customer",), ("placed",))
    found = traverse.stats(g, g.tag("customer").frame, Traversal(hops=(Hop("placed"),), stats=_ORDER_STATS))
    return found.withColumns({"total": F.round("total", 2), "mean": F.round("mean", 6)})


@query("""SELECT 'c' || c_custkey AS _vid, count(o_orderkey) AS n, round(coalesce(sum(o_totalprice), 0), 2) AS total, CAST(coalesce(max(o_shippriority), -9223372036854775808) AS BIGINT) AS most
FROM customer LEFT JOIN (SELECT o_custkey, o_orderkey, o_totalprice, 0 AS o_shippriority FROM orders WHERE o_totalprice > 400000) ON o_custkey = c_custkey GROUP BY 1""")
def neighbors_stats_strict(spark, d):
    g = graph(spark, d, ("customer",), ("placed",))
    t = Traversal(hops=(Hop("placed"),), filter="placed.o_totalprice > 400000", strict=True, stats=(Stat("n", "placed", "_rank", "COUNT"), Stat("total", "placed", "o_totalprice", "SUM"), Stat("most", "placed", "_rank", "MAX")))
    return traverse.stats(g, g.tag("customer").frame, t).withColumn("total", F.round("total", 2)).withColumn("most", F.col("most").cast("long"))


@query(f"SELECT _src AS _vid, '+placed' AS _type, _rank, _dst, o_totalprice AS placed_o_totalprice, o_orderstatus AS placed_o_orderstatus FROM ({_PLACED})")
def neighbors_out(spark, d):
    g = graph(spark, d, ("customer",), ("placed",))
    return renamed(traverse.edges(g, g.tag("customer").frame, Traversal(edges={"placed": ["o_totalprice", "o_orderstatus"]})))


@query(f"SELECT _dst AS _vid, '-placed' AS _type, _rank, _src AS _dst, o_totalprice AS placed_o_totalprice FROM ({_PLACED})")
def neighbors_in(spark, d):
    g = graph(spark, d, ("orders",), ("placed",))
    return renamed(traverse.edges(g, g.tag("orders").frame, Traversal(direction="in", edges={"placed": ["o_totalprice"]})))


@query("""SELECT 'n' || n_nationkey AS _vid, '+part_of' AS _type, CAST(0 AS BIGINT) AS _rank, 'r' || n_regionkey AS _dst FROM nation
UNION ALL SELECT 'n' || c_nationkey, '-lives_in', 0, 'c' || c_custkey FROM customer UNION ALL SELECT 'n' || s_nationkey, '-based_in', 0, 's' || s_suppkey FROM supplier""")
def neighbors_both(spark, d):
    g = graph(spark, d, ("nation",), ("part_of", "lives_in", "based_in"))
    return traverse.edges(g, g.tag("nation").frame, Traversal(direction="both"))


_LIMITED = f"""SELECT _vid, _type, _rank, _dst, placed_o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY _vid ORDER BY ord, _rank, _dst) AS k FROM (
SELECT 'c' || c_custkey AS _vid, 0 AS ord, '+lives_in' AS _type, CAST(0 AS BIGINT) AS _rank, 'n' || c_nationkey AS _dst, CAST(NULL AS DOUBLE) AS placed_o_totalprice FROM customer
UNION ALL SELECT _src, 1, '+placed', _rank, _dst, o_totalprice FROM ({_PLACED}))) WHERE k <= 4"""


@query(_LIMITED)
def neighbors_limit(spark, d):
    g = graph(spark, d, ("customer",), ("placed", "lives_in"))
    t = Traversal(hops=(Hop("lives_in"), Hop("placed")), edges={"placed": ["o_totalprice"], "lives_in": []}, limit=4)
    return renamed(traverse.edges(g, g.tag("customer").frame, t))


@query(f"SELECT _vid, sum(CASE WHEN _type = '+placed' THEN 1 ELSE 0 END)::BIGINT AS n, round(sum(placed_o_totalprice), 2) AS total FROM ({_LIMITED}) GROUP BY 1")
def neighbors_limit_stats(spark, d):
    g = graph(spark, d, ("customer",), ("placed", "lives_in"))
    t = Traversal(hops=(Hop("lives_in"), Hop("placed")), limit=4, stats=(Stat("n", "placed", "_rank", "COUNT"), Stat("total", "placed", "o_totalprice", "SUM")))
    return traverse.stats(g, g.tag("customer").frame, t).withColumn("total", F.round("total", 2))


@query("SELECT 'c' || o_custkey AS _vid, least(count(*), 3) AS n FROM orders GROUP BY 1")
def neighbors_sample(spark, d):
    g = graph(spark, d, ("customer",), ("placed",))
    rows = traverse.edges(g, g.tag("customer").frame, Traversal(hops=(Hop("placed"),), limit=3, sample=7))
    return rows.groupBy("_vid").agg(F.countDistinct("_rank", "_dst").alias("n"))


@query("SELECT 'c' || c_custkey AS _vid, count(o_orderkey) AS n, round(sum(o_totalprice), 2) AS total FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def neighbors_sample_stats(spark, d):
    g = graph(spark, d, ("customer",), ("placed",))
    t = Traversal(hops=(Hop("placed"),), limit=3, sample=7, stats=_ORDER_STATS[:2])
    return traverse.stats(g, g.tag("customer").frame, t).withColumn("total", F.round("total", 2))


@query(f"SELECT _src AS _vid, '+contains' AS _type, _rank, _dst, l_quantity AS contains_l_quantity FROM ({_CONTAINS}) WHERE l_quantity > 30 AND l_discount <= 0.05")
def neighbors_filter_edge(spark, d):
    g = graph(spark, d, ("orders",), ("contains",))
    t = Traversal(edges={"contains": ["l_quantity"]}, filter="contains.l_quantity > 30 AND contains.l_discount <= 0.05")
    return renamed(traverse.edges(g, g.tag("orders").frame, t))


@query(f"SELECT _src AS _vid, '+placed' AS _type, _rank, _dst FROM ({_PLACED}) JOIN customer ON c_custkey = o_custkey WHERE c_acctbal > 5000 AND o_totalprice > 100 * c_acctbal / 10")
def neighbors_filter_source(spark, d):
    g = graph(spark, d, ("customer",), ("placed",))
    t = Traversal(hops=(Hop("placed"),), filter="$^.customer.c_acctbal > 5000 AND placed.o_totalprice > 100 * $^.customer.c_acctbal / 10")
    return traverse.edges(g, g.tag("customer").frame, t)


@query(f"SELECT _src AS _vid, '+placed' AS _type, _rank, _dst FROM ({_PLACED}) WHERE o_totalprice > 200000")
def neighbors_filter_one_type(spark, d):
    """A filter on one edge type is null, so false, on the others."""
    g = graph(spark, d, ("customer",), ("placed", "lives_in"))
    return traverse.edges(g, g.tag("customer").frame, Traversal(hops=(Hop("placed"), Hop("lives_in")), filter="placed.o_totalprice > 200000"))


@query(f"SELECT 'u' || user_id AS _vid, '+did' AS _type, event_id AS _rank, event_type AS _dst, value AS did_value FROM events WHERE floor(epoch(ts)) + {TTL} >= {NOW}")
def neighbors_ttl(spark, d):
    g = graph(spark, d, (), ("did",), now=NOW)
    vids = g.edge("did").frame.select(F.col("_src").alias("_vid"))
    return renamed(traverse.edges(g, vids, Traversal(edges={"did": ["value"]})))


@query("""SELECT v AS _vid, c_name AS name, CAST(coalesce(n, 0) AS BIGINT) AS n_orders, coalesce(dsts, '') AS orders FROM
(SELECT 'c' || c_custkey AS v FROM customer UNION ALL SELECT 'c-none')
LEFT JOIN (SELECT 'c' || c_custkey AS v, c_name FROM customer) USING (v)
LEFT JOIN (SELECT 'c' || o_custkey AS v, count(*) AS n, string_agg('o' || o_orderkey, ',' ORDER BY 'o' || o_orderkey) AS dsts FROM orders GROUP BY 1) USING (v)""")
def neighbors_nested(spark, d):
    """The nested result, read back cell by cell; a vertex that is nowhere still has its row."""
    g = graph(spark, d, ("customer",), ("placed",))
    vids = g.tag("customer").frame.select("_vid").union(spark.createDataFrame([("c-none",)], "_vid string"))
    rows = traverse.neighbors(g, vids, Traversal(tags={"customer": ["c_name"]}, edges={"placed": ["_dst", "o_totalprice"]}))
    cell = F.col("`_edge:+placed:_dst:o_totalprice`")
    return rows.select("_vid", F.col("`_tag:customer:c_name`.c_name").alias("name"), F.coalesce(F.size(cell), F.lit(0)).cast("long").alias("n_orders"), F.coalesce(F.array_join(cell["_dst"], ","), F.lit("")).alias("orders"))


@query("""WITH e AS (SELECT 'c' || o_custkey AS s, 'o' || o_orderkey AS t FROM orders UNION SELECT 'o' || l_orderkey, 'p' || l_partkey FROM lineitem)
SELECT a.s AS _vid, a.t AS _dst, 1 AS _hop FROM e a WHERE a.s IN (SELECT 'c' || c_custkey FROM customer WHERE c_acctbal > 9000)
UNION SELECT a.s, b.t, 2 FROM e a JOIN e b ON a.t = b.s WHERE a.s IN (SELECT 'c' || c_custkey FROM customer WHERE c_acctbal > 9000)""")
def walk_two_hops(spark, d):
    g = graph(spark, d, ("customer",), ("placed", "contains"))
    return traverse.walk(g, g.tag("customer").frame.where("c_acctbal > 9000"), 2, Traversal())


# Properties by key


@query("""SELECT v AS _vid, c_name AS customer_c_name, c_acctbal AS customer_c_acctbal, s_name AS supplier_s_name FROM
(SELECT 'c' || c_custkey AS v FROM customer UNION ALL SELECT 's' || s_suppkey FROM supplier UNION ALL SELECT 'x' || n_nationkey FROM nation)
LEFT JOIN (SELECT 'c' || c_custkey AS v, c_name, c_acctbal FROM customer) USING (v) LEFT JOIN (SELECT 's' || s_suppkey AS v, s_name FROM supplier) USING (v) WHERE c_name IS NOT NULL OR s_name IS NOT NULL""")
def props_vertices(spark, d):
    g = graph(spark, d, ("customer", "supplier"))
    keys = g.tag("customer").frame.select("_vid").union(g.tag("supplier").frame.select("_vid")).union(read(spark, d, "nation").select(vid("x", "n_nationkey")))
    return renamed(fetch.get_props(g, keys, vertex_props={"customer": ["c_name", "c_acctbal"], "supplier": ["s_name"]}))


@query(f"""SELECT k._src, k._rank, k._dst, o_totalprice AS placed_o_totalprice, segment AS lives_in_segment FROM
(SELECT _src, _rank, _dst FROM ({_PLACED}) UNION ALL SELECT 'c' || c_custkey, 0, 'n' || c_nationkey FROM customer UNION ALL SELECT 'c' || c_custkey, 9, 'nowhere' FROM customer) k
LEFT JOIN ({_PLACED}) p ON (p._src, p._rank, p._dst) = (k._src, k._rank, k._dst)
LEFT JOIN (SELECT 'c' || c_custkey AS _src, CAST(0 AS BIGINT) AS _rank, 'n' || c_nationkey AS _dst, c_mktsegment AS segment FROM customer) l ON (l._src, l._rank, l._dst) = (k._src, k._rank, k._dst)""")
def props_edges(spark, d):
    g = graph(spark, d, (), ("placed", "lives_in"))
    lost = read(spark, d, "customer").select(vid("c", "c_custkey").alias("_src"), F.lit(9).cast("long").alias("_rank"), F.lit("nowhere").alias("_dst"))
    keys = g.edge("placed").frame.select("_src", "_rank", "_dst").union(g.edge("lives_in").frame.select("_src", "_rank", "_dst")).union(lost)
    return renamed(fetch.get_props(g, keys, edge_props={"placed": ["o_totalprice"], "lives_in": ["segment"]}))


# Scans


@query("SELECT 'p' || p_partkey AS _vid, p_name, p_size FROM part")
def scan_tag(spark, d):
    return scan.scan_vertices(graph(spark, d, ("part",)), "part", ["p_name", "p_size"])


@query("SELECT 'p' || p_partkey AS _vid, p_name FROM part WHERE 'p' || p_partkey > 'p15' ORDER BY 1 LIMIT 50")
def scan_tag_page(spark, d):
    return scan.scan_vertices(graph(spark, d, ("part",)), "part", ["p_name"], cursor=("p15",), limit=50)


@query(f"SELECT _src, _rank, _dst, l_quantity FROM ({_CONTAINS})")
def scan_edge(spark, d):
    return scan.scan_edges(graph(spark, d, (), ("contains",)), "contains", ["l_quantity"])


@query(f"SELECT _src, _rank, _dst, l_quantity FROM ({_CONTAINS}) WHERE (_src, _rank, _dst) > ('o100', 1, 'p2') ORDER BY _src, _rank, _dst LIMIT 100")
def scan_edge_page(spark, d):
    return scan.scan_edges(graph(spark, d, (), ("contains",)), "contains", ["l_quantity"], cursor=("o100", 1, "p2"), limit=100)


@query("SELECT CAST(c_custkey % 6 + 1 AS BIGINT) AS part, count(*) AS n FROM customer GROUP BY 1")
def scan_parts(spark, d):
    return read(spark, d, "customer").groupBy(scan.int_part_of(F.col("c_custkey"), 6).alias("part")).agg(F.count(F.lit(1)).alias("n"))


# Lookups

_SEGMENT = View(("c_mktsegment", "c_acctbal"))


@query("SELECT 'c' || c_custkey AS customer__vid, c_acctbal AS customer_c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING'")
def lookup_equal(spark, d):
    g = graph(spark, d, ("customer",))
    return renamed(lookup.lookup(g, "customer", [Context((Hint("c_mktsegment", "BUILDING"),))], ["_vid", "c_acctbal"], _SEGMENT))


@query("SELECT 'c' || c_custkey AS customer__vid, c_acctbal AS customer_c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal >= 1000 AND c_acctbal < 5000")
def lookup_range(spark, d):
    g = graph(spark, d, ("customer",))
    hints = (Hint("c_mktsegment", "BUILDING"), Hint("c_acctbal", begin=1000.0, end=5000.0, range=True))
    return renamed(lookup.lookup(g, "customer", [Context(hints)], ["_vid", "c_acctbal"], _SEGMENT))


@query("SELECT 'c' || c_custkey AS customer__vid, c_name AS customer_c_name FROM customer WHERE c_mktsegment = 'BUILDING' OR c_mktsegment = 'MACHINERY' OR (c_mktsegment = 'BUILDING' AND c_acctbal < 0)")
def lookup_contexts(spark, d):
    g = graph(spark, d, ("customer",))
    contexts = [Context((Hint("c_mktsegment", "BUILDING"),)), Context((Hint("c_mktsegment", "MACHINERY"),)), Context((Hint("c_mktsegment", "BUILDING"), Hint("c_acctbal", end=0.0, range=True)))]
    return renamed(lookup.lookup(g, "customer", contexts, ["_vid", "c_name"], _SEGMENT))


@query("SELECT 'c' || c_custkey AS customer__vid FROM customer WHERE c_mktsegment = 'BUILDING' AND (c_acctbal > 3000 AND c_name LIKE '%7')")
def lookup_filter(spark, d):
    g = graph(spark, d, ("customer",))
    return renamed(lookup.lookup(g, "customer", [Context((Hint("c_mktsegment", "BUILDING"),), "customer.c_acctbal > 3000 AND c_name LIKE '%7'")], ["_vid"], _SEGMENT))


@query("SELECT 'c' || c_custkey AS customer__vid FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 3000")
def lookup_covering(spark, d):
    g = graph(spark, d, ("customer",))
    view = View(_SEGMENT.fields, lookup.covering(g, "customer", list(_SEGMENT.fields)))
    return renamed(lookup.lookup(g, "customer", [Context((Hint("c_mktsegment", "BUILDING"),), "c_acctbal > 3000")], ["_vid"], view))


@query("SELECT 'c' || c_custkey AS customer__vid FROM customer WHERE CASE WHEN c_acctbal < 0 THEN NULL ELSE c_mktsegment END IS NULL")
def lookup_null(spark, d):
    g = graph(spark, d, ("customer",))
    rows = g.tag("customer").frame.withColumn("c_mktsegment", F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")))
    return renamed(lookup.lookup(type(g).of({"customer": rows}, {}), "customer", [Context((Hint("c_mktsegment", None),))], ["_vid"], _SEGMENT))


@query("SELECT 'c' || c_custkey AS customer__vid FROM customer")
def lookup_keys_only(spark, d):
    return renamed(lookup.lookup(graph(spark, d, ("customer",)), "customer", [Context()], ["_vid"], View(())))


@query(f"SELECT _src AS placed__src, _rank AS placed__rank, _dst AS placed__dst, o_totalprice AS placed_o_totalprice FROM ({_PLACED}) WHERE o_orderstatus = 'F' AND o_totalprice >= 300000")
def lookup_edge(spark, d):
    g = graph(spark, d, (), ("placed",))
    hints = (Hint("o_orderstatus", "F"), Hint("o_totalprice", begin=300000.0, range=True))
    return renamed(lookup.lookup(g, "placed", [Context(hints)], ["_src", "_rank", "_dst", "o_totalprice"], View(("o_orderstatus", "o_totalprice"))))


@query(f"SELECT 'u' || user_id AS did__src, event_id AS did__rank FROM events WHERE value >= 50 AND floor(epoch(ts)) + {TTL} >= {NOW}")
def lookup_ttl(spark, d):
    g = graph(spark, d, (), ("did",), now=NOW)
    return renamed(lookup.lookup(g, "did", [Context((Hint("value", begin=50.0, range=True),))], ["_src", "_rank"], View(("value",))))


@query("SELECT _vid, kind FROM (SELECT 'p' || p_partkey AS _vid, 'prefix' AS kind FROM part WHERE lower(p_name) LIKE 'a%' UNION ALL SELECT 'p' || p_partkey, 'wildcard' FROM part WHERE lower(p_type) LIKE '%steel' UNION ALL SELECT 'p' || p_partkey, 'regexp' FROM part WHERE regexp_full_match(p_brand, 'Brand#[12].') UNION ALL SELECT 'p' || p_partkey, 'fuzzy' FROM part WHERE levenshtein(lower(p_brand), 'brand#11') <= 1)")
def lookup_text(spark, d):
    g = graph(spark, d, ("part",))
    asked = [("prefix", "p_name", {"prefix": "A"}), ("wildcard", "p_type", {"wildcard": "*STEEL"}), ("regexp", "p_brand", {"regexp": "Brand#[12]."}), ("fuzzy", "p_brand", {"fuzzy": "Brand#11", "distance": 1})]
    rows = [lookup.contains_text(g, "part", f, **o).select("_vid", F.lit(k).alias("kind")) for k, f, o in asked]
    return rows[0].union(rows[1]).union(rows[2]).union(rows[3])


# Expressions, one query for each group of kinds


@query("SELECT l_orderkey, l_linenumber, l_linenumber + 1 AS plus, l_linenumber - 5 AS minus, l_quantity * 2 AS times, round(l_quantity / nullif(l_linenumber - 1, 0), 6) AS over, CAST(l_linenumber % 3 AS BIGINT) AS modulo, -l_linenumber AS negative FROM lineitem")
def expr_arithmetic(spark, d):
    c = F.col
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (c("l_linenumber") + 1).alias("plus"), (c("l_linenumber") - 5).alias("minus"), (c("l_quantity") * 2).alias("times"), F.round(expr.divide(c("l_quantity"), c("l_linenumber") - 1), 6).alias("over"), expr.modulo(c("l_linenumber"), F.lit(3)).cast("long").alias("modulo"), (-c("l_linenumber")).alias("negative"))


@query("SELECT c_custkey, x IS NULL AS is_null, x IS NOT NULL AS not_null, coalesce(x > 0, false) AS filtered, c_acctbal = 0 OR c_acctbal != 0 AS any_value, c_acctbal <= 100 AS small, c_acctbal >= 100 AS big, NOT (c_acctbal < 0) AS credit FROM (SELECT *, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END AS x FROM customer)")
def expr_compare(spark, d):
    b, x = F.col("c_acctbal"), F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal"))
    return read(spark, d, "customer").select("c_custkey", x.isNull().alias("is_null"), x.isNotNull().alias("not_null"), expr.true_only(x > 0).alias("filtered"), ((b == 0) | (b != 0)).alias("any_value"), (b <= 100).alias("small"), (b >= 100).alias("big"), (~(b < 0)).alias("credit"))


@query("SELECT p_partkey, regexp_full_match(p_brand, 'Brand#1.') AS matches, contains(p_type, 'STEEL') AS contains, NOT contains(p_type, 'STEEL') AS lacks, starts_with(p_type, 'SMALL') AS starts, suffix(p_type, 'COPPER') AS ends FROM part")
def expr_string(spark, d):
    t = F.col("p_type")
    return read(spark, d, "part").select("p_partkey", expr.matches(F.col("p_brand"), "Brand#1.").alias("matches"), t.contains("STEEL").alias("contains"), (~t.contains("STEEL")).alias("lacks"), t.startswith("SMALL").alias("starts"), t.endswith("COPPER").alias("ends"))


@query("SELECT p_partkey, p_size IN (1, 5, 9) AS in_list, p_size NOT IN (1, 5, 9) AS not_in, CASE p_size WHEN 1 THEN 'one' WHEN 2 THEN 'two' ELSE 'many' END AS simple, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'middle' END AS searched, (p_size < 10) != (p_retailprice > 1000) AS x_or, (p_size < 10) AND (p_retailprice > 1000) AS both_, (p_size < 10) OR (p_retailprice > 1000) AS either FROM part")
def expr_logic(spark, d):
    s = F.col("p_size")
    a, b = s < 10, F.col("p_retailprice") > 1000
    return read(spark, d, "part").select("p_partkey", s.isin(1, 5, 9).alias("in_list"), (~s.isin(1, 5, 9)).alias("not_in"), F.when(s == 1, "one").when(s == 2, "two").otherwise("many").alias("simple"), F.when(s < 10, "small").when(s < 30, "middle").alias("searched"), expr.xor(a, b).alias("x_or"), (a & b).alias("both_"), (a | b).alias("either"))


@query("""SELECT o_custkey, CAST(len(l) AS BIGINT) AS n, CAST(len(list_filter(l, lambda x: x > 100000)) AS BIGINT) AS n_big, coalesce(list_sum(list_transform(list_filter(l, lambda x: x > 100000), lambda x: floor(x / 1000))), 0)::BIGINT AS thousands,
len(list_filter(l, lambda x: x > 1000)) = len(l) AS every_, len(list_filter(l, lambda x: x > 300000)) > 0 AS some_, len(list_filter(l, lambda x: x > 300000)) = 1 AS single_, len(list_filter(l, lambda x: x > 300000)) = 0 AS none_ FROM (SELECT o_custkey, list(o_totalprice) AS l FROM orders GROUP BY 1)""")
def expr_lists(spark, d):
    rows = read(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list("o_totalprice").alias("l"))
    big = lambda x: x > 300000
    kept = expr.comprehension(F.col("l"), lambda x: x > 100000, lambda x: F.floor(x / 1000))
    return rows.select("o_custkey", F.size("l").cast("long").alias("n"), F.size(expr.comprehension(F.col("l"), lambda x: x > 100000)).cast("long").alias("n_big"), expr.reduced(kept, F.lit(0).cast("long"), lambda a, x: a + x).alias("thousands"), expr.every(F.col("l"), lambda x: x > 1000).alias("every_"), expr.some(F.col("l"), big).alias("some_"), expr.single(F.col("l"), big).alias("single_"), expr.none(F.col("l"), big).alias("none_"))


@query("SELECT n_nationkey, CAST(len(list_distinct([n_nationkey, n_regionkey, n_nationkey])) AS BIGINT) AS n_set, [n_nationkey, n_regionkey][1] AS first_item, map(['a', 'b'], [n_nationkey, n_regionkey])['b'] AS of_map FROM nation")
def expr_literals(spark, d):
    n, r = F.col("n_nationkey"), F.col("n_regionkey")
    return read(spark, d, "nation").select("n_nationkey", F.size(expr.distinct_list(n, r, n)).cast("long").alias("n_set"), F.array(n, r)[0].alias("first_item"), F.create_map(F.lit("a"), n, F.lit("b"), r)["b"].alias("of_map"))


@query("SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS as_text, CAST(floor(o_totalprice) AS BIGINT) AS as_int, CAST(o_orderdate AS DATE) AS as_date, TRY_CAST(o_orderpriority AS INTEGER) AS not_a_number, lower(o_orderpriority) AS low, CAST(length(o_orderpriority) AS BIGINT) AS size, abs(o_totalprice - 1000) AS far, CAST(year(o_orderdate) AS BIGINT) AS y, substr(o_orderpriority, 1, 1) AS head FROM orders")
def expr_functions(spark, d):
    c = F.col
    return read(spark, d, "orders").select("o_orderkey", c("o_orderkey").cast("string").alias("as_text"), F.floor("o_totalprice").cast("long").alias("as_int"), c("o_orderdate").cast("date").alias("as_date"), c("o_orderpriority").try_cast("int").alias("not_a_number"), F.lower("o_orderpriority").alias("low"), F.length("o_orderpriority").cast("long").alias("size"), F.abs(c("o_totalprice") - 1000).alias("far"), F.year("o_orderdate").cast("long").alias("y"), F.substring("o_orderpriority", 1, 1).alias("head"))


@query(f"SELECT _src AS _vid, '+contains' AS _type, _rank, _dst FROM ({_CONTAINS}) WHERE _rank = 1 AND _src < 'o2' AND _dst >= 'p1' AND upper(l_returnflag) IN ('A', 'N', 'R') AND CAST(l_linenumber AS DOUBLE) + l_quantity / 2 > 10")
def expr_edge_keys(spark, d):
    g = graph(spark, d, ("orders",), ("contains",))
    t = Traversal(hops=(Hop("contains"),), filter="contains._rank = 1 AND contains._src < 'o2' AND contains._dst >= 'p1' AND contains._type > 0 AND CAST(contains.l_linenumber AS DOUBLE) + contains.l_quantity / 2 > 10")
    return traverse.edges(g, g.tag("orders").frame, t)


@query("SELECT c_custkey, x IS NULL AS is_empty, x IS NOT NULL AS not_empty, c_custkey + 1 AS up, c_custkey - 1 AS down, +c_acctbal AS plus FROM (SELECT *, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END AS x FROM customer)")
def expr_unary(spark, d):
    """IS [NOT] EMPTY: a value that a row lacks is null here; ++ and -- give the next and the last whole number."""
    x, k = F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")), F.col("c_custkey")
    return read(spark, d, "customer").select("c_custkey", expr.is_empty(x).alias("is_empty"), (~expr.is_empty(x)).alias("not_empty"), expr.increment(k).alias("up"), expr.decrement(k).alias("down"), F.expr("+c_acctbal").alias("plus"))


# Changes: the delta comes from the tables themselves

_CUSTOMER_PROPS = ["c_name", "c_acctbal", "c_mktsegment"]


def _customers(spark, d):
    return tag(spark, d, "customer").select("_vid", *_CUSTOMER_PROPS)


def _new_customers(spark, d):
    """Some known and some new ids, each twice."""
    rows = read(spark, d, "customer").where("c_custkey % 3 = 0")
    old = rows.select(vid("c", "c_custkey").alias("_vid"), "c_name", (F.col("c_acctbal") + 1).alias("c_acctbal"), F.lit("FIRST").alias("c_mktsegment"), (F.col("c_custkey") * 2).alias("_ord"))
    again = rows.select(vid("c", "c_custkey").alias("_vid"), "c_name", (F.col("c_acctbal") + 2).alias("c_acctbal"), F.lit("SECOND").alias("c_mktsegment"), (F.col("c_custkey") * 2 + 1).alias("_ord"))
    both = old.union(again)
    return both.union(both.withColumn("_vid", F.concat(F.lit("new-"), "_vid")))


@query("""SELECT 'c' || c_custkey AS _vid, c_name, c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 3 != 0
UNION ALL SELECT p || 'c' || c_custkey, c_name, c_acctbal + 2, 'SECOND' FROM customer, (VALUES (''), ('new-')) t(p) WHERE c_custkey % 3 = 0""")
def add_vertices(spark, d):
    return mutate.upsert(_customers(spark, d), _new_customers(spark, d), ["_vid"])


@query("""SELECT 'c' || c_custkey AS _vid, c_name, c_acctbal, c_mktsegment FROM customer
UNION ALL SELECT 'new-c' || c_custkey, c_name, c_acctbal + 1, 'FIRST' FROM customer WHERE c_custkey % 3 = 0""")
def add_vertices_if_not_exists(spark, d):
    return mutate.insert_absent(_customers(spark, d), _new_customers(spark, d), ["_vid"])


_EDGE_KEYS = ["_src", "_rank", "_dst"]


@query(f"SELECT _src, _rank, _dst, o_totalprice FROM ({_PLACED}) WHERE o_orderkey % 4 != 0 UNION ALL SELECT _src, _rank, _dst, o_totalprice + 1 FROM ({_PLACED}) WHERE o_orderkey % 4 = 0 UNION ALL SELECT _src, 7, _dst, o_totalprice + 1 FROM ({_PLACED}) WHERE o_orderkey % 4 = 0")
def add_edges(spark, d):
    base = edge(spark, d, "placed").select(*_EDGE_KEYS, "o_totalprice")
    some = read(spark, d, "orders").where("o_orderkey % 4 = 0").select(vid("c", "o_custkey").alias("_src"), F.lit(0).cast("long").alias("_rank"), vid("o", "o_orderkey").alias("_dst"), (F.col("o_totalprice") + 1).alias("o_totalprice"))
    return mutate.upsert(base, some.union(some.withColumn("_rank", F.lit(7).cast("long"))), _EDGE_KEYS)


@query(f"SELECT _src, _rank, _dst, o_totalprice FROM ({_PLACED}) UNION ALL SELECT _src, 7, _dst, o_totalprice + 1 FROM ({_PLACED}) WHERE o_orderkey % 4 = 0")
def add_edges_if_not_exists(spark, d):
    base = edge(spark, d, "placed").select(*_EDGE_KEYS, "o_totalprice")
    some = read(spark, d, "orders").where("o_orderkey % 4 = 0").select(vid("c", "o_custkey").alias("_src"), F.lit(0).cast("long").alias("_rank"), vid("o", "o_orderkey").alias("_dst"), (F.col("o_totalprice") + 1).alias("o_totalprice"))
    return mutate.insert_absent(base, some.union(some.withColumn("_rank", F.lit(7).cast("long"))), _EDGE_KEYS)


@query(f"SELECT 1 AS _dir, _src, _rank, _dst, o_totalprice FROM ({_PLACED}) UNION ALL SELECT -1, _dst, _rank, _src, o_totalprice FROM ({_PLACED})")
def add_edges_atomic(spark, d):
    rows = edge(spark, d, "placed").select(*_EDGE_KEYS, "o_totalprice")
    return mutate.both_directions(mutate.upsert(rows.limit(0), rows, _EDGE_KEYS)).select("_dir", *_EDGE_KEYS, "o_totalprice")


@query("SELECT 'c' || c_custkey AS _vid, c_name FROM customer WHERE c_acctbal >= 0")
def delete_vertices(spark, d):
    rows = _customers(spark, d)
    return mutate.delete(rows, rows.where("c_acctbal < 0"), ["_vid"]).select("_vid", "c_name")


@query("SELECT 's' || s_suppkey AS _vid, s_name FROM supplier WHERE s_suppkey % 5 != 0")
def delete_tags(spark, d):
    rows = tag(spark, d, "supplier").select("_vid", "s_name", "s_suppkey")
    gone = rows.where("s_suppkey % 5 = 0").select("_vid").union(spark.createDataFrame([("nobody",)], "_vid string"))
    return mutate.delete(rows.drop("s_suppkey"), gone, ["_vid"])


@query(f"SELECT _src, _rank, _dst, l_quantity FROM ({_CONTAINS}) WHERE l_quantity >= 10")
def delete_edges(spark, d):
    rows = edge(spark, d, "contains").select(*_EDGE_KEYS, "l_quantity")
    return mutate.delete(rows, rows.where("l_quantity < 10"), _EDGE_KEYS)


_ACCOUNT = Version((Prop("c_name", "STRING"), Prop("c_acctbal", "DOUBLE"), Prop("c_mktsegment", "STRING", default="'NONE'")))


@query("SELECT 'c' || c_custkey AS _vid, c_name, CASE WHEN hit THEN (c_acctbal + 10) * 2 ELSE c_acctbal END AS c_acctbal, CASE WHEN hit THEN CASE WHEN (c_acctbal + 10) * 2 > 5000 THEN 'RICH' ELSE 'POOR' END ELSE c_mktsegment END AS c_mktsegment FROM (SELECT *, c_custkey % 2 = 0 AND c_acctbal > 0 AS hit FROM customer)")
def update_vertex(spark, d):
    """SET items see the ones before them."""
    rows = _customers(spark, d)
    targets = read(spark, d, "customer").where("c_custkey % 2 = 0").select(vid("c", "c_custkey").alias("_vid"))
    sets = (("c_acctbal", "c_acctbal + 10"), ("c_acctbal", "c_acctbal * 2"), ("c_mktsegment", "if(c_acctbal > 5000, 'RICH', 'POOR')"))
    return mutate.update(rows, targets, ["_vid"], Update(sets, "c_acctbal > 0"), _ACCOUNT)[0]


@query("SELECT 'c' || c_custkey AS _vid, false AS _inserted, CASE WHEN c_acctbal > 0 THEN 'SUCCEEDED' ELSE 'FILTER_OUT' END AS _status, CASE WHEN c_acctbal > 0 THEN c_acctbal + 10 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT 'x' || n_nationkey, false, 'KEY_NOT_FOUND', NULL FROM nation")
def update_vertex_result(spark, d):
    rows = _customers(spark, d)
    targets = read(spark, d, "customer").where("c_custkey % 2 = 0").select(vid("c", "c_custkey").alias("_vid")).union(read(spark, d, "nation").select(vid("x", "n_nationkey")))
    u = Update((("c_acctbal", "c_acctbal + 10"),), "c_acctbal > 0", returns=("c_acctbal",))
    return mutate.update(rows, targets, ["_vid"], u, _ACCOUNT)[1]


@query("SELECT 'c' || c_custkey AS _vid, 'changed' AS c_name, c_acctbal, c_mktsegment FROM customer UNION ALL SELECT 'x' || n_nationkey, 'changed', 1.0, 'NONE' FROM nation")
def upsert_vertex(spark, d):
    """An absent row is inserted whatever the condition; what is not set takes its default."""
    rows = _customers(spark, d)
    targets = rows.select("_vid").union(read(spark, d, "nation").select(vid("x", "n_nationkey")))
    version = Version((Prop("c_name", "STRING"), Prop("c_acctbal", "DOUBLE", default="1.0"), Prop("c_mktsegment", "STRING", default="'NONE'")))
    u = Update((("c_name", "'changed'"),), "c_acctbal IS NOT NULL", insertable=True)
    return mutate.update(rows, targets, ["_vid"], u, version)[0]


@query(f"SELECT _src, _rank, _dst, CASE WHEN o_orderkey % 5 = 0 THEN round(o_totalprice) ELSE o_totalprice END AS o_totalprice, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM ({_PLACED})")
def update_edge(spark, d):
    rows = edge(spark, d, "placed").select(*_EDGE_KEYS, "o_totalprice", "o_orderstatus")
    targets = read(spark, d, "orders").where("o_orderkey % 5 = 0").select(vid("c", "o_custkey").alias("_src"), F.lit(0).cast("long").alias("_rank"), vid("o", "o_orderkey").alias("_dst"))
    version = Version((Prop("o_totalprice", "DOUBLE"), Prop("o_orderstatus", "STRING")))
    return mutate.update(rows, targets, _EDGE_KEYS, Update((("o_totalprice", "round(o_totalprice)"), ("o_orderstatus", "'X'"))), version)[0]


@query("""SELECT 'p' || p_partkey AS _vid, p_name AS name, CASE WHEN p_size BETWEEN -128 AND 127 AND p_size * 10 BETWEEN -128 AND 127 THEN p_size * 10 END AS small, CASE WHEN p_size * 10 > 127 THEN 'OUT_OF_RANGE' END AS error, substr(p_brand, 1, 5) AS brand, 3 AS filled, CAST(NULL AS DOUBLE) AS nothing FROM part""")
def schema_coercion(spark, d):
    """Values of a request as the schema stores them: range checks, cut strings, defaults and nulls."""
    version = Version((Prop("name", "STRING"), Prop("small", "INT8", True), Prop("brand", "FIXED_STRING(5)"), Prop("filled", "INT64", default="3"), Prop("nothing", "DOUBLE", True)))
    rows = read(spark, d, "part").select(vid("p", "p_partkey").alias("_vid"), "p_name", (F.col("p_size").cast("long") * 10).alias("size"), "p_brand")
    ready = mutate.resolved(rows, ["_vid"], version, ["name", "small", "brand"])
    return ready.select("_vid", "name", F.col("small").cast("int").alias("small"), F.col("_error").alias("error"), "brand", F.col("filled").cast("int").alias("filled"), "nothing")


# Key-value pairs


def _pairs(spark, d):
    return read(spark, d, "part").select(vid("k", "p_partkey").alias("key"), F.col("p_name").alias("value"))


@query("SELECT 'k' || p_partkey AS key, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE p_name END AS value FROM part UNION ALL SELECT 'new' || p_partkey, p_brand FROM part WHERE p_partkey % 2 = 0")
def kv_put(spark, d):
    rows = read(spark, d, "part").where("p_partkey % 2 = 0")
    new = rows.select(vid("k", "p_partkey").alias("key"), F.col("p_brand").alias("value"))
    return kv.put(_pairs(spark, d), new.union(rows.select(vid("new", "p_partkey"), "p_brand")))


@query("SELECT 'k' || p_partkey AS key, p_name AS value FROM part WHERE p_partkey % 7 = 0")
def kv_get(spark, d):
    return kv.get(_pairs(spark, d), read(spark, d, "part").where("p_partkey % 7 = 0").select(vid("k", "p_partkey").alias("key")))


@query("SELECT 'k' || p_partkey AS key, p_name AS value FROM part WHERE p_partkey < 20")
def kv_get_partly(spark, d):
    keys = spark.range(-20, 20).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    return kv.get(_pairs(spark, d), keys, return_partly=True)


@query("SELECT 'k' || p_partkey AS key, p_name AS value FROM part WHERE p_partkey % 7 != 0")
def kv_remove(spark, d):
    return kv.remove(_pairs(spark, d), read(spark, d, "part").where("p_partkey % 7 = 0").select(vid("k", "p_partkey").alias("key")))


@query("SELECT 'k' || p_partkey AS key, p_name AS value FROM part WHERE NOT ('k' || p_partkey >= 'k10' AND 'k' || p_partkey < 'k15')")
def kv_remove_range(spark, d):
    return kv.remove_range(_pairs(spark, d), "k10", "k15")


@query("SELECT 'k' || p_partkey AS key, p_name AS value FROM part WHERE 'k' || p_partkey >= 'k10' AND 'k' || p_partkey < 'k15'")
def kv_scan(spark, d):
    return kv.scan(_pairs(spark, d), "k10", "k15")


@query("SELECT 'k' || p_partkey AS key, p_name AS value FROM part WHERE 'k' || p_partkey LIKE 'k1%' AND 'k' || p_partkey >= 'k12'")
def kv_prefix(spark, d):
    return kv.prefix(_pairs(spark, d), "k1", "k12")


# Jobs


@query("""SELECT 'tag' AS kind, 'customer' AS name, count(*) AS count FROM customer UNION ALL SELECT 'tag', 'orders', count(*) FROM orders UNION ALL SELECT 'edge', 'placed', count(*) FROM orders UNION ALL SELECT 'edge', 'lives_in', count(*) FROM customer
UNION ALL SELECT 'space', 'vertices', (SELECT count(*) FROM customer) + (SELECT count(*) FROM orders) UNION ALL SELECT 'space', 'edges', (SELECT count(*) FROM customer) + (SELECT count(*) FROM orders)""")
def job_statistics(spark, d):
    return jobs.statistics(graph(spark, d, ("customer", "orders"), ("placed", "lives_in")))


@query("""WITH e AS (SELECT o_custkey % 4 + 1 AS s, o_orderkey % 4 + 1 AS t FROM orders), p AS (SELECT s, t, count(*) AS n FROM e GROUP BY 1, 2), total AS (SELECT s, sum(n) AS total FROM p GROUP BY 1),
b AS (SELECT part, other, sum(o) AS o, sum(i) AS i FROM (SELECT s AS part, t AS other, n AS o, 0 AS i FROM p UNION ALL SELECT t, s, 0, n FROM p) GROUP BY 1, 2)
SELECT part, other, round(o / total, 9) AS out_share, round(i / total, 9) AS in_share FROM b JOIN total ON s = part""")
def job_correlativity(spark, d):
    number = lambda v, n: scan.int_part_of(F.substring(v, 2, 20).cast("long"), n)
    rows = jobs.correlativity(graph(spark, d, (), ("placed",)), 4, number)
    return rows.withColumns({"out_share": F.round("out_share", 9), "in_share": F.round("in_share", 9)})


@query(f"SELECT 'u' || user_id AS _src, event_id AS _rank, event_type AS _dst, value FROM events WHERE floor(epoch(ts)) + {TTL} >= {NOW}")
def job_vacuum(spark, d):
    return jobs.vacuumed(graph(spark, d, (), ("did",), now=NOW)).edge("did").frame.select("_src", "_rank", "_dst", "value")


@query("SELECT 'placed' AS edge, 'c' || o_custkey AS _src, CAST(0 AS BIGINT) AS _rank, 'o' || o_orderkey AS _dst, '_src' AS missing FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal < 0")
def job_dangling(spark, d):
    g = graph(spark, d, ("customer", "orders"), ("placed",))
    tags = {"customer": g.tag("customer").frame.where("c_acctbal >= 0"), "orders": g.tag("orders").frame}
    return jobs.dangling(type(g).of(tags, {"placed": g.edge("placed").frame}))


@query("SELECT 'c' || c_custkey AS _vid, c_mktsegment, c_acctbal FROM customer")
def index_rebuild(spark, d):
    return lookup.covering(graph(spark, d, ("customer",)), "customer", ["c_mktsegment", "c_acctbal"])


def _job_log(spark, d):
    store = new_store(spark)
    store.catalog.create("shop", "tag", "customer", [Prop("name", "STRING")])
    store.catalog.create_index("shop", "by_name", "customer", [IndexField("name", 20)])
    store.commit()
    store.insert("shop", "customer", read(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("_vid"), F.col("c_name").alias("name")))
    log = JobLog(store)
    for command, *paras in (("STATS",), ("REBUILD_TAG_INDEX", "by_name"), ("REBUILD_EDGE_INDEX", "by_name"), ("COMPACT",), ("FLUSH",)):
        log.add("shop", command, *paras)
    log.stop(5)
    log.run()
    return log


@query("SELECT * FROM (VALUES (1, 'STATS', 'FINISHED'), (2, 'REBUILD_TAG_INDEX', 'FINISHED'), (3, 'REBUILD_EDGE_INDEX', 'FAILED'), (4, 'COMPACT', 'FINISHED'), (5, 'FLUSH', 'STOPPED')) t(id, command, status)")
def job_queue(spark, d):
    return _job_log(spark, d).show().select("id", "command", "status")


@query("SELECT 'tag' AS kind, 'customer' AS name, count(*) AS count FROM customer UNION ALL SELECT 'space', 'vertices', count(*) FROM customer")
def job_results(spark, d):
    return _job_log(spark, d).statistics("shop")


# Through a store of its own: what was written is read back, by index, scan and traversal

_CUSTOMER = (Prop("name", "STRING"), Prop("balance", "DOUBLE", True), Prop("segment", "STRING", default="'NONE'"))


def _customer_rows(spark, d):
    return read(spark, d, "customer").select(vid("c", "c_custkey").alias("_vid"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))


def _indexed_store(spark, d):
    """Half of the customers, inserted before the index is built; the other half, after."""
    store = new_store(spark)
    store.catalog.create(SPACE, "tag", "customer", list(_CUSTOMER))
    store.catalog.create_index(SPACE, "by_segment", "customer", [IndexField("segment", 16), IndexField("balance")])
    rows = _customer_rows(spark, d)
    even = F.substring("_vid", 2, 20).cast("long") % 2 == 0
    store.insert(SPACE, "customer", rows.where(even))
    store.rebuild_index(SPACE, "by_segment")
    store.insert(SPACE, "customer", rows.where(~even))
    return store


def _building(store, low=None):
    hints = (Hint("segment", "BUILDING"), *(() if low is None else (Hint("balance", begin=low, range=True),)))
    assert store.view(SPACE, "by_segment").frame is not None
    return renamed(store.lookup(SPACE, "by_segment", [Context(hints)], ["_vid", "balance"]))


@query("SELECT 'c' || c_custkey AS customer__vid, c_acctbal AS customer_balance FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal >= 0")
def store_lookup_after_insert(spark, d):
    return _building(_indexed_store(spark, d), 0.0)


@query("""SELECT _vid AS customer__vid, balance AS customer_balance FROM (SELECT 'c' || c_custkey AS _vid, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS balance,
CASE WHEN c_custkey % 3 = 0 THEN CASE WHEN c_mktsegment = 'BUILDING' THEN 'MOVED' ELSE 'BUILDING' END ELSE c_mktsegment END AS segment FROM customer) WHERE segment = 'BUILDING'""")
def store_lookup_after_update(spark, d):
    store = _indexed_store(spark, d)
    targets = read(spark, d, "customer").where("c_custkey % 3 = 0").select(vid("c", "c_custkey").alias("_vid"))
    store.update(SPACE, "customer", targets, Update((("balance", "balance + 1"), ("segment", "if(segment = 'BUILDING', 'MOVED', 'BUILDING')"))))
    return _building(store)


@query("SELECT 'c' || c_custkey AS customer__vid, c_acctbal AS customer_balance FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey % 3 != 0")
def store_lookup_after_delete(spark, d):
    store = _indexed_store(spark, d)
    store.delete_vertices(SPACE, read(spark, d, "customer").where("c_custkey % 3 = 0").select(vid("c", "c_custkey").alias("_vid")))
    return _building(store)


@query("SELECT 'c' || c_custkey AS customer__vid, c_acctbal AS customer_balance FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey % 3 != 0")
def store_lookup_after_compaction(spark, d):
    store = _indexed_store(spark, d)
    store.delete(SPACE, "customer", read(spark, d, "customer").where("c_custkey % 3 = 0").select(vid("c", "c_custkey").alias("_vid")))
    store.compact(SPACE, "customer")
    return _building(store)


def _order_store(spark, d):
    store = new_store(spark)
    load(store, spark, d, "placed")
    store.catalog.create_index(SPACE, "by_status", "placed", [IndexField("o_orderstatus", 4), IndexField("o_totalprice")])
    store.commit()
    return store


@query("SELECT 'by_status' AS name, 'FINISHED' AS status, 'FINISHED' AS job, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 200000) AS n")
def store_rebuild_edge_index(spark, d):
    store = _order_store(spark, d)
    log = JobLog(store)
    job = log.add(SPACE, "REBUILD_EDGE_INDEX", "by_status")
    log.run()
    hints = (Hint("o_orderstatus", "F"), Hint("o_totalprice", begin=200000.0, range=True))
    n = store.lookup(SPACE, "by_status", [Context(hints)], ["_rank"]).agg(F.count(F.lit(1)).alias("n"))
    return log.index_status(SPACE, "edge").crossJoin(log.show(job).select(F.col("status").alias("job"))).crossJoin(n)  # one row each


@query(f"SELECT _src, _rank, _dst, o_totalprice FROM ({_PLACED}) WHERE o_orderkey % 4 != 0 UNION ALL SELECT _src, 7, _dst, o_totalprice + 1 FROM ({_PLACED}) WHERE o_orderkey % 4 = 0")
def store_batch(spark, d):
    """Edges put and others removed in one commit."""
    store, some = _order_store(spark, d), read(spark, d, "orders").where("o_orderkey % 4 = 0")
    keys = some.select(vid("c", "o_custkey").alias("_src"), F.lit(0).cast("long").alias("_rank"), vid("o", "o_orderkey").alias("_dst"), (F.col("o_totalprice") + 1).alias("o_totalprice"))
    with store.batch():
        store.delete(SPACE, "placed", keys)
        store.insert(SPACE, "placed", keys.withColumn("_rank", F.lit(7).cast("long")), ["o_totalprice"])
    return store.frame(SPACE, "placed").select(*_EDGE_KEYS, "o_totalprice")


@query(f"SELECT _src, _rank, _dst, true AS _inserted, 'SUCCEEDED' AS _status, 1.0 AS o_totalprice FROM (SELECT _src, CAST(5 AS BIGINT) AS _rank, _dst FROM ({_PLACED}) WHERE o_orderkey % 5 = 0) UNION ALL SELECT _src, _rank, _dst, false, CASE WHEN o_totalprice > 100000 THEN 'SUCCEEDED' ELSE 'FILTER_OUT' END, CASE WHEN o_totalprice > 100000 THEN 1.0 ELSE o_totalprice END FROM ({_PLACED}) WHERE o_orderkey % 5 = 0")
def store_upsert_edge(spark, d):
    """The values that an upsert of edges returns: new ones, changed ones, and old ones where the condition fails."""
    store, some = _order_store(spark, d), read(spark, d, "orders").where("o_orderkey % 5 = 0")
    keys = some.select(vid("c", "o_custkey").alias("_src"), F.explode(F.array(F.lit(0).cast("long"), F.lit(5).cast("long"))).alias("_rank"), vid("o", "o_orderkey").alias("_dst"))
    u = Update((("o_totalprice", "1.0D"),), "o_totalprice > 100000", insertable=True, returns=("o_totalprice",))
    return store.update(SPACE, "placed", keys, u)


@query("SELECT 'c' || c_custkey AS _vid, c_name AS name FROM customer WHERE c_custkey % 3 = 0")
def store_snapshot_restore(spark, d):
    store = new_store(spark)
    store.catalog.create(SPACE, "tag", "customer", list(_CUSTOMER))
    rows = _customer_rows(spark, d)
    store.insert(SPACE, "customer", rows.where("CAST(substr(_vid, 2) AS long) % 3 = 0"))
    store.snapshot("third")
    store.insert(SPACE, "customer", rows)
    store.restore("third")
    return store.frame(SPACE, "customer").select("_vid", "name")


@query("SELECT 'c' || c_custkey AS _vid, c_name AS name FROM customer")
def store_backup_ingest(spark, d):
    """Rows of files, ingested, backed up into a store of its own and read there."""
    store = new_store(spark)
    store.catalog.create(SPACE, "tag", "customer", list(_CUSTOMER))
    files = f"{store.root}-files"
    _customer_rows(spark, d).write.parquet(files)
    store.ingest(SPACE, "customer", files)
    store.backup(f"{store.root}-copy")
    return Store(spark, f"{store.root}-copy").frame(SPACE, "customer").select("_vid", "name")


@query("SELECT 'tag' AS kind, 'customer' AS name, count(*) AS count FROM customer WHERE c_acctbal >= 0 UNION ALL SELECT 'edge', 'placed', count(*) FROM orders")
def store_compaction_filter(spark, d):
    """What a space holds once a dropped tag, expired rows and deleted ones have been cleared away."""
    store = _order_store(spark, d)
    props = [Prop("balance", "DOUBLE"), Prop("at", "INT64")]
    store.catalog.create(SPACE, "tag", "customer", props, "at", 10)
    store.catalog.create(SPACE, "tag", "lost", [])
    rows = read(spark, d, "customer").select(vid("c", "c_custkey").alias("_vid"), F.col("c_acctbal").alias("balance"), F.when(F.col("c_acctbal") < 0, 0).otherwise(1000).cast("long").alias("at"))
    store.insert(SPACE, "customer", rows)
    store.insert(SPACE, "lost", rows.select("_vid"))
    store.catalog.drop(SPACE, "lost", "tag")
    store.commit()
    log = JobLog(store)
    log.add(SPACE, "COMPACT")
    log.run(now=500)
    store.vacuum()
    return store.dump_stats(SPACE)


@query("SELECT token, count(*) AS n FROM (SELECT DISTINCT p_partkey, unnest(regexp_extract_all(lower(p_name), '[\\p{L}\\p{N}]+')) AS token FROM part WHERE p_partkey % 5 != 0) GROUP BY 1")
def store_fulltext(spark, d):
    """Tokens that a listener keeps of what the store's writes committed, deletes included; rebuilt by a job."""
    store = new_store(spark)
    store.catalog.create(SPACE, "tag", "part", [Prop("name", "STRING")])
    store.catalog.create_fulltext(SPACE, "names", "part", ["name"])
    store.catalog.add_listener(SPACE, "fulltext", f"{store.root}-text")
    rows = read(spark, d, "part").select(vid("p", "p_partkey").alias("_vid"), F.col("p_name").alias("name"))
    store.insert(SPACE, "part", rows.withColumn("name", F.lit("old text")))
    Listener(store, SPACE).catch_up()
    store.insert(SPACE, "part", rows)
    store.delete(SPACE, "part", rows.where("CAST(substr(_vid, 2) AS long) % 5 = 0"))
    log = JobLog(store)
    log.add(SPACE, "REBUILD_FULLTEXT_INDEX")
    log.run()
    return Listener(store, SPACE).tokens("part").groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT part, count(*) AS n FROM (SELECT c_custkey % 1 AS part FROM customer) GROUP BY 1")
def store_dump_parts(spark, d):
    """The dumps of all partitions together are the table."""
    store = stored(spark, d, ("customer",))
    parts = [store.dump(SPACE, "customer", parts=[p]).select(F.lit(0).cast("long").alias("part")) for p in range(1, 7)]
    return reduce(lambda a, b: a.union(b), parts).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT (extract(epoch FROM time_bucket(INTERVAL 1 HOUR, ts)) / 3600)::BIGINT AS hour, event_type AS name, 'put' AS op, count(*) AS n FROM events GROUP BY 1, 2")
def feed_activity(spark, d):
    """Entries of a change feed counted by hour: a stream with a watermark, followed until all has been read."""
    root = f"{shared_dir(spark)}/graphloom-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}-feed"
    rows = read(spark, d, "events").select(F.col("event_id").alias("seq"), F.lit("put").alias("op"), F.col("event_type").alias("name"), F.to_json(F.struct("event_id")).alias("key"), F.lit(None).cast("string").alias("row"), F.col("ts").cast("timestamp").alias("ts"))
    feed.append(f"{root}/log", rows)
    counted = feed.activity(feed.follow(spark, f"{root}/log"), late="3650 days")
    keep = lambda batch, number: batch.write.mode("overwrite").parquet(f"{root}/sink/batch={number:010d}")
    counted.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    kept = spark.read.parquet(f"{root}/sink")
    newest = kept.groupBy("start", "name", "op").agg(F.max_by("n", "batch").alias("n"))
    return newest.select(F.floor(F.unix_timestamp("start") / 3600).alias("hour"), "name", "op", "n")


@query("SELECT 'p' || p_partkey AS key, p_brand AS row FROM part WHERE p_partkey % 3 != 0")
def feed_state(spark, d):
    """The newest entry of each key, though the entries arrive with the older ones last."""
    root = f"{shared_dir(spark)}/graphloom-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}-feed"
    part = read(spark, d, "part")
    entry = lambda rows, seq, op, row: rows.select(F.lit(seq).cast("long").alias("seq"), F.lit(op).alias("op"), F.lit("part").alias("name"), vid("p", "p_partkey").alias("key"), row.cast("string").alias("row"), F.current_timestamp().alias("ts"))
    for entries in (entry(part.where("p_partkey % 3 = 0"), 3, "delete", F.lit(None)), entry(part, 2, "put", F.col("p_brand")), entry(part, 1, "put", F.col("p_name"))):
        feed.append(f"{root}/log", entries)
        feed.replicate(feed.follow(spark, f"{root}/log"), feed.parquet_sink(f"{root}/sink"), f"{root}/checkpoint").awaitTermination()
    return feed.state(spark, f"{root}/sink").select("key", "row")


@query("SELECT count(*)::BIGINT AS n, max(n) AS highest FROM (SELECT unnest(generate_series(1, 6)) AS n)")
def store_compare_and_set(spark, d):
    """Two writers take numbers in turn; each change is made on the newest state, so none is lost."""
    one = new_store(spark)
    one.catalog.register_setting("app", "last", 0)
    one.commit()
    two, taken = Store(spark, one.root), []

    def take(store):
        store.catalog.set_setting("app", "last", store.catalog.get_setting("app", "last") + 1)
        return store.catalog.get_setting("app", "last")

    for writer in (one, two, two, one, two, one):
        taken.append((writer.atomic(take),))
    return spark.createDataFrame(taken, "n long").distinct().agg(F.count(F.lit(1)).alias("n"), F.max("n").alias("highest"))


@query("SELECT 6 AS parts, CAST(1.0 AS DOUBLE) AS least, CAST(1.0 AS DOUBLE) AS most, (SELECT count(*) FROM orders) AS edges")
def job_shares(spark, d):
    """What a STATS job kept: the out-shares of every partition come to 1."""
    store = new_store(spark)
    load(store, spark, d, "placed")
    log = JobLog(store)
    log.add(SPACE, "STATS")
    log.run()
    sums = log.correlativity(SPACE).groupBy("part").agg(F.sum("out_share").alias("s"))
    shares = sums.agg(F.count(F.lit(1)).cast("int").alias("parts"), F.round(F.min("s"), 9).alias("least"), F.round(F.max("s"), 9).alias("most"))
    edges = log.statistics(SPACE).where("kind = 'edge'").select(F.col("count").alias("edges"))
    return shares.crossJoin(edges)  # one row each


# The catalog


def _catalog() -> Catalog:
    c = Catalog()
    c.create_space("shop", 6, 1, "FIXED_STRING(32)")
    c.create("shop", "tag", "customer", [Prop("name", "STRING"), Prop("balance", "DOUBLE", True)])
    c.create("shop", "edge", "placed", [Prop("total", "DOUBLE", default="0.0")])
    c.create_index("shop", "by_name", "customer", [IndexField("name", 20)])
    c.alter("shop", "customer", add=[Prop("segment", "STRING", default="'NONE'")])
    return c


@query("SELECT 1 AS space_id, 'shop' AS name, 6 AS partitions, 1 AS replicas, 'FIXED_STRING(32)' AS vid_type")
def catalog_spaces(spark, d):
    return _catalog().list_spaces(spark)


@query("SELECT * FROM (VALUES (1, 'customer', 1, 'name', 'STRING', false, NULL), (1, 'customer', 1, 'balance', 'DOUBLE', true, NULL), (1, 'customer', 1, 'segment', 'STRING', false, '''NONE''')) t(id, name, version, property, type, nullable, default_expr)")
def catalog_tags(spark, d):
    return _catalog().list_schemas(spark, "shop", "tag")


@query("SELECT 2 AS id, 'placed' AS name, 0 AS version, 'total' AS property, 'DOUBLE' AS type, false AS nullable, '0.0' AS default_expr")
def catalog_edges(spark, d):
    return _catalog().list_schemas(spark, "shop", "edge")


@query("SELECT 3 AS id, 'by_name' AS name, 'customer' AS schema, ['name'] AS fields, 'STARTING' AS status")
def catalog_indexes(spark, d):
    return _catalog().list_indexes(spark, "shop", "tag")


def _staffed() -> Catalog:
    c = _catalog()
    for account in ("ann", "bob", "cem"):
        c.create_user(account, f"secret of {account}")
    c.grant_role("ann", "shop", "ADMIN")
    c.grant_role("bob", "shop", "GUEST")
    c.grant_role("bob", "shop", "USER")
    c.drop_user("cem")
    for k in range(4):
        c.heartbeat(f"host{k}", 100 * k)
    c.add_zone("east", ["host0", "host1"])
    c.add_zone("west", ["host2", "host3"])
    c.add_group("both", ["east", "west"])
    return c


@query("SELECT * FROM (VALUES ('ann', 'shop', 'ADMIN', true, true, false), ('bob', 'shop', 'USER', true, true, false)) t(account, space, role, may_read, right_password, wrong_password)")
def catalog_users(spark, d):
    c = _staffed()
    rows = [(r.account, r.space, r.role, c.may(r.account, "shop", "GUEST"), c.authenticate(r.account, f"secret of {r.account}"), c.authenticate(r.account, "guess")) for r in c.list_roles(spark, "shop").collect()]  # two
    return spark.createDataFrame(rows, "account string, space string, role string, may_read boolean, right_password boolean, wrong_password boolean")


@query("SELECT * FROM (VALUES (1::BIGINT, 'ann', '1', 'scan', 'RUNNING'), (1, 'ann', '2', 'walk', 'KILLING')) t(session, account, query, text, status)")
def catalog_sessions(spark, d):
    c = _staffed()
    one, two = c.create_session("ann", "desk", 100), c.create_session("bob", "phone", 100)
    c.update_session(one, 110, "shop", {"1": "scan", "2": "walk"})
    c.kill_query(one, 2)
    c.remove_session(two)
    return c.list_queries(spark)


@query("SELECT 'east' AS name, ['host0', 'host1'] AS hosts, ['OFFLINE', 'OFFLINE'] AS states UNION ALL SELECT 'west', ['host2', 'host3'], ['ONLINE', 'ONLINE']")
def catalog_zones(spark, d):
    c = _staffed()
    states = c.list_hosts(spark, now=310, alive_for=150)
    rows = c.list_zones(spark).select("name", F.posexplode("hosts").alias("k", "host")).join(F.broadcast(states), "host")  # a row for each host
    lists = rows.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("k", "host", "status"))).alias("x"))
    return lists.select("name", F.col("x.host").alias("hosts"), F.col("x.status").alias("states"))


@query("SELECT CAST(p AS INTEGER) AS part, 'host' || ((p - 1) % 4) AS leader FROM range(1, 7) t(p)")
def catalog_parts(spark, d):
    return _staffed().list_parts(spark, "shop").select("part", "leader")


@query("SELECT * FROM (VALUES ('storage', 'cache', '64', true), ('storage', 'name', '\"fast\"', false)) t(module, name, value, mutable)")
def catalog_settings(spark, d):
    c = _catalog()
    c.register_setting("storage", "cache", 32)
    c.register_setting("storage", "name", "fast", mutable=False)
    c.set_setting("storage", "cache", 64)
    return c.list_settings(spark)


@query("SELECT 'edge' AS kind, 'placed' AS name UNION ALL SELECT 'space', 'shop' UNION ALL SELECT 'listener', 'audit'")
def catalog_drops(spark, d):
    """What is left once an index, its tag, a listener and a second space have been dropped."""
    c = _catalog()
    c.create_space("other")
    for kind in ("fulltext", "audit"):
        c.add_listener("shop", kind, f"/{kind}")
    c.remove_listener("shop", "fulltext")
    c.drop_index("shop", "by_name")
    c.drop("shop", "customer", "tag")
    c.drop_space("other")
    return c.describe(spark).select("kind", "name")


@query("SELECT 'http' AS kind, 'search' AS host, 9200 AS port, CAST(NULL AS VARCHAR) AS user")
def catalog_text_clients(spark, d):
    c = _catalog()
    c.sign_in("http", [{"host": "old", "port": 1}])
    c.sign_out()
    c.sign_in("http", [{"host": "search", "port": 9200}])
    return c.list_clients(spark)


@query("SELECT * FROM (VALUES ('space', 1), ('tag', 1), ('edge', 1), ('tag index', 1), ('user', 2), ('host', 4), ('zone', 2), ('group', 1)) t(kind, n)")
def catalog_dump(spark, d):
    return _staffed().describe(spark).groupBy("kind").agg(F.count(F.lit(1)).cast("int").alias("n"))


# Extensions


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def extension_cube(spark, d):
    return read(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT o_orderkey, o_custkey, k FROM (SELECT o_orderkey, o_custkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS k FROM orders) WHERE k <= 3")
def extension_top_per_vertex(spark, d):
    rows = read(spark, d, "orders").selectExpr("o_orderkey", "o_custkey", "row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k")
    return rows.where("k <= 3")


