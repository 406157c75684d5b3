"""Catalog, store, mutations and the change feed."""

import pytest
from pyspark.sql import functions as F

from graphloom.catalog import Catalog, IndexField, Prop
from graphloom.errors import GraphError
from graphloom.operators import kv, lookup, mutate
from graphloom.operators.lookup import Context, Hint
from graphloom.operators.mutate import Update
from graphloom.sources.files import Files
from graphloom.sources.joblog import JobLog
from graphloom.sources.store import Store
from graphloom.streaming import feed
from graphloom.streaming.listener import Listener
from graphloom.types import PropertyType, coerce


@pytest.fixture
def store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    s.catalog.create_space("g", 3, 1, "FIXED_STRING(16)")
    s.catalog.create("g", "tag", "keeper", [Prop("name", "STRING", default="''"), Prop("age", "INT64"), Prop("prizes", "INT64", True)])
    s.catalog.create("g", "edge", "tends", [Prop("since", "INT64", default="2020")])
    s.commit()
    return s


def keepers(spark, *rows):
    return spark.createDataFrame(rows, "_vid string, name string, age long, _ord long")


def content(df):
    return sorted(tuple(r) for r in df.collect())


def test_last_write_wins_and_if_not_exists(spark, store):
    assert store.insert("g", "keeper", keepers(spark, ("a", "x", 1, 1), ("a", "y", 2, 2), ("b", "z", 3, 3)), ["name", "age"]).count() == 0
    assert content(store.frame("g", "keeper")) == [("a", "y", 2, None), ("b", "z", 3, None)]
    store.insert("g", "keeper", keepers(spark, ("a", "no", 9, 1), ("c", "first", 4, 2), ("c", "second", 5, 3)), ["name", "age"], if_not_exists=True)
    assert content(store.frame("g", "keeper")) == [("a", "y", 2, None), ("b", "z", 3, None), ("c", "first", 4, None)]
    store.delete("g", "keeper", spark.createDataFrame([("b",), ("missing",)], "_vid string"))
    store.compact("g", "keeper")
    assert content(store.frame("g", "keeper")) == [("a", "y", 2, None), ("c", "first", 4, None)]
    assert store.vacuum() == 3


def test_a_bad_row_fails_its_partition(spark, store):
    rows = spark.createDataFrame([("a", None), ("b", 1), ("c", 2), ("d", 3), ("a-very-long-vertex-id", 4)], "_vid string, age long")
    failed = store.insert("g", "keeper", rows, ["age"])
    bad = {r.part: r.error for r in failed.collect()}
    assert set(bad.values()) <= {"NOT_NULLABLE", "INVALID_VID"} and bad
    kept = store.frame("g", "keeper").select(F.pmod(F.xxhash64("_vid"), F.lit(3)) + 1).distinct().collect()
    assert not {r[0] for r in kept} & set(bad)


def test_missing_values(spark, store):
    ready = mutate.resolved(spark.createDataFrame([("a", "n")], "_vid string, name string"), ["_vid"], store.catalog.schema("g", "keeper").latest, ["name"])
    assert ready.first()["_error"] == "FIELD_UNSET"
    with pytest.raises(GraphError):
        mutate.resolved(keepers(spark, ("a", "x", 1, 1)), ["_vid"], store.catalog.schema("g", "keeper").latest, ["name", "height"])


def test_schema_versions(spark, store):
    store.insert("g", "keeper", keepers(spark, ("a", "x", 1, 1)), ["name", "age"])
    store.catalog.alter("g", "keeper", add=[Prop("region", "STRING", default="'Somewhere'")], change=[Prop("age", "STRING", True)], drop=["prizes"])
    store.commit()
    rows = spark.createDataFrame([("b", "y", "old", "Elsewhere")], "_vid string, name string, age string, region string")
    store.insert("g", "keeper", rows)
    assert content(store.frame("g", "keeper")) == [("a", "x", "1", "Somewhere"), ("b", "y", "old", "Elsewhere")]
    assert Store(spark, store.root).frame("g", "keeper").count() == 2


def test_update(spark, store):
    store.insert("g", "keeper", keepers(spark, ("a", "x", 1, 1), ("b", "y", 2, 2)), ["name", "age"])
    targets = spark.createDataFrame([("a",), ("b",), ("c",)], "_vid string")
    u = Update((("age", "age + 1"), ("prizes", "age * 10")), "age > 1", returns=("age", "prizes"))
    assert content(store.update("g", "keeper", targets, u)) == [("a", False, "FILTER_OUT", 1, None), ("b", False, "SUCCEEDED", 3, 30), ("c", False, "KEY_NOT_FOUND", None, None)]
    with pytest.raises(GraphError):
        store.update("g", "keeper", targets, Update((("name", "'n'"),), insertable=True))
    u = Update((("age", "7"), ("name", "'new'")), "age > 100", insertable=True, returns=("age",))
    assert content(store.update("g", "keeper", targets, u)) == [("a", False, "FILTER_OUT", 1), ("b", False, "FILTER_OUT", 3), ("c", True, "SUCCEEDED", 7)]
    assert content(store.frame("g", "keeper")) == [("a", "x", 1, None), ("b", "y", 3, 30), ("c", "new", 7, None)]


def test_edges_and_vertices(spark, store):
    edges = spark.createDataFrame([("a", 1, "t"), ("a", 2, "t"), ("b", 1, "a")], "_src string, _rank long, _dst string")
    store.insert("g", "tends", edges, [])
    store.insert("g", "keeper", keepers(spark, ("a", "x", 1, 1)), ["name", "age"])
    gone = spark.createDataFrame([("a",)], "_vid string")
    store.delete_vertices("g", gone)
    assert store.frame("g", "keeper").count() == 0 and store.frame("g", "tends").count() == 3
    store.delete_vertices("g", gone, cascade=True)
    assert store.frame("g", "tends").count() == 0


def test_writers_conflict(spark, store):
    other = Store(spark, store.root)
    store.catalog.create("g", "tag", "garden", [])
    store.commit()
    with pytest.raises(GraphError, match="DATA_CONFLICT"):
        other.insert("g", "keeper", keepers(spark, ("a", "x", 1, 1)), ["name", "age"])
    other.insert("g", "keeper", keepers(spark, ("a", "x", 1, 1)), ["name", "age"])
    assert "garden" in other.catalog.space("g").schemas


def test_index_snapshot_backup(spark, store, tmp_path):
    store.insert("g", "keeper", keepers(spark, ("a", "x", 1, 1), ("b", "y", 2, 2)), ["name", "age"])
    store.catalog.create_index("g", "by_age", "keeper", [IndexField("age")])
    assert content(store.rebuild_index("g", "by_age")) == [("a", 1), ("b", 2)]
    g = store.graph("g")
    hit = lookup.lookup(g, "keeper", [Context((Hint("age", begin=2, range=True),))], ["_vid"], store.view("g", "by_age"))
    assert hit.collect() == [("b",)] and all("/indexes/" in f for f in hit.inputFiles())
    store.snapshot("before")
    store.delete("g", "keeper", spark.createDataFrame([("a",)], "_vid string"))
    store.backup(str(tmp_path / "copy"))
    assert Store(spark, str(tmp_path / "copy")).frame("g", "keeper").count() == 1
    store.compact("g", "keeper")
    store.vacuum()
    store.restore("before")
    assert store.snapshots() == ["before"] and store.frame("g", "keeper").count() == 2


def test_index_follows_writes(spark, store):
    """A built index shows what was inserted, updated and deleted since, by its own rows."""
    store.insert("g", "keeper", keepers(spark, ("a", "x", 1, 1), ("b", "y", 2, 2)), ["name", "age"])
    store.catalog.create_index("g", "by_age", "keeper", [IndexField("age")])
    assert store.catalog.index("g", "by_age").status == "STARTING" and store.view("g", "by_age").frame is None
    store.rebuild_index("g", "by_age")
    assert store.catalog.index("g", "by_age").status == "FINISHED"

    def found(low):
        rows = store.lookup("g", "by_age", [Context((Hint("age", begin=low, range=True),))], ["_vid", "age"])
        assert any("/indexes/" in f for f in rows.inputFiles())
        return content(rows)

    store.insert("g", "keeper", keepers(spark, ("c", "z", 5, 1)), ["name", "age"])
    assert found(2) == [("b", 2), ("c", 5)]
    store.update("g", "keeper", spark.createDataFrame([("b",)], "_vid string"), Update((("age", "age - 2"),)))
    assert found(0) == [("a", 1), ("b", 0), ("c", 5)] and found(2) == [("c", 5)]
    store.delete("g", "keeper", spark.createDataFrame([("c",)], "_vid string"))
    assert found(2) == []
    store.insert("g", "keeper", keepers(spark, ("c", "back", 7, 1)), ["name", "age"])
    store.compact("g", "keeper")
    assert found(0) == [("a", 1), ("b", 0), ("c", 7)] and [len(t) for k, t in store.tables.items() if k.startswith("index/")] == [1]
    plan = store.lookup("g", "by_age", [Context((Hint("age", 7),))], ["_vid"])._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(age,7)" in plan
    number = store.catalog.index("g", "by_age").id
    store.catalog.drop_index("g", "by_age")
    store.commit()
    assert store.files.names(f"{store.root}/indexes/1/{number}") and store.vacuum()
    assert not store.files.names(f"{store.root}/indexes/1/{number}")


def test_writes_during_a_rebuild_are_replayed(spark, store, monkeypatch):
    store.insert("g", "keeper", keepers(spark, ("a", "x", 1, 1)), ["name", "age"])
    store.catalog.create_index("g", "by_age", "keeper", [IndexField("age")])
    store.commit()
    other, plain, states = Store(spark, store.root), Store._index_rows, []

    def meanwhile(self, rows, schema, index):
        if self is store and not states:
            other.refresh()
            states.append(other.catalog.index("g", "by_age").status)
            other.insert("g", "keeper", keepers(spark, ("b", "y", 2, 1)), ["name", "age"])
            other.delete("g", "keeper", spark.createDataFrame([("a",)], "_vid string"))
        return plain(self, rows, schema, index)

    monkeypatch.setattr(Store, "_index_rows", meanwhile)
    assert content(store.rebuild_index("g", "by_age")) == [("b", 2)] and states == ["BUILDING"]
    states.clear()
    compacted = []

    def compaction(self, rows, schema, index):
        if self is store and not compacted:
            compacted.append(1)
            other.refresh()
            other.compact("g", "keeper")
        return plain(self, rows, schema, index)

    monkeypatch.setattr(Store, "_index_rows", compaction)
    assert content(store.rebuild_index("g", "by_age")) == [("b", 2)]
    assert Store(spark, store.root).view("g", "by_age").frame.count() == 1


def test_edge_index_and_batches(spark, store):
    edges = spark.createDataFrame([("a", 1, "t", 2001), ("a", 2, "t", 2005)], "_src string, _rank long, _dst string, since long")
    store.insert("g", "tends", edges, ["since"])
    store.catalog.create_index("g", "by_since", "tends", [IndexField("since")])
    store.commit()
    log = JobLog(store)
    job = log.add("g", "REBUILD_EDGE_INDEX")
    assert log.run() == 1 and log.show(job).first().status == "FINISHED"
    assert content(log.index_status("g", "edge")) == [("by_since", "FINISHED")]
    before = store.number
    with store.batch():
        store.insert("g", "tends", edges.selectExpr("_src", "_rank + 10 AS _rank", "_dst", "since + 10 AS since"), ["since"])
        store.delete("g", "tends", edges.where("since = 2001"))
    assert store.number == before + 1
    hits = store.lookup("g", "by_since", [Context((Hint("since", begin=2005, range=True),))], ["_rank", "since"])
    assert content(hits) == [(2, 2005), (11, 2011), (12, 2015)]
    with pytest.raises(ZeroDivisionError), store.batch():
        store.delete("g", "tends", edges)
        1 / 0  # noqa: B018
    assert store.frame("g", "tends").count() == 3 and store.number == before + 1


def test_one_of_two_writers_wins(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    files = Files(spark)
    for k in range(20):
        with ThreadPoolExecutor(4) as pool:
            won = list(pool.map(lambda n, k=k: files.create(f"{tmp_path}/m/{k}.json", f"writer {n}"), range(4)))
        assert sum(won) == 1 and files.read(f"{tmp_path}/m/{k}.json") == f"writer {won.index(True)}"
    assert len(files.names(f"{tmp_path}/m")) == 20


def test_atomic_changes_are_tried_again(spark, store):
    """Compare and set: the value is read and written on one state, whatever others write."""
    other = Store(spark, store.root)
    store.catalog.register_setting("app", "n", 0)
    store.commit()
    calls = []

    def grow(s):
        n = s.catalog.get_setting("app", "n")
        if not calls:
            other.refresh()
            other.catalog.set_setting("app", "n", 10)
            other.commit()
        calls.append(n)
        s.catalog.set_setting("app", "n", n + 1)
        return n + 1

    assert store.atomic(grow) == 11 and calls == [0, 10]


def test_listener_and_fulltext_rebuild(spark, store, tmp_path):
    store.catalog.create_fulltext("g", "text", "keeper", ["name"])
    with pytest.raises(GraphError, match="NOT_FOUND"):
        Listener(store, "g")
    store.catalog.add_listener("g", "fulltext", str(tmp_path / "text"))
    store.commit()
    follow = Listener(store, "g")
    assert content(follow.tokens("keeper")) == []
    store.insert("g", "keeper", keepers(spark, ("a", "old words", 1, 1), ("b", "b text", 2, 2)), ["name", "age"])
    assert follow.catch_up() == 1 and follow.catch_up() == 0
    store.insert("g", "keeper", keepers(spark, ("a", "New words, new", 1, 1)), ["name", "age"])
    store.delete("g", "keeper", spark.createDataFrame([("b",)], "_vid string"))
    assert follow.catch_up() == 2
    tokens = [('{"_vid":"a"}', "name", "new"), ('{"_vid":"a"}', "name", "words")]
    assert content(follow.tokens("keeper")) == tokens
    store.compact("g", "keeper")
    assert follow.catch_up() == 0 and content(follow.tokens("keeper")) == tokens
    log = JobLog(store)
    log.add("g", "REBUILD_FULLTEXT_INDEX")
    assert log.run() == 1 and content(Listener(store, "g").tokens("keeper")) == tokens


def test_dump(spark, store):
    store.insert("g", "keeper", keepers(spark, *((f"v{k}", "n", k, k) for k in range(20))), ["name", "age"])
    parts = [store.dump("g", "keeper", parts=[p]).count() for p in (1, 2, 3)]
    assert sum(parts) == 20 and all(parts) and store.dump("g", "keeper", vids=["v1", "v2"]).count() == 2 and store.dump("g", "keeper", limit=7).count() == 7
    assert content(store.dump_stats("g", parts=[1])) == [("edge", "tends", 0), ("tag", "keeper", parts[0])]


def test_ttl_on_compaction(spark, store):
    store.catalog.create("g", "tag", "seen", [Prop("at", "TIMESTAMP", True)], "at", 10)
    store.insert("g", "seen", spark.createDataFrame([("a", 100), ("b", 200), ("c", None)], "_vid string, at long"))
    assert {r["_vid"] for r in store.graph("g", now=205).tag("seen").rows().collect()} == {"b", "c"}
    store.compact("g", "seen", now=205)
    assert store.frame("g", "seen").count() == 2


def test_catalog_rules():
    c = Catalog()
    c.create_space("g", vid="INT64")
    c.create("g", "tag", "t", [Prop("a", "INT64"), Prop("s", "STRING"), Prop("f", "FIXED_STRING(4)", True)])
    bad = [
        lambda: c.create_space("g"),
        lambda: c.create_space("h", vid="DOUBLE"),
        lambda: c.create_space("h", partitions=0),
        lambda: c.create("g", "edge", "t", []),
        lambda: c.create("g", "tag", "u", [Prop("a", "INT64"), Prop("a", "BOOL")]),
        lambda: c.create("g", "tag", "u", [Prop("a", "DECIMAL")]),
        lambda: c.create("g", "tag", "u", [Prop("a", "STRING")], "a", 5),
        lambda: c.create_index("g", "i", "t", [IndexField("s")]),
        lambda: c.create_index("g", "i", "t", [IndexField("a", 3)]),
        lambda: c.create_index("g", "i", "t", [IndexField("a"), IndexField("a")]),
        lambda: c.create_index("g", "i", "t", [IndexField("nothing")]),
        lambda: c.schema("g", "nothing"),
    ]
    for f in bad:
        with pytest.raises(GraphError):
            f()
    c.create_index("g", "i", "t", [IndexField("a"), IndexField("s", 8)])
    for f in (lambda: c.alter("g", "t", drop=["a"]), lambda: c.alter("g", "t", change=[Prop("a", "INT8")]), lambda: c.alter("g", "t", ttl_col="a", ttl_duration=3), lambda: c.drop("g", "t", "tag"), lambda: c.alter("g", "t", add=[Prop("a", "BOOL")])):
        with pytest.raises(GraphError):
            f()
    c.drop_index("g", "i")
    c.alter("g", "t", ttl_col="a", ttl_duration=3)
    c.alter("g", "t", drop=["a"])
    assert c.schema("g", "t").ttl is None and len(c.schema("g", "t").versions) == 3
    c.add_listener("g", "fulltext", "memory")
    c.register_setting("storage", "limit", 10)
    c.set_setting("storage", "limit", 20)
    assert c.get_setting("storage", "limit") == 20
    assert Catalog.from_json(c.to_json()).to_json() == c.to_json()


@pytest.mark.parametrize(
    ("sql", "target", "value", "error"),
    [
        ("true", "INT8", 1, None),
        ("true", "DOUBLE", None, "TYPE_MISMATCH"),
        ("300", "INT8", None, "OUT_OF_RANGE"),
        ("3.9D", "INT32", 3, None),
        ("5L", "BOOL", True, None),
        ("-1L", "TIMESTAMP", -1, "INCORRECT_VALUE"),
        ("'grün'", "FIXED_STRING(3)", "gr", None),
        ("'1'", "INT64", None, "TYPE_MISMATCH"),
        ("1e300D", "FLOAT", None, "OUT_OF_RANGE"),
        ("DATE'2020-02-20'", "DATETIME", __import__("datetime").datetime(2020, 2, 20), None),
        ("TIMESTAMP_NTZ'2020-02-20 10:00:00'", "DATE", __import__("datetime").date(2020, 2, 20), None),
        ("DATE'2020-02-20'", "TIME", None, "TYPE_MISMATCH"),
        ("INTERVAL '10:20:30' HOUR TO SECOND", "TIME", __import__("datetime").timedelta(hours=10, minutes=20, seconds=30), None),
    ],
)
def test_coercion(spark, sql, target, value, error):
    df = spark.sql(f"SELECT {sql} AS v")
    got, code = coerce(F.col("v"), df.schema["v"].dataType, PropertyType.parse(target))
    r = df.select(got.alias("value"), code.cast("string").alias("error")).first()
    assert r.error == error and (error == "OUT_OF_RANGE" or r.value == value)


def test_missing_key_raises(spark):
    pairs = spark.createDataFrame([("a", "1")], "key string, value string")
    keys = spark.createDataFrame([("a",), ("b",)], "key string")
    assert kv.get(pairs, keys, return_partly=True).collect() == [("a", "1")]
    with pytest.raises(Exception, match="KEY_NOT_FOUND"):
        kv.get(pairs, keys).collect()


def test_change_feed(spark, tmp_path):
    log, sink, checkpoint = (str(tmp_path / x) for x in ("log", "sink", "checkpoint"))
    rows = spark.createDataFrame([("a", "old words"), ("b", "b text")], "_vid string, name string")
    feed.append(log, feed.changes(rows, ["_vid"], "t", "put", 0))
    feed.replicate(feed.follow(spark, log), feed.parquet_sink(sink), checkpoint).awaitTermination()
    feed.append(log, feed.changes(rows.where("_vid = 'a'").withColumn("name", F.lit("New words, new")), ["_vid"], "t", "put", 1 << 40))
    feed.append(log, feed.changes(rows.where("_vid = 'b'").select("_vid"), ["_vid"], "t", "delete", 1 << 41))
    feed.replicate(feed.follow(spark, log), feed.parquet_sink(sink), checkpoint).awaitTermination()
    now = feed.state(spark, sink)
    assert [r.row for r in now.collect()] == ['{"_vid":"a","name":"New words, new"}']
    entries = now.withColumn("op", F.lit("put"))
    assert sorted(r.token for r in feed.tokens(entries, ["name"]).collect()) == ["new", "words"]


def test_job_queue(spark, store):
    store.insert("g", "keeper", keepers(spark, ("a", "x", 1, 1), ("b", "y", 2, 2)), ["name", "age"])
    store.catalog.create_index("g", "by_name", "keeper", [IndexField("name", 8)])
    store.commit()
    log = JobLog(store)
    with pytest.raises(GraphError, match="STATS_NOT_FOUND"):
        log.statistics("g")
    stats = log.add("g", "STATS")
    assert log.add("g", "STATS") == stats
    rebuild, wrong, halted = log.add("g", "REBUILD_TAG_INDEX"), log.add("g", "REBUILD_EDGE_INDEX", "by_name"), log.add("g", "COMPACT")
    log.stop(halted)
    assert log._set(stats, "RUNNING", ("QUEUE",))  # a runner that was lost
    assert JobLog(Store(spark, store.root)).recover() == 3
    assert log.run() == 2
    assert {r.id: r.status for r in log.show().collect()} == {stats: "FINISHED", rebuild: "FINISHED", wrong: "FAILED", halted: "STOPPED"}
    assert "INVALID_PARM" in log.show(wrong).first().error
    assert content(log.statistics("g")) == [("edge", "tends", 0), ("space", "edges", 0), ("space", "vertices", 2), ("tag", "keeper", 2)]
    assert store.view("g", "by_name").frame.count() == 2
    for bad in (lambda: log.stop(halted), lambda: log.add("g", "DANCE"), lambda: log.show(99)):
        with pytest.raises(GraphError):
            bad()
