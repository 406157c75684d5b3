"""Spaces on disk: tables as segments of Parquet, and a manifest that names them.

A write adds a segment (rows put, or keys deleted) and commits a new manifest by creating a file that must not exist
yet; a writer that finds it there lost the race and gets DATA_CONFLICT. A read merges segments by key, the later one
winning; `compact` rewrites a table as one segment, which is read without a merge. So a write costs what it writes,
whatever the table's size, and readers keep the manifest they began with.

Rows keep the schema version they were written under. A property that changed its type has a column for each type; on
reading, a property unknown to the row's version takes the current default.

An index is kept as segments too: once it has been built, every write adds to it what it changes, in the same commit.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce
from typing import TypeVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, IntegerType, LongType, StructField, StructType

from graphloom.catalog import Catalog, Index, Prop, Schema, Space
from graphloom.errors import GraphError
from graphloom.graph import KEYS, Graph, Table, alive
from graphloom.operators import lookup, mutate
from graphloom.operators.scan import part_of
from graphloom.sources.files import Files, materialize
from graphloom.types import vid_type

T = TypeVar("T")
VERSION, SEQUENCE, GONE = "_ver", "_seq", "_gone"


def _column(p: Prop) -> str:
    """The physical column of a property of one type."""
    return f"{p.name}__{str(p.parsed).lower().replace('(', '_').replace(')', '')}"


def keys_of(schema: Schema) -> list[str]:
    return ["_vid"] if schema.kind == "tag" else list(KEYS)


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark)
        self.catalog, self.tables, self.number, self._open = Catalog(), {}, 0, False
        self.refresh()

    # Manifests

    def _manifest(self, n: int) -> str:
        return f"{self.root}/manifests/{n:010d}.json"

    def refresh(self) -> None:
        """Reads the newest manifest."""
        names = [n for n in self.files.names(f"{self.root}/manifests") if n.endswith(".json")]
        if names:
            raw = json.loads(self.files.read(f"{self.root}/manifests/{names[-1]}"))
            self.catalog, self.tables, self.number = Catalog.from_json(raw["catalog"]), raw["tables"], int(names[-1][:10])

    def commit(self) -> None:
        """Publishes the catalog and the tables as they are here."""
        text = json.dumps({"catalog": self.catalog.to_json(), "tables": self.tables})
        if not self.files.create(self._manifest(self.number + 1), text):
            self.refresh()
            raise GraphError("DATA_CONFLICT", "another writer was first; the newest state has been read")
        self.number += 1

    @contextmanager
    def batch(self) -> Iterator[Store]:
        """Everything written inside becomes visible in one commit, or nothing does."""
        if self._open:  # part of a batch already
            yield self
            return
        before, self._open = (self.catalog.to_json(), dict(self.tables)), True
        try:
            yield self
        except BaseException:
            self.catalog, self.tables = Catalog.from_json(before[0]), before[1]
            raise
        finally:
            self._open = False
        self.commit()

    def atomic(self, change: Callable[[Store], T], tries: int = 20) -> T:
        """change(store), computed from the newest state and published only if that state is still the newest; else tried again."""
        for _ in range(tries):
            self.refresh()
            try:
                with self.batch():
                    return change(self)
            except GraphError as e:
                if e.code != "DATA_CONFLICT":
                    raise
        raise GraphError("DATA_CONFLICT", f"other writers were first {tries} times")

    def info(self) -> dict:
        """Where the store lies, its newest manifest, its size in segments, and the cluster that reads it."""
        context = self.spark.sparkContext
        return {"root": self.root, "manifest": self.number, "segments": sum(len(t) for t in self.tables.values()), "snapshots": self.snapshots(), "master": context.master, "application": context.applicationId, "spark": context.version}

    # Segments

    def _table(self, space: Space, schema: Schema) -> list[dict]:
        return self.tables.setdefault(f"{space.id}/{schema.id}", [])

    def _write(self, space: Space, schema: Schema, rows: DataFrame, gone: bool = False, replace: bool = False) -> None:
        """Adds a segment, and to every index that has been built what the segment changes in it, in one commit."""
        if not space.writable:
            raise GraphError("WRITE_STALLED", space.name)
        table = self._table(space, schema)
        path = f"{self.root}/data/{space.id}/{schema.id}/{uuid.uuid4().hex}"
        rows.sortWithinPartitions(*keys_of(schema)).write.parquet(path)
        last = max((s["seq"] for s in table), default=0)
        entry = {"path": path, "seq": last + 1, "gone": gone, "versions": len(schema.versions)}
        with self.batch():
            self.tables[f"{space.id}/{schema.id}"] = [{**entry, "upto": last}] if replace else [*table, entry]
            for index in self.catalog.indexes_of(space.name, schema.name):
                kept = self.tables.get(key := f"index/{space.id}/{index.id}")
                if kept is not None:
                    self.tables[key] = [self._indexed(space, schema, index, entry)] if replace else [*kept, self._indexed(space, schema, index, entry)]

    def _newest(self, segments: list[dict], keys: list[str], columns: dict[str, DataType], space: Space) -> DataFrame:
        """The newest row of each key.

        The first segment, by far the largest once a table has been compacted, is only cleared of the keys of later ones,
        so filters on it reach its scan; the later ones are merged by key.
        """
        kinds = {k: LongType() if k == "_rank" else vid_type(space.vid).stored for k in keys}
        if not segments:
            return self.spark.createDataFrame([], StructType([StructField(n, t) for n, t in {**kinds, **columns}.items()]))
        whole = StructType([StructField(n, t) for n, t in {**kinds, **columns}.items()])
        read = lambda s: self.spark.read.schema(whole).parquet(s["path"])  # noqa: E731  what a segment lacks is null
        first, later = segments[0], segments[1:]
        base = read(first) if not first["gone"] else read(first).limit(0)
        if not later:
            return base
        rows = reduce(lambda a, b: a.unionByName(b), [read(s).withColumns({SEQUENCE: F.lit(s["seq"]), GONE: F.lit(s["gone"])}) for s in later])
        newest = rows.groupBy(*keys).agg(F.max_by(F.struct(GONE, *columns), SEQUENCE).alias("_row"))
        new = newest.where(f"NOT _row.{GONE}").select(*keys, *[F.col(f"_row.`{c}`").alias(c) for c in columns])
        return base.join(newest.select(*keys), keys, "left_anti").unionByName(new)

    def _physical(self, schema: Schema, rows: DataFrame) -> DataFrame:
        """Logical rows of the current version as columns on disk."""
        last = schema.latest
        return rows.select(*keys_of(schema), F.lit(len(schema.versions) - 1).alias(VERSION), *[F.col(p.name).cast(p.parsed.stored).alias(_column(p)) for p in last.props])

    def _columns(self, schema: Schema) -> dict[str, DataType]:
        return {VERSION: IntegerType(), **{_column(p): p.parsed.stored for v in schema.versions for p in v.props}}

    def _merged(self, space: Space, schema: Schema) -> DataFrame:
        """The newest row of each key, as on disk."""
        return self._newest(self._table(space, schema), keys_of(schema), self._columns(schema), space)

    def _value(self, schema: Schema, p: Prop) -> Column:
        """A property of the current version, from the column of the row's version."""
        by: dict[str, list[int]] = {}
        for n, v in enumerate(schema.versions):
            if (was := v.prop(p.name)) is not None:
                by.setdefault(_column(was), []).append(n)
        default = F.expr(p.default).cast(p.parsed.stored) if p.default is not None else F.lit(None).cast(p.parsed.stored)
        if p.default is None and not p.nullable:
            default = F.raise_error(F.lit(f"{schema.name}.{p.name} has neither a value nor a default")).cast(p.parsed.stored)
        if sum(map(len, by.values())) == len(schema.versions) and len(by) == 1:
            return F.col(_column(p))
        out = default
        for column, versions in by.items():
            value = F.col(column) if column == _column(p) else F.col(column).try_cast(p.parsed.stored)
            out = F.when(F.col(VERSION).isin(versions), value).otherwise(out)
        return out

    def frame(self, space: str, name: str) -> DataFrame:
        """A tag's or edge type's rows under its current schema, expired ones included; integers surface as 64-bit, floats as doubles."""
        s, schema = self.catalog.space(space), self.catalog.schema(space, name)
        cols = [self._value(schema, p).cast(p.parsed.surfaced).alias(p.name) for p in schema.latest.props]
        return self._merged(s, schema).select(*keys_of(schema), *cols)

    def graph(self, space: str, now: int | None = None, names: list[str] | None = None) -> Graph:
        """The space's tables, or some of them."""
        made: dict[str, dict[str, Table]] = {"tag": {}, "edge": {}}
        for schema in sorted((x for x in self.catalog.space(space).schemas.values() if names is None or x.name in names), key=lambda x: x.id):
            made[schema.kind][schema.name] = Table(schema.name, self.frame(space, schema.name), schema.id, schema.ttl, now)
        return Graph(made["tag"], made["edge"])

    # Writes

    def insert(self, space: str, name: str, rows: DataFrame, names: list[str] | None = None, if_not_exists: bool = False, unique: bool = False) -> DataFrame:
        """Adds vertices' tag rows or edges; returns (part, error) of partitions that were refused.

        The last row of a key overwrites; with if_not_exists the first of the request is kept, and only where the key is absent.
        unique: the rows are made such that no two have the same key, so they are neither shuffled nor sorted to find the last.
        """
        s, schema = self.catalog.space(space), self.catalog.schema(space, name)
        keys = keys_of(schema)
        rows = rows if unique else mutate.numbered(rows)
        ready = mutate.vid_errors(mutate.resolved(rows, keys, schema.latest, names), keys, vid_type(s.vid))
        good, failed = mutate.accepted(ready, keys, s.partitions)
        new = good if unique else mutate.one_of(good, keys, last=not if_not_exists)
        if if_not_exists:
            new = new.join(self._merged(s, schema).select(*keys), keys, "left_anti")
        self._write(s, schema, self._physical(schema, new))
        return failed

    def delete(self, space: str, name: str, keys: DataFrame) -> None:
        """Deletes tag rows or edges by key; missing keys are ignored."""
        s, schema = self.catalog.space(space), self.catalog.schema(space, name)
        self._write(s, schema, keys.select(*keys_of(schema)).distinct(), gone=True)

    def delete_vertices(self, space: str, vids: DataFrame, cascade: bool = False) -> None:
        """Deletes all tags of the vertices, in one commit. Their edges stay unless cascade is set."""
        with self.batch():
            for schema in list(self.catalog.space(space).schemas.values()):
                if schema.kind == "tag":
                    self.delete(space, schema.name, vids)
                elif cascade:
                    ids = vids.select("_vid").distinct()
                    edges = self._merged(self.catalog.space(space), schema).select(*KEYS)
                    gone = [edges.join(ids.withColumnRenamed("_vid", end), end, "left_semi").select(*KEYS) for end in ("_src", "_dst")]
                    self.delete(space, schema.name, gone[0].union(gone[1]))

    def delete_tags(self, space: str, vids: DataFrame, names: list[str]) -> None:
        """Deletes some tags of the vertices, in one commit."""
        with self.batch():
            for name in names:
                self.delete(space, name, vids)

    def update(self, space: str, name: str, targets: DataFrame, u: mutate.Update, now: int | None = None) -> DataFrame:
        """Applies SET items to the target keys; see mutate.update for the result."""
        s, schema = self.catalog.space(space), self.catalog.schema(space, name)
        keys = keys_of(schema)
        base = self._merged(s, schema).select(*keys, *[self._value(schema, p).alias(p.name) for p in schema.latest.props])
        shown = tuple(p.name for p in schema.latest.props)
        full = mutate.Update(u.sets, u.condition, u.insertable, shown)
        _, result = mutate.update(base, targets, keys, full, schema, alive(schema.ttl, now))
        result = materialize(result, "update")
        self._write(s, schema, self._physical(schema, result.where("_status = 'SUCCEEDED'")))
        return result.select(*keys, "_inserted", "_status", *u.returns)

    # Jobs

    def compact(self, space: str, name: str, now: int | None = None) -> None:
        """Rewrites a table as one segment of the current version, without deleted and expired rows."""
        s, schema = self.catalog.space(space), self.catalog.schema(space, name)
        rows = self._merged(s, schema).select(*keys_of(schema), *[self._value(schema, p).alias(p.name) for p in schema.latest.props])
        live = alive(schema.ttl, now)
        self._write(s, schema, self._physical(schema, rows if live is None else rows.where(live)), replace=True)

    def prune(self) -> int:
        """Forgets the tables of spaces, tags, edge types and indexes that have been dropped; returns how many."""

        def forget(store: Store) -> int:
            live = {f"{s.id}/{x.id}" for s in store.catalog.spaces.values() for x in s.schemas.values()}
            live |= {f"index/{s.id}/{x.id}" for s in store.catalog.spaces.values() for x in s.indexes.values()}
            lost = [k for k in store.tables if k not in live]
            for k in lost:
                del store.tables[k]
            return len(lost)

        return self.atomic(forget)

    def vacuum(self) -> int:
        """Deletes folders that neither the newest manifest nor a snapshot names; returns how many. For when no older reader is left."""
        self.prune()
        named = [self.tables, *(json.loads(self.files.read(f"{self.root}/snapshots/{n}.json"))["tables"] for n in self.snapshots())]
        used = {seg["path"] for tables in named for table in tables.values() for seg in table}
        dropped = 0
        for kind in ("data", "indexes"):
            for space in self.files.names(f"{self.root}/{kind}"):
                for table in self.files.names(f"{self.root}/{kind}/{space}"):
                    for folder in self.files.names(f"{self.root}/{kind}/{space}/{table}"):
                        if (path := f"{self.root}/{kind}/{space}/{table}/{folder}") not in used:
                            self.files.delete(path)
                            dropped += 1
        return dropped

    # Indexes

    def _index_columns(self, schema: Schema, index: Index) -> dict[str, DataType]:
        """The fields of an index, and the TTL column, by which lookups leave out what has expired."""
        names = [f.name for f in index.fields]
        names += [schema.ttl[0]] if schema.ttl and schema.ttl[0] not in names else []
        return {n: schema.latest.prop(n).parsed.surfaced for n in names}

    def _index_rows(self, rows: DataFrame, schema: Schema, index: Index) -> DataFrame:
        """Rows as on disk as what the index keeps of them, in the order of its fields, nulls last."""
        columns = self._index_columns(schema, index)
        out = rows.select(*keys_of(schema), *[self._value(schema, schema.latest.prop(n)).cast(t).alias(n) for n, t in columns.items()])
        return out.sortWithinPartitions(*[F.asc_nulls_last(f.name) for f in index.fields], *keys_of(schema))

    def _indexed(self, space: Space, schema: Schema, index: Index, segment: dict) -> dict:
        """The index's segment for a segment of the table. Deleted keys need no rows of their own."""
        if segment["gone"]:
            return dict(segment)
        path = f"{self.root}/indexes/{space.id}/{index.id}/{uuid.uuid4().hex}"
        self._index_rows(self._newest([segment], keys_of(schema), self._columns(schema), space), schema, index).write.parquet(path)
        return {**segment, "path": path}

    def _state(self, space: str, index: str, status: str) -> None:
        def change(store: Store) -> None:
            store.catalog.index(space, index).status = status

        try:
            with self.batch():
                change(self)
        except GraphError as e:
            if e.code != "DATA_CONFLICT":
                raise
            self.atomic(change)

    def rebuild_index(self, space: str, index: str, now: int | None = None) -> DataFrame:
        """Writes an index anew from its table, without expired rows, and returns it.

        The index is BUILDING meanwhile. Segments that other writers commit while the table is read are replayed before
        it is FINISHED; if the table was compacted meanwhile, the build begins again.
        """
        self._state(space, index, "BUILDING")
        try:
            while not self._built(space, index, now):
                pass
        except BaseException:
            self._state(space, index, "STARTING")
            raise
        return self.view(space, index).frame

    def _built(self, space: str, index: str, now: int | None) -> bool:
        s, found = self.catalog.space(space), self.catalog.index(space, index)
        schema = self.catalog.schema(space, found.schema)
        read = list(self._table(s, schema))
        rows, live = self._merged(s, schema), alive(schema.ttl, now)
        path = f"{self.root}/indexes/{s.id}/{found.id}/{uuid.uuid4().hex}"
        kept = self._index_rows(rows, schema, found)
        (kept if live is None else kept.where(live)).write.parquet(path)
        whole = {"path": path, "seq": max((x["seq"] for x in read), default=0), "gone": False, "versions": len(schema.versions)}
        replayed: dict[int, dict] = {}
        while True:
            self.refresh()
            s, found = self.catalog.space(space), self.catalog.index(space, index)
            schema = self.catalog.schema(space, found.schema)
            table = self._table(s, schema)
            if table[: len(read)] != read:
                return False
            for x in table[len(read) :]:
                if x["seq"] not in replayed:
                    replayed[x["seq"]] = self._indexed(s, schema, found, x)
            self.tables[f"index/{s.id}/{found.id}"] = [whole, *(replayed[x["seq"]] for x in table[len(read) :])]
            found.status = "FINISHED"
            try:
                self.commit()
                return True
            except GraphError as e:
                if e.code != "DATA_CONFLICT":
                    raise

    def view(self, space: str, index: str) -> lookup.View:
        """The index for a lookup; its kept rows if it has been built and has all that was written to the table."""
        s, found = self.catalog.space(space), self.catalog.index(space, index)
        schema, fields = self.catalog.schema(space, found.schema), tuple(f.name for f in found.fields)
        kept = self.tables.get(f"index/{s.id}/{found.id}")
        newest = max((x["seq"] for x in self._table(s, schema)), default=0)
        if found.status != "FINISHED" or not kept or kept[-1]["seq"] != newest:
            return lookup.View(fields)
        return lookup.View(fields, self._newest(kept, keys_of(schema), self._index_columns(schema, found), s))

    def lookup(self, space: str, index: str, contexts: list[lookup.Context], returns: list[str], now: int | None = None) -> DataFrame:
        """A lookup through an index, on the newest rows."""
        found = self.catalog.index(space, index)
        return lookup.lookup(self.graph(space, now, [found.schema]), found.schema, contexts, returns, self.view(space, index))

    # Snapshots and copies

    def snapshot(self, name: str) -> None:
        """Names the current state. Segments are never changed, so a copy of the manifest is enough."""
        text = json.dumps({"catalog": self.catalog.to_json(), "tables": self.tables})
        if not self.files.create(f"{self.root}/snapshots/{name}.json", text):
            raise GraphError("EXISTED", name)

    def snapshots(self) -> list[str]:
        return [n.removesuffix(".json") for n in self.files.names(f"{self.root}/snapshots") if n.endswith(".json")]

    def drop_snapshot(self, name: str) -> None:
        if name not in self.snapshots():
            raise GraphError("NOT_FOUND", name)
        self.files.delete(f"{self.root}/snapshots/{name}.json")

    def restore(self, name: str) -> None:
        """Makes a snapshot the newest state."""
        if name not in self.snapshots():
            raise GraphError("NOT_FOUND", name)
        raw = json.loads(self.files.read(f"{self.root}/snapshots/{name}.json"))
        self.catalog, self.tables = Catalog.from_json(raw["catalog"]), raw["tables"]
        self.commit()

    def backup(self, target: str) -> None:
        """Copies catalog and data to another folder, which is a store of its own."""
        target = target.rstrip("/")
        tables = json.loads(json.dumps(self.tables).replace(json.dumps(self.root)[1:-1], json.dumps(target)[1:-1]))
        for path in sorted({seg["path"] for table in self.tables.values() for seg in table}):
            self.spark.read.parquet(path).write.parquet(path.replace(self.root, target, 1))
        Files(self.spark).create(f"{target}/manifests/{1:010d}.json", json.dumps({"catalog": self.catalog.to_json(), "tables": tables}))

    def ingest(self, space: str, name: str, path: str, names: list[str] | None = None) -> DataFrame:
        """Inserts rows from Parquet files: key columns and properties."""
        return self.insert(space, name, self.spark.read.parquet(path), names)

    def dump(self, space: str, name: str, vids: list | None = None, limit: int | None = None, parts: list[int] | None = None) -> DataFrame:
        """Rows of a table, of some vertices or partitions if asked, at most `limit`."""
        rows, key = self.frame(space, name), keys_of(self.catalog.schema(space, name))[0]
        if vids is not None:
            rows = rows.where(F.col(key).isin(vids))
        if parts is not None:
            rows = rows.where(part_of(F.col(key), self.catalog.space(space).partitions).isin(parts))
        return rows if limit is None else rows.limit(limit)

    def dump_stats(self, space: str, names: list[str] | None = None, **filters) -> DataFrame:
        """(kind, name, count): how many rows a dump of each table with the same filters has."""
        found = [x for x in self.catalog.space(space).schemas.values() if names is None or x.name in names]
        counts = [self.dump(space, x.name, **filters).agg(F.count(F.lit(1)).alias("count")).select(F.lit(x.kind).alias("kind"), F.lit(x.name).alias("name"), "count") for x in found]
        return reduce(lambda a, b: a.union(b), counts)
