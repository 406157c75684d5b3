"""Listeners: followers of a space that hand on what its writes have committed.

A table's segments are its log: each has a number that grows, and a listener keeps, in the catalog, the last number it
has handed on for each table. A segment is applied before its number is kept, so a listener that is lost hands it on
again; sinks go by key and number, and a segment that comes twice replaces itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.catalog import Schema, Space
from graphloom.errors import GraphError
from graphloom.operators.mutate import one_of
from graphloom.sources.store import Store, keys_of
from graphloom.streaming import feed

#: sink(space, schema, entries, number) gets the entries of one segment and its number.
Sink = Callable[[Space, Schema, DataFrame, int], None]


class Listener:
    """One kind of listener of a space, registered with Catalog.add_listener.

    Without a sink of its own it keeps tokens of the string fields of full-text indexes below its target folder. Puts are
    handed on; deletes too, unless they are switched off.
    """

    def __init__(self, store: Store, space: str, kind: str = "fulltext", sink: Sink | None = None, deletes: bool = True):
        self.store, self.space, self.kind, self.deletes = store, space, kind, deletes
        self.sink = sink or self._tokens
        self._entry()

    def _entry(self) -> dict:
        found = next((x for x in self.store.catalog.space(self.space).listeners if x["kind"] == self.kind), None)
        if found is None:
            raise GraphError("NOT_FOUND", f"listener {self.kind}")
        return found

    def reset(self) -> None:
        """Forgets what has been handed on, so that all is handed on again, and clears the token tables."""
        self.store.atomic(lambda _: self._entry().update(applied={}))
        if self.sink == self._tokens:
            self.store.files.delete(f"{self._entry()['target']}/{self.store.catalog.space(self.space).id}")

    def catch_up(self) -> int:
        """Hands on every segment that has been committed since the last time; returns how many."""
        self.store.refresh()
        space, done = self.store.catalog.space(self.space), 0
        for schema in sorted(space.schemas.values(), key=lambda x: x.id):
            applied = self._entry().get("applied", {}).get(str(schema.id), 0)
            for segment in self.store.tables.get(f"{space.id}/{schema.id}", []):
                number = segment["seq"]
                # A segment that compaction made holds nothing new for those who had all that went into it.
                if number > applied and applied < segment.get("upto", number):
                    self._hand_on(space, schema, segment)
                    done += 1
                if number > applied:
                    applied = number
                    self.store.atomic(lambda _, key=str(schema.id), n=number: self._entry().setdefault("applied", {}).update({key: n}))
        return done

    def _hand_on(self, space: Space, schema: Schema, segment: dict) -> None:
        keys = keys_of(schema)
        if segment["gone"]:
            if not self.deletes:
                return
            rows = self.store.spark.read.parquet(segment["path"]).select(*keys)
            entries = feed.changes(rows, keys, schema.name, "delete")
        else:
            rows = self.store._newest([segment], keys, self.store._columns(schema), space)
            rows = rows.select(*keys, *[self.store._value(schema, p).cast(p.parsed.surfaced).alias(p.name) for p in schema.latest.props])
            entries = feed.changes(rows, keys, schema.name, "put")
        self.sink(space, schema, entries.withColumn("seq", F.lit(segment["seq"]).cast("long")), segment["seq"])

    def _folder(self, space: Space, schema: Schema) -> str:
        return f"{self._entry()['target']}/{space.id}/{schema.id}"

    def _tokens(self, space: Space, schema: Schema, entries: DataFrame, number: int) -> None:
        """Keeps a segment's tokens, and a row without a token for each of its keys, under the segment's number."""
        fields = [f.name for i in space.fulltext.values() if i.schema == schema.name for f in i.fields]
        if not fields:
            return
        words = feed.tokens(entries, fields).select("key", "field", "token")
        seen = entries.select("key", F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("token"))
        words.unionByName(seen).write.mode("overwrite").parquet(f"{self._folder(space, schema)}/seq={number}")

    def tokens(self, schema: str) -> DataFrame:
        """(key, field, token) of the newest row of each key; deleted ones have none."""
        space = self.store.catalog.space(self.space)
        folder = self._folder(space, self.store.catalog.schema(self.space, schema))
        if not self.store.files.names(folder):
            return self.store.spark.createDataFrame([], "key string, field string, token string")
        rows = self.store.spark.read.parquet(folder)
        newest = one_of(rows.select("key", F.col("seq").alias("of"), F.col("seq").alias("_ord")), ["key"], last=True)
        return rows.join(newest, (rows["key"] == newest["key"]) & (rows["seq"] == newest["of"]), "left_semi").where("token IS NOT NULL").select("key", "field", "token")
