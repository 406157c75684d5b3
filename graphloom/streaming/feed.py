"""A change feed: puts and deletes appended to a log, followed with Structured Streaming.

A log is a folder of Parquet files with the columns of `changes`: a number that grows, put or delete, a table's name,
the key as JSON, and the row as JSON. Followers apply batches by key, so a batch that is applied twice does no harm; the
stream's checkpoint holds what has been applied.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphloom.operators.mutate import one_of

LOG = "seq long, op string, name string, key string, row string, ts timestamp"


def changes(rows: DataFrame, keys: list[str], name: str, op: str, first: int = 0) -> DataFrame:
    """Log entries for the rows of a put or the keys of a delete."""
    key = F.to_json(F.struct(*keys))
    row = F.to_json(F.struct(*rows.columns)) if op == "put" else F.lit(None).cast("string")
    return rows.select((F.monotonically_increasing_id() + first).alias("seq"), F.lit(op).alias("op"), F.lit(name).alias("name"), key.alias("key"), row.alias("row"), F.current_timestamp().alias("ts"))


def append(log: str, entries: DataFrame) -> None:
    entries.write.mode("append").parquet(log)


def follow(spark: SparkSession, log: str, files_per_batch: int = 1000) -> DataFrame:
    """The log as a stream."""
    return spark.readStream.schema(LOG).option("maxFilesPerTrigger", files_per_batch).parquet(log)


def replicate(stream: DataFrame, sink, checkpoint: str, deletes: bool = True) -> StreamingQuery:
    """Hands each batch's last entry of every key to sink(batch, number), until what is there has been read.

    sink gets (name, key, op, row, seq). Without deletes only puts are handed on, as full-text sinks want it.
    """

    def apply(batch: DataFrame, number: int) -> None:
        rows = batch if deletes else batch.where("op = 'put'")
        last = one_of(rows.select("name", "key", "op", "row", "seq", F.col("seq").alias("_ord")), ["name", "key"], last=True)
        sink(last, number)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def parquet_sink(path: str):
    """A sink that keeps each batch under its number; a batch that comes again replaces itself."""

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number:010d}")

    return sink


def state(spark: SparkSession, path: str) -> DataFrame:
    """What a parquet sink holds now: the entry of each key with the largest number, whatever batch it came in; no deleted ones."""
    rows = spark.read.parquet(path).withColumnRenamed("seq", "_ord")
    return one_of(rows.select("name", "key", "op", "row", "_ord"), ["name", "key"], last=True).where("op = 'put'").drop("op")


def tokens(entries: DataFrame, fields: list[str]) -> DataFrame:
    """(name, key, field, token): lower-case words of string fields, what a full-text sink stores."""
    values = F.array(*[F.struct(F.lit(f).alias("field"), F.get_json_object("row", f"$.{f}").alias("value")) for f in fields])
    rows = entries.where("op = 'put'").select("name", "key", F.explode(values).alias("v")).where("v.value IS NOT NULL")
    words = F.array_distinct(F.regexp_extract_all(F.lower("v.value"), F.lit("[\\p{L}\\p{N}]+"), F.lit(0)))
    return rows.select("name", "key", F.col("v.field").alias("field"), F.explode(words).alias("token"))


def activity(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Changes counted by table, kind and window; entries later than the watermark are left out. An extension."""
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", window), "name", "op").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").alias("start"), "name", "op", "n")
