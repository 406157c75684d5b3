"""Sharding by a two-pass external shuffle, with DataFrame functions only.

Pass one scatters the records uniformly into memory-sized buckets by a seeded hash. Pass two takes one bucket at a time
into memory and applies a seeded Fisher-Yates shuffle (Spark's `shuffle`). A record's position is the number of records
in the buckets before its own plus its place within, and the shards cut the positions into equal runs: the row counts
of two shards differ by one at most, and a shard's slots are gapless from 0.

The hash covers the whole record, so the outcome does not depend on how the input is split. Equal records would all fall
into one bucket; where they are more than a quarter of a bucket holds they are counted, and scattered as lots of that many
copies each, so no bucket outgrows memory, and no task or shuffle sees a record that often.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructField, StructType

from graphloom.llm.common import materialize, prefix_sums, text_of

SEED = 6
SHARDS = 24
BUCKET_BYTES = 16 << 20
#: Bytes that a record takes besides its text.
_OVERHEAD = 64
#: Up to so many rows of two numbers are broadcast.
_BROADCAST = 200_000


def _size(text_col: str) -> Column:
    return (F.octet_length(text_of(f"`{text_col}`")) + 8).cast("long")


def _flat(field: StructField) -> Column:
    """A column as something that can be hashed so that different values differ."""
    c = F.col(f"`{field.name}`")
    return F.to_json(F.struct(c.alias("v"))) if isinstance(field.dataType, (ArrayType, MapType, StructType)) else c


def _records(docs: DataFrame, record: list[Column], with_text: bool, id_col: str, text_col: str, seed: int) -> DataFrame:
    """(a, b, cost, record) of every row; a and b hash the whole row."""
    columns = [f for f in docs.schema.fields if with_text or f.name == id_col]
    size, crc = _size(text_col), F.crc32(text_of(f"`{text_col}`").cast("binary"))
    values = [c for f in columns for c in (F.col(f"`{f.name}`").isNull(), _flat(f))]
    hashes = [F.xxhash64(F.lit(seed + k), size, crc, *values).alias(n) for k, n in enumerate("ab")]
    cost = (size if with_text else F.lit(0)) + _OVERHEAD
    return docs.select(*hashes, cost.cast("long").alias("cost"), F.struct(*record).alias("record"))


def _lots(rows: DataFrame, many: DataFrame, most: Column) -> DataFrame:
    """rows with lot and copies: equal rows that are among `many` as lots of copies, all others as lots of one."""
    one = rows.join(many, ["a", "b"], "left_anti").withColumns({"lot": F.lit(0).cast("long"), "copies": F.lit(1).cast("long")})
    rest = [F.first(c).alias(c) for c in rows.columns if c not in ("a", "b")]
    equal = rows.join(many, ["a", "b"], "left_semi").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), *rest).withColumn("most", most)
    dealt = equal.withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(n - 1) div most"))))
    return one.unionByName(dealt.withColumn("copies", F.least("most", F.col("n") - F.col("lot") * F.col("most"))).drop("n", "most"))


def _placed(docs: DataFrame, record: list[Column], with_text: bool, id_col: str, text_col: str, shards: int, seed: int, bucket_bytes: int) -> DataFrame:
    """(record, shard int, slot long), each bucket in its shuffled order."""
    rows = _records(docs, record, with_text, id_col, text_col, seed)
    light = materialize(rows.select("a", "b", "cost") if with_text else rows, "records")
    rows = rows if with_text else light
    # Copies that would fill more than a quarter of a bucket. A lot's size depends on the equal rows alone.
    most = F.greatest(F.lit(1).cast("long"), F.expr(f"{bucket_bytes // 4} div cost"))
    many = materialize(light.groupBy("a", "b", "cost").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("a", "b"), "copies")
    many = F.broadcast(many) if many.count() <= _BROADCAST else many
    lots, light = _lots(rows, many, most), _lots(light.select("a", "b", "cost"), many, most)
    total, whole = light.agg(F.sum("copies"), F.sum(F.col("copies") * F.col("cost"))).first()
    total, whole = total or 0, whole or 0
    buckets = max(1, -(-whole // bucket_bytes))
    bucket = F.pmod(F.xxhash64(F.lit(seed + 2), "a", "b", "lot"), F.lit(buckets)).alias("bucket")
    before = materialize(prefix_sums(light.groupBy(bucket).agg(F.sum("copies").alias("n")), "bucket", "n"), "offsets").drop("n")
    order = F.xxhash64(F.lit(seed + 3), "a", "b", "lot").alias("order")
    # Sorted, so that the list that is shuffled is the same however rows arrive.
    dealt = lots.select(bucket, order, "a", "b", "lot", F.struct("copies", "record").alias("of")).repartition(int(min(buckets, 20_000)), "bucket").sortWithinPartitions("bucket", "order", "a", "b", "lot")
    every = F.flatten(F.transform(F.collect_list("of"), lambda x: F.array_repeat(x["record"], x["copies"].cast("int"))))
    mixed = dealt.groupBy("bucket").agg(F.shuffle(every, F.lit(seed)).alias("records"))
    located = mixed.join(F.broadcast(before) if buckets <= _BROADCAST else before, "bucket")
    each = located.select("before", F.posexplode("records").alias("at", "record"))
    place = F.col("before") + F.col("at")
    shard = F.expr(f"(before + at) * {shards} div {max(1, total)}")
    first = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
    return each.select("record", shard.alias("shard"), place.alias("place")).select("record", F.col("shard").cast("int").alias("shard"), (F.col("place") - first).alias("slot"))


def assignment(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row for each row of docs: id_col, size, text_crc32, law ('rows'), shard, slot, grown_shard (null).

    size is the text's UTF-8 bytes plus 8; null texts count as empty. Null ids and repeated rows are records like any
    other. With fewer records than shards, some shards are empty. An empty table gives an empty result.
    """
    record = [F.col(f"`{id_col}`").alias("id"), _size(text_col).alias("size"), F.crc32(text_of(f"`{text_col}`").cast("binary")).alias("crc")]
    rows = _placed(docs, record, False, id_col, text_col, shards, seed, bucket_bytes)
    return rows.select(F.col("record.id").alias(id_col), "record.size", F.col("record.crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """docs with the columns shard and slot added, in shuffled order. Columns of these names in docs are replaced.

    Null and empty texts, null ids and repeated rows are records like any other. An empty table gives an empty result.
    """
    kept = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    rows = _placed(docs.select(*[F.col(f"`{c}`") for c in kept]), [F.col(f"`{c}`") for c in kept], True, id_col, text_col, shards, seed, bucket_bytes)
    return rows.select("record.*", "shard", "slot")


def write(docs: DataFrame, path: str, **options) -> None:
    """Writes docs as Parquet, one folder for each shard; slot gives the order within."""
    shard(docs, **options).write.partitionBy("shard").parquet(path)
