"""Key-value pairs: frames of (key, value), unique by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.errors import GraphError
from graphloom.operators import mutate


def put(pairs: DataFrame, new: DataFrame) -> DataFrame:
    return mutate.upsert(pairs, new, ["key"])


def get(pairs: DataFrame, keys: DataFrame, return_partly: bool = False) -> DataFrame:
    """The pairs of the keys; a missing key raises KEY_NOT_FOUND when the result is read, unless return_partly."""
    wanted = keys.select("key").distinct()
    if return_partly:
        return pairs.join(wanted, "key", "left_semi")
    found = wanted.join(pairs.withColumn("_here", F.lit(True)), "key", "left")
    value = F.when(F.col("_here"), F.col("value")).otherwise(F.raise_error(F.concat(F.lit("KEY_NOT_FOUND: "), "key")).cast("string"))
    return found.select("key", value.alias("value"))


def remove(pairs: DataFrame, keys: DataFrame) -> DataFrame:
    return mutate.delete(pairs, keys, ["key"])


def remove_range(pairs: DataFrame, begin: str, end: str) -> DataFrame:
    """Without the keys in [begin, end)."""
    return pairs.where(~((F.col("key") >= begin) & (F.col("key") < end)))


def scan(pairs: DataFrame, begin: str, end: str) -> DataFrame:
    """The pairs of keys in [begin, end); the comparison reaches the Parquet scan."""
    if begin > end:
        raise GraphError("INVALID_PARM", "the range ends before it begins")
    return pairs.where((F.col("key") >= begin) & (F.col("key") < end))


def prefix(pairs: DataFrame, start: str, after: str | None = None) -> DataFrame:
    """The pairs whose keys have a prefix, from a key on if given: how a cursor resumes."""
    rows = pairs.where(F.col("key").startswith(start))
    return rows if after is None else rows.where(F.col("key") >= after)
