"""Helpers shared by the corpus operators."""

from __future__ import annotations

import os
import site
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path
from zipfile import ZipFile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Arrow batches handed to Python stay below this many bytes, whatever the length of a text.
BATCH_BYTES = "16m"


def ship(spark: SparkSession) -> None:
    """Sends this package to Python workers, once a session, where neither their working folder nor PYTHONPATH has it.

    A package that was itself sent (--py-files) or installed is left alone.
    """
    root = Path(__file__).resolve().parents[2]
    seen = {Path(p or ".").resolve() for p in ["", *os.environ.get("PYTHONPATH", "").split(os.pathsep), *site.getsitepackages()]}
    if root in seen or not root.is_dir() or (app := spark.sparkContext.applicationId) in _shipped:
        return
    path = f"{tempfile.mkdtemp(prefix='graphloom-')}/graphloom.zip"
    with ZipFile(path, "w") as out:
        for f in sorted((root / "graphloom").rglob("*.py")):
            out.write(f, str(f.relative_to(root)))
    spark.sparkContext.addPyFile(path)  # the driver serves the file to executors
    _shipped.add(app)


_shipped: set[str] = set()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where that is unset and all runs in one process."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="graphloom-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def tables_dir(spark: SparkSession) -> str:
    """Where this application keeps its intermediate tables."""
    return f"{shared_dir(spark)}/graphloom-{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet below the shared folder and reads it back.

    Cuts the lineage: a lost executor costs a reread of files that all executors see. The table stays until discard()
    or clear(), since what is made from it is computed later.
    """
    spark = df.sparkSession
    path = f"{tables_dir(spark)}/{uuid.uuid4().hex}-{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that materialize() returned and that nothing will read any more."""
    for table in tables:
        spark = table.sparkSession
        own = tables_dir(spark).rsplit("/", 1)[-1]
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            if folder.split("/")[-2] == own:
                _delete(spark, folder)


def clear(spark: SparkSession) -> None:
    """Deletes all intermediate tables of this application; results that have not been written by then are lost."""
    _delete(spark, tables_dir(spark))


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def prefix_sums(counts: DataFrame, key: str, value: str, width: int = 4096) -> DataFrame:
    """counts (key: numbers from 0, once each) with `before`, the sum of `value` over smaller keys, in two levels.

    Runs of `width` keys are summed first, so that no task orders more than `width` keys or one row for each run.
    """
    run = F.floor(F.col(key) / width).cast("long").alias("_run")
    rows = counts.select(run, key, value)
    tops = rows.groupBy("_run").agg(F.sum(value).alias("_sum"))
    ahead = Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select("_run", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_ahead"))
    within = Window.partitionBy("_run").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_within", F.coalesce(F.sum(value).over(within), F.lit(0)))
    return rows.join(tops, "_run").select(key, value, (F.col("_ahead") + F.col("_within")).alias("before"))


def bounded_batches(spark: SparkSession) -> None:
    """Bounds the bytes of an Arrow batch, so that very long texts do not pile up in one."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def text_of(name: str = "text") -> Column:
    """The text, or an empty one for null."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def fold(key: Column, modulus: int) -> Column:
    """crc32 of an id's decimal digits, modulo modulus; null ids count as empty text."""
    return (F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % modulus).cast("int")


def annotate(docs: DataFrame, text_col: str, keep: list[str], added: str, make: Callable[[], Callable[[list[bytes]], list[pa.Array]]]) -> DataFrame:
    """The columns `keep` of docs and the columns `added` (a DDL string), computed in Arrow batches from whole texts.

    make() is called once a task and gives a function from a batch's UTF-8 texts (null: empty) to one array for each
    added column. Inside, columns have names of their own, so names in docs cannot clash.
    """
    bounded_batches(docs.sparkSession)
    names = [f"c{k}" for k in range(len(keep))]
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names, strict=True)], F.col(f"`{text_col}`").cast("string").alias("raw"))
    extra = StructType.fromDDL(added)
    inner = StructType([*rows.schema.fields[:-1], *[StructField(f"a{k}", f.dataType) for k, f in enumerate(extra)]])
    within = inner.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for batch in batches:
            raw = batch.column(batch.num_columns - 1)
            texts = [b"" if x is None else x for x in raw.cast(pa.large_binary() if pa.types.is_large_string(raw.type) else pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *compute(texts)], within)

    return rows.mapInArrow(run, inner).toDF(*keep, *extra.names)
