"""Small files and folders in whatever file system Spark reads, and tables that cut a plan's lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from graphloom.errors import GraphError


class Files:
    """Hadoop's file system calls, by path."""

    def __init__(self, spark: SparkSession):
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self._conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def names(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, path: str, text: str) -> bool:
        """Publishes a new file, whole or not at all; False if it exists already, so of two writers one gets False.

        A local file is linked, which fails where the name is taken; HDFS renames, which refuses to overwrite. Other
        systems (object stores) show a file when its stream is closed: they are asked not to overwrite, which is safe
        between writers where the store has conditional puts.
        """
        fs, p = self._at(path)
        kind, jvm = fs.getUri().getScheme(), self._jvm
        if fs.exists(p):
            return False
        if kind not in ("file", "hdfs", "viewfs"):
            try:
                self._put(fs, p, text, False)
            except Exception as e:
                if "FileAlreadyExists" in str(e) or "412" in str(e):
                    return False
                raise
            return True
        temporary = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
        self._put(fs, temporary, text, True)
        try:
            if kind == "file":
                here, there = (jvm.java.io.File(x.toUri().getPath()).toPath() for x in (temporary, p))
                jvm.java.nio.file.Files.createLink(there, here)
                return True
            return fs.rename(temporary, p)
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                return False
            raise
        finally:
            fs.delete(temporary, False)

    def _put(self, fs, p, text: str, overwrite: bool) -> None:
        out = fs.create(p, overwrite)
        out.write(bytearray(text.encode()))
        out.close()

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def copy(self, source: str, target: str) -> None:
        fs, p = self._at(source)
        to, q = self._at(target)
        self._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, p, to, q, False, self._conf)


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where that is unset and all runs in one process."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise GraphError("INVALID_PARM", "spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="graphloom-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df below the application's folder in the shared one and reads it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/graphloom-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}-{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
