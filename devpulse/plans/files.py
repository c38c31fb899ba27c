"""The few file-system calls the writing jobs need, on any Hadoop file system."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from devpulse.session import scratch_dir


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def child_names(spark: SparkSession, path: str) -> list[str]:
    p, fs = _path(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def delete(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.delete(p, True)


def is_file(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p) and fs.getFileStatus(p).isFile()


def modified(spark: SparkSession, path: str) -> float:
    """Seconds since the epoch."""
    p, fs = _path(spark, path)
    return fs.getFileStatus(p).getModificationTime() / 1000


def read_text(spark: SparkSession, path: str) -> str:
    """A small file."""
    p, fs = _path(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_new(spark: SparkSession, path: str, text: str) -> bool:
    """Create a small file with its whole content in one step; False if the name is taken.

    The content is written under another name first.  Giving it the name fails if a file has
    it: by a rename that does not replace on HDFS and its like, by a link on a local disk,
    where a rename would.  An object store without such a rename is not supported.
    """
    jvm = spark._jvm
    p, fs = _path(spark, path)
    other = jvm.org.apache.hadoop.fs.Path(p.getParent(), f".{p.getName()}-{uuid.uuid4().hex}")
    stream = fs.create(other, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    try:
        if fs.getScheme() == "file":
            here = [jvm.java.nio.file.Paths.get(x.toUri().getPath(), _array(spark, jvm.java.lang.String)) for x in (p, other)]
            jvm.java.nio.file.Files.createLink(*here)
        else:
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), spark._jsc.hadoopConfiguration())
            context.rename(other, p, _array(spark, getattr(jvm.org.apache.hadoop.fs, "Options$Rename")))
        return True
    except Py4JJavaError as e:
        if "AlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise
    finally:
        fs.delete(other, False)


def _array(spark: SparkSession, kind):
    return spark.sparkContext._gateway.new_array(kind, 0)


def staged(df: DataFrame, name: str, codec: str | None = None) -> tuple[DataFrame, str]:
    """Write an intermediate result to the shared scratch folder and read it back.

    Cuts the lineage for good: a lost executor costs a re-read, and later steps
    see the rows as they were even when the tables they came from are replaced.
    The file size also gives the planner true statistics for its join choice.
    ``codec`` is the compression of the files if not the session's.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path), path
