"""What the operators of this subpackage share: tokens, table writing, row helpers."""

from __future__ import annotations

import contextlib
import gc
import re
import sys
import tempfile
import time
import types
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: The white space of the contracts; everything else belongs to a word.
SPACE = b" \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see (spark.checkpoint.dir); without one, a local folder is set where all tasks run in this process."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="scrivano-")
        spark.sparkContext.setCheckpointDir(where)
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


_RECORDED: list[list[str]] = []


@contextlib.contextmanager
def recording(paths: list[str]):
    """Paths that are made meanwhile are added to paths, for whoever knows when their tables are no longer read."""
    _RECORDED.append(paths)
    try:
        yield
    finally:
        _RECORDED.pop()


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/scrivano/{name}-{uuid.uuid4().hex}"
    if _RECORDED:
        _RECORDED[-1].append(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: lineage is cut, and a lost executor loses nothing."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Buckets:
    """A table in the shared folder, in buckets of key, so that grouping by it again and again moves no rows; it grows by adding."""

    def __init__(self, spark: SparkSession, name: str, key: str, buckets: int):
        self.spark, self.key, self.buckets = spark, key, buckets
        self.path, self.table = new_path(spark, name), f"scrivano_{uuid.uuid4().hex}"

    def add(self, df: DataFrame) -> DataFrame:
        df.write.mode("append").format("parquet").bucketBy(self.buckets, self.key).option("path", self.path).saveAsTable(self.table)
        return self.spark.table(self.table)

    def forget(self) -> None:
        """Drops the catalog's entry; the files are external and stay, for plans that read them."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def release(spark: SparkSession) -> None:
    """Has Spark's cleaner delete the shuffle files that no plan refers to any more: in two rounds, as Python's references to
    Java objects go in the background."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8 bytes; null is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the size of df's plan."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def parts_of(df: DataFrame, part_bytes: int, most: int = 1 << 20) -> int:
    """As many parts as df's files have part_bytes, shuffle partitions at least; for inputs of unknown size, these."""
    size = estimated_bytes(df)
    return max(width(df.sparkSession), min(most, -(-size // part_bytes)) if size < 1 << 60 else 0)


def join_small(left: DataFrame, right: DataFrame, on: list[str], how: str, rows: int, row_bytes: int, limit: int = 32 << 20) -> DataFrame:
    """Broadcast right only while rows * row_bytes, its counted size, is within limit; else a shuffled join that AQE may split by skew."""
    from pyspark.sql import functions as F

    return left.join(F.broadcast(right) if rows * row_bytes <= limit else right, on, how)


def worker_cache(name: str) -> dict:
    """A dict that lives as long as the Python worker; modules sent with a function's code are new for each task."""
    return sys.modules.setdefault("_scrivano_cache", types.ModuleType("_scrivano_cache")).__dict__.setdefault(name, {})
