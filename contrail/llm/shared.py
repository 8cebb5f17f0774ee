"""Small helpers that several operators use."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def work_dir(spark: SparkSession) -> str:
    """A fresh path below spark.checkpoint.dir, the folder that all machines of the cluster share.

    In a local session without that setting (one machine) the warehouse folder stands in; on a cluster that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        root = f"{spark.conf.get('spark.sql.warehouse.dir')}/_work"
    path = f"{root.rstrip('/')}/contrail-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(at)
    fs.deleteOnExit(at)  # when the driver ends
    return path


_NOTED: list[str] | None = None


@contextmanager
def noted(paths: list[str]) -> Iterator[None]:
    """Within, the folders of all tables that stored() writes are added to paths."""
    global _NOTED  # noqa: PLW0603
    before, _NOTED = _NOTED, paths
    try:
        yield
    finally:
        _NOTED = before


def delete(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Spark deletes a query's shuffle files when the query ends, not when the driver happens to collect garbage.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str = "t", lean: bool = False) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: cuts lineage, survives lost executors.

    lean: for large tables; compressed by zstd, and the shuffle files of the write are deleted when it has ended.
    """
    path = f"{work_dir(df.sparkSession)}/{name}"
    conf = df.sparkSession.conf
    before = conf.get(FREED, "false")
    if lean:
        conf.set(FREED, "true")
    try:
        (df.write.option("compression", "zstd") if lean else df.write).parquet(path)
    finally:
        if lean:
            conf.set(FREED, before)
    if _NOTED is not None:
        _NOTED.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that stored() wrote and nothing reads any more."""
    for df in tables:
        delete(df.sparkSession, sorted({f.rsplit("/", 1)[0] for f in df.inputFiles()}))


#: Bytes of an Arrow batch on its way to Python; the default has no such bound, and ten thousand texts of a few kB are too much at once.
ARROW_BYTES = 1 << 22


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow in batches of about ARROW_BYTES; the session keeps that bound."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return df.mapInArrow(run, schema)
