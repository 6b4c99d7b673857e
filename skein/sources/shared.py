"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Frees the shuffle files of a query once it is done; a written table does not need them again.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder of our own where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = "/tmp/skein-checkpoints"
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def work_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/skein/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder of any file system that Spark can open; nothing happens if it isn't there."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings (dots as double underscores) that hold within the block only."""
    before = {k: spark.conf.get(k, None) for k in (n.replace("__", ".") for n in values)}
    try:
        for k, v in zip(before, values.values(), strict=True):
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """What is collected or written within the block leaves no shuffle files behind."""
    with settings(spark, **{CLEANUP.replace(".", "__"): "true"}):
        yield


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = path or work_path(spark, name)
    with freed_shuffles(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables between the steps of one operator. close, or leaving a with block, deletes those not released."""

    def __init__(self, spark: SparkSession):
        self.spark, self._paths = spark, {}

    def written(self, df: DataFrame, name: str, files: int | None = None) -> DataFrame:
        """files: so many at most, as a step of many small files costs more than the step."""
        path = work_path(self.spark, name)
        table = written(df.coalesce(files) if files else df, name, path)
        self._paths[id(table)] = (path, table)
        return table

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables whose readers are done."""
        for path, _ in filter(None, (self._paths.pop(id(table), None) for table in tables)):
            delete(self.spark, path)

    def release(self, table: DataFrame, to: Scratch | None = None) -> DataFrame:
        """table, which stays, or is deleted by another."""
        found = self._paths.pop(id(table))
        if to is not None:
            to._paths[id(table)] = found
        return table

    def close(self) -> None:
        self.drop(*(table for _, table in list(self._paths.values())))

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()
