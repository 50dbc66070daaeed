"""Where jobs put intermediate tables, and how these go again."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors reach, named by ``spark.checkpoint.dir``.

    Where that is unset, a folder in the warehouse, which they reach too.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"
    return root.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder.

    All paths of an application lie in one folder, which may be dropped once
    the application has ended.
    """
    app = spark.sparkContext.applicationId
    return f"{shared_dir(spark)}/tidemark/{app}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder in whatever file system it lies."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries run inside go as soon as each has ended.

    Else Spark keeps them until its driver happens to collect what refers to
    them, and those of one step fill the disk beside those of the next.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back.

    Cuts the lineage with a table that outlives any executor, so that a target
    can be replaced although the frame was computed from it. Spark also knows
    the size of the table when it plans a join: a small one is broadcast before
    the large side is shuffled, a large one never is.
    """
    return _stage(df, fresh_path(df.sparkSession, name))


def _stage(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def side_by_side(*steps: Callable[[], object]) -> list:
    """Results of steps that don't need each other; their Spark jobs share the cluster."""
    spark = SparkSession.getActiveSession()
    with ThreadPoolExecutor(len(steps)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(s)) for s in steps]]


class Workspace:
    """Staged tables of one job, removed together.

    ``drop`` may be called as soon as nothing that is still to be computed reads
    them; used as a context manager, that is the end of the block.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._tables: list[tuple[str, DataFrame]] = []

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        path = fresh_path(self.spark, name)
        self._tables.append((path, None))
        staged = _stage(df, path)
        self._tables[-1] = (path, staged)
        return staged

    def drop(self, *tables: DataFrame) -> None:
        """Remove the given tables of this workspace."""
        self._remove([t for t in self._tables if any(t[1] is x for x in tables)])

    def drop_all(self, keep: tuple[DataFrame, ...] = ()) -> None:
        """Remove all tables but those to keep."""
        self._remove([t for t in self._tables if not any(t[1] is x for x in keep)])

    def _remove(self, gone: list[tuple[str, DataFrame]]) -> None:
        for path, _ in gone:
            delete(self.spark, path)
        self._tables = [t for t in self._tables if not any(t is g for g in gone)]

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *_) -> None:
        self.drop_all()
