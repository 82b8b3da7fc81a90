"""The shared folder, and tables that are written there once because several parts of a query read them."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import DataFrame, SparkSession


@cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="brindle-")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share. Only a session on one machine may go without: it gets a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", "")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return named or _local_folder()


def kept(df: DataFrame) -> DataFrame:
    """df, computed once and written as Parquet in the shared folder. What reads it reads only the columns and rows that it needs, and survives the loss of executors."""
    path = f"{shared_folder(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stand_in(df: DataFrame) -> tuple[DataFrame, str]:
    """A table without rows that has df's columns and is planned like a file, and its path."""
    spark, path = df.sparkSession, f"{shared_folder(df.sparkSession)}/empty-{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)
    return spark.read.schema(df.schema).parquet(path), path.split(":", 1)[-1]


@contextmanager
def jobs_of(spark: SparkSession) -> Iterator[Callable[[], int]]:
    """Gives a function that counts the jobs which the block has started."""
    sc, group, key = spark.sparkContext, f"planned-{uuid.uuid4().hex}", "spark.jobGroup.id"
    before = sc.getLocalProperty(key)
    sc.setLocalProperty(key, group)

    def count() -> int:
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        return len(sc.statusTracker().getJobIdsForGroup(group))

    try:
        yield count
    finally:
        sc.setLocalProperty(key, before)


def scanned(df: DataFrame) -> list[tuple[str, set[str]]]:
    """(path, columns read) of each scan of files that is left in df's physical plan."""
    leaves, found = df._jdf.queryExecution().sparkPlan().collectLeaves(), []
    for leaf in (leaves.apply(i) for i in range(leaves.size())):
        if leaf.nodeName().startswith("Scan parquet"):
            found.append((leaf.relation().location().rootPaths().head().toString(), set(leaf.requiredSchema().fieldNames())))
    return found
