"""What the operators share: reading a table, bounded Arrow batches, checkpoints."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from brindle.session import shared_folder

#: Rows and bytes of a batch sent to a Python worker: one batch stays small beside the worker's memory however long the texts are.
BATCH_ROWS, BATCH_BYTES = 500, "1m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Bounds the batches of every Python function of this session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once and written to the shared folder that spark.checkpoint.dir names, its lineage cut.

    Where that setting is missing, a session on one machine takes a temporary folder; on a cluster it is an error.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """df without the columns that an operator is about to add: its own columns replace those of the same name."""
    taken = {n.lower() for n in names}
    return df.drop(*[F.col(f"`{c}`") for c in df.columns if c.lower() in taken])


#: A key is hot if at least one row in so many has it, so there are at most as many hot keys.
HOT_SHARE = 1_000


def joined_by_share(rows: DataFrame, keys: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` joined with ``keys`` (key, n, ...) by equality, where n of the ``total`` rows have a key. The few keys that a large share of the rows has are sent to them, so that their rows never meet in one task."""
    is_hot = F.col("n") * HOT_SHARE > total
    hot = F.broadcast(keys.where(is_hot))
    rest = rows.join(hot.select(key), key, "left_anti")  # before the shuffle
    return rows.join(hot, key).unionByName(rest.join(keys.where(~is_hot), key))


def crc_mod(column: str, modulus: int):
    """crc32 of the value's decimal text, modulo; -1 for null, which belongs to no fold."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % modulus, F.lit(-1))


def arrow_function(kind: pa.DataType) -> Callable:
    """Decorates a function from Arrow arrays to one Arrow array of ``kind`` as a function of columns."""
    return F.arrow_udf(returnType=from_arrow_type(kind))


_slot: dict[str, tuple[object, object]] = {}


def worker_slot(owner: str, key: object, make: Callable[[], object]):
    """What ``make`` builds, kept in this Python worker until another operator or another key needs the room: workers outlive jobs, and their memory is bounded."""
    if owner not in _slot or _slot[owner][0] != key:
        _slot.clear()
        _slot[owner] = (key, make())
    return _slot[owner][1]
