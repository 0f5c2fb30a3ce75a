"""Intermediate tables of one operator call, kept in the folder all executors share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

from risingtide.session import work_path

# Texts handed to Python at once. Batches are cut by rows, so this bounds their bytes
# to this many of the longest texts.
BATCH_ROWS = 1_000
# Ids that may be broadcast: 8 bytes each, so at most 32 MB. More are joined by a shuffle.
BROADCAST_IDS = 4_000_000


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


@contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """Hand Python at most ``rows`` rows at once while a table is written."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


class Scratch:
    """Tables written once and read from the shared folder.

    A lost executor costs a re-read, never a recomputation of the whole lineage.
    ``drop`` removes a table that no later step reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self._count = spark, work_path(spark, name), 0
        self._paths: dict[str, str] = {}

    def path(self, name: str) -> str:
        self._count += 1
        self._paths[name] = f"{self.root}/{name}-{self._count}"
        return self._paths[name]

    def keep(self, df: DataFrame, name: str, batch_rows: int = BATCH_ROWS) -> DataFrame:
        path = self.path(name)
        with small_batches(self.spark, batch_rows):
            df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self._paths.pop(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def with_ids(df: DataFrame, key: str, ids: DataFrame, most: int = BROADCAST_IDS) -> DataFrame:
    """The rows of ``df`` whose ``key`` is among the one column of ``ids``, a stored table."""
    column = ids.columns[0]
    few = ids.limit(most + 1).count() <= most
    return df.join(F.broadcast(ids) if few else ids, df[key] == ids[column], "left_semi")



def flagged(df: DataFrame, key: str, ids: DataFrame, name: str, most: int = BROADCAST_IDS) -> DataFrame:
    """All rows of ``df``, with ``name`` telling whether ``key`` is among the ids of a stored table."""
    few = ids.limit(most + 1).count() <= most
    ids = ids.toDF("__id").withColumn("__found", F.lit(True))
    joined = df.join(F.broadcast(ids) if few else ids, df[key] == ids["__id"], "left")
    return joined.withColumn(name, F.coalesce("__found", F.lit(False))).drop("__id", "__found")


def without_ids(df: DataFrame, key: str, ids: DataFrame, most: int = BROADCAST_IDS) -> DataFrame:
    """The rows of ``df`` whose ``key`` is not among the one column of ``ids``, a stored table."""
    column = ids.columns[0]
    few = ids.limit(most + 1).count() <= most
    return df.join(F.broadcast(ids) if few else ids, df[key] == ids[column], "left_anti")
