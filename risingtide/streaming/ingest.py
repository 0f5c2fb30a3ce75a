"""Taking in newly arrived snapshot files, each exactly once."""

from __future__ import annotations

from pyspark.sql import SparkSession, types as T


def ingest_new_files(
    spark: SparkSession,
    source: str,
    target: str,
    progress: str,
    schema: T.StructType,
    fmt: str = "csv",
    **options,
) -> int:
    """Append files not yet seen in ``source`` to the Parquet table ``target``.

    ``progress`` is the checkpoint folder that remembers what was processed; a
    rerun, also after a failure, continues there. Returns the batches run, told by
    the numbers of the batches committed before and after.
    """
    before = _last_batch(spark, progress)
    files = spark.readStream.format(fmt).schema(schema).options(**options).load(source)
    query = (
        files.writeStream.format("parquet")
        .option("checkpointLocation", progress)
        .outputMode("append")
        .trigger(availableNow=True)
        .start(target)
    )
    query.awaitTermination()
    return _last_batch(spark, progress) - before


def _last_batch(spark: SparkSession, progress: str) -> int:
    """The number of the last committed batch, -1 for none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{progress}/commits")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return -1
    names = [s.getPath().getName() for s in files.listStatus(path)]
    return max((int(n) for n in names if n.isdigit()), default=-1)
