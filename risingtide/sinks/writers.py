"""Writers. ``mode`` is Spark's: ``overwrite`` replaces, ``ignore`` skips work done.

With ``replace_partitions`` an overwrite replaces only the partitions that the rows hold,
e.g. the countries of a rerun, and leaves the others as they are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, DataFrameWriter

# Rows of one CSV file. A file with line breaks inside quotes is read by one task.
FILE_ROWS = 100_000


def _writer(df: DataFrame, mode: str, partition_by: Sequence[str], replace_partitions: bool) -> DataFrameWriter:
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if replace_partitions:
        if not partition_by or mode != "overwrite":
            raise ValueError("replace_partitions needs partition_by and the mode overwrite")
        writer = writer.option("partitionOverwriteMode", "dynamic")
    return writer


def write_csv(
    df: DataFrame, path: str, mode: str = "overwrite", single_file: bool = False, partition_by: Sequence[str] = (),
    replace_partitions: bool = False,
) -> None:
    """CSV with a header, quoting what needs it.

    ``single_file`` is for small reports; of large tables every task writes files of at
    most ``FILE_ROWS`` rows.
    """
    writer = _writer(df.coalesce(1) if single_file else df, mode, partition_by, replace_partitions)
    if not single_file:
        writer = writer.option("maxRecordsPerFile", FILE_ROWS)
    writer.csv(
        path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )


def write_csv_file(df: DataFrame, path: str, mode: str = "overwrite", large: bool = False) -> None:
    """One CSV file of exactly this name, e.g. ``US_videos.csv``, whose name readers look at.

    The rows are written by one task beside it and the file is then moved into place, so
    readers never see half of it. With ``ignore`` a file that exists is kept. A ``large``
    table is written by all tasks, and the name is then that of a folder with files of at most
    ``FILE_ROWS`` rows, which readers take like a file.
    """
    spark = df.sparkSession
    files = spark._jvm.org.apache.hadoop.fs
    target, aside = files.Path(path), files.Path(f"{path}.parts")
    store = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if mode == "ignore" and store.exists(target):
        return
    write_csv(df, aside.toString(), single_file=not large)
    if large:
        store.delete(target, True)
        store.rename(aside, target)
        return
    (part,) = [f.getPath() for f in store.listStatus(aside) if f.getPath().getName().startswith("part-")]
    store.delete(target, True)
    store.rename(part, target)
    store.delete(aside, True)


def write_parquet(
    df: DataFrame, path: str, mode: str = "overwrite", partition_by: Sequence[str] = (), replace_partitions: bool = False
) -> None:
    _writer(df, mode, partition_by, replace_partitions).parquet(path)


def write_dictionary(df: DataFrame, path: str, key: str, value: str, mode: str = "overwrite") -> None:
    """A dictionary as JSON lines, one entry per line."""
    df.select(key, value).write.mode(mode).json(path)
