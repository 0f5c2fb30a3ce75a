"""CSV files read into good rows and malformed records, by Spark's own reader."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from risingtide.schemas import CORRUPT, all_strings, with_corrupt
from risingtide.session import materialise


def read_records(
    spark: SparkSession, paths: str | Sequence[str], schema: T.StructType, header: bool = True, multi_line: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """(good rows, malformed records as ``file`` and ``text``).

    Malformed is a record with too few or too many fields; it lands in the reader's
    corrupt-record column. A field that does not fit its type becomes null in a row that
    stays. The files are read once: both results come from the stored rows.

    ``multi_line`` accepts line breaks inside quotes, as descriptions have them; each file
    is then read by one task, so many files are read by many tasks. Without it large files
    are split, every line is a record, and a stray quote costs one line.
    """
    reader = spark.read.schema(with_corrupt(all_strings(schema))).options(
        header=header, escape='"', multiLine=multi_line, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT, maxCharsPerColumn=-1)
    read = reader.csv(paths if isinstance(paths, str) else list(paths))
    parsed = materialise(read.select("*", F.col("_metadata.file_path").alias("__file")), "records")
    good = parsed.where(F.col(CORRUPT).isNull()).select(*[
        (F.col(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name).try_cast(f.dataType)).alias(f.name)
        for f in schema])
    bad = parsed.where(F.col(CORRUPT).isNotNull())
    return good, bad.select(F.col("__file").alias("file"), F.col(CORRUPT).alias("text"))
