"""Repeatable samples and splits, decided row by row from a key's hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from risingtide.functions.keys import in_sample


def sample_rows(df: DataFrame, key: str, fraction: float, seed: str = "") -> DataFrame:
    return df.where(in_sample(key, fraction, seed))


def split_by_key(
    df: DataFrame, key: str, held_out: float, seed: str = ""
) -> tuple[DataFrame, DataFrame]:
    """(train, test): every row of a key goes to the same side.

    With a group column as key whole groups are held out; with a unique row key
    rows are. Null keys stay in train. Neither side needs a shuffle.
    """
    test = in_sample(key, held_out, seed)
    return df.where(~test), df.where(test)


# Rows that one task may sort for the end of an exact sample.
EXACT_ROWS = 100_000
# Hex digits by which a pass narrows the end down: 4,096 counts reach the driver.
_DIGITS = 3


def exact_sample(df: DataFrame, key: str, n: int, seed: str = "", end_rows: int = EXACT_ROWS) -> DataFrame:
    """Exactly ``n`` rows, those with the smallest md5 of their key; all where there are fewer.

    The hash where the sample ends is found digit by digit: each pass counts rows by the
    next ``_DIGITS`` hex digits behind the digits already known, until at most ``end_rows``
    rows share them. Those are sorted, all rows below are taken as they are; nothing is
    sorted as a whole. Null keys are never in. ``df`` is read once per pass. Rows repeating
    a key tie: their number is exact, which of them are taken is not defined.
    """
    hashed = df.where(F.col(key).isNotNull()).withColumn("__hash", F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))))
    known, left = "", n
    while left > 0 and len(known) + _DIGITS <= 32:
        rest = hashed.where(F.col("__hash").startswith(known)) if known else hashed
        counts = rest.groupBy(F.substring("__hash", len(known) + 1, _DIGITS).alias("digits")).agg(F.count(F.lit(1)).alias("rows"))
        found = sorted((r["digits"], r["rows"]) for r in counts.collect())
        for digits, rows in found:
            if rows >= left:
                break
            left -= rows
        else:
            # Only on the first pass: there are fewer rows than wanted.
            return hashed.drop("__hash")
        known += digits
        if rows <= end_rows:
            break
    end = hashed.where(F.col("__hash").startswith(known)).orderBy("__hash", key).limit(left)
    return hashed.where(F.col("__hash") < known).unionByName(end).drop("__hash")


def random_split(df: DataFrame, weights: list[float], seed: int) -> list[DataFrame]:
    return df.randomSplit(weights, seed)


def random_sample(df: DataFrame, fraction: float, seed: int) -> DataFrame:
    return df.sample(False, fraction, seed)
