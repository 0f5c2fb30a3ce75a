"""Quality rules: fixed rules on words and lines, then a log-likelihood ratio of n-grams.

The ratio compares two multinomials over hashed word unigrams and bigrams: that of a
trusted set of documents and that of all documents, both counted over every text, or
over every different text once (``texts_once``): there copies of a text weigh nothing,
labelled or not, a text is trusted if any row of it is, and k copies of a table give its
own verdicts. The raw count is scaled to the number of trusted n-grams, and both get the same prior, so
buckets that few trusted texts could have reached say little. A document's score is the mean log ratio of its n-grams, so it does
not grow with length; documents below a fixed threshold are rejected. Log ratios are
rounded to integers before they are added, so the score does not depend on the order
of addition and the same table always gives the same verdicts.

Only DataFrame expressions are used. Words are runs of characters other than 0x09-0x0D
and 0x20; null counts as empty. A text with fewer than ten words fails the base rules.
Where no document is trusted, or there are no n-grams, the score is 0 and the base
rules decide. Rows are told apart by position: repeated rows, repeated and null ids
each keep their own row. Columns beyond id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from risingtide.llm.tables import Scratch, flagged

SPACE = r"[\x09-\x0D\x20]"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
# Buckets of the hashed n-grams; the table of their ratios is broadcast, 16 bytes each.
BUCKETS = 1 << 16
# Mean log ratio below which a document is rejected.
THRESHOLD = -0.09
# Added to the trusted count and to its expectation.
PRIOR = 10.0
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
# Words of a window that counts as repeated.
WINDOW = 5
_UNIT = 1 << 20
# Texts with copies whose digests may be broadcast, about 50 bytes each; more are joined by a shuffle.
BROADCAST_TEXTS = 500_000


def words_of(text: Column) -> Column:
    bare = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    return F.when(bare != "", F.split(bare, SPACE + "+")).otherwise(F.array().cast("array<string>"))


def _repeats(hashes: str) -> Column:
    """Positions covered by windows found twice or more in one text.

    Windows are sorted by hash with their places; places whose neighbour has the same
    hash are repeated; each covers the words up to the next repeated place, at most WINDOW.
    """
    following = ", ".join(f"get({hashes}, i + {k})" for k in range(1, WINDOW))
    windows = f"slice(transform({hashes}, (h, i) -> xxhash64(h, {following})), 1, greatest(size({hashes}) - {WINDOW - 1}, 0))"
    return F.expr(windows)


def _covered(windows: str) -> Column:
    return F.expr(f"""
        case when size(array_distinct({windows})) = size({windows}) then 0L else
          aggregate(array(array_sort(transform({windows}, (h, i) -> struct(h, i)))), 0L, (total, s) -> total +
            aggregate(array(sort_array(array_distinct(flatten(zip_with(
                slice(s, 1, size(s) - 1), slice(s, 2, size(s) - 1),
                (a, b) -> case when a.h = b.h then array(a.i, b.i) else cast(array() as array<int>) end))))),
              0L, (sum, p) -> sum + aggregate(
                zip_with(p, slice(p, 2, size(p)), (a, b) -> cast(least({WINDOW}, coalesce(b - a, {WINDOW})) as bigint)),
                0L, (x, y) -> x + y)))
        end""")


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, a row number, the base counts and the hashes of all words, in order."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    split = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"),
        text.alias("text"), words_of(text).alias("words"),
    )
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x09-\x0D\x20]"))
    counted = split.select(
        "doc_id", "row", F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        lines.alias("lines"), F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    windowed = counted.withColumn("windows", _repeats("hashes"))
    return windowed.select(
        "doc_id", "row", "n_words", "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _covered("windows").alias("n_repeat_words"), "hashes",
    )


def grams(hashes: str, buckets: int) -> Column:
    """The buckets of all unigrams and bigrams of a text."""
    return F.expr(f"""
        concat(transform({hashes}, h -> cast(pmod(h, {buckets}) as int)),
               zip_with(slice({hashes}, 1, greatest(size({hashes}) - 1, 0)), slice({hashes}, 2, size({hashes})),
                        (a, b) -> cast(pmod(xxhash64(a, b), {buckets}) as int)))""")


def copies_of(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``digest``, ``copies`` and ``any_trusted`` of every text found in two rows or more, stored."""
    return scratch.keep(docs.groupBy("digest").agg(
        F.count(F.lit(1)).alias("copies"), F.max("trusted").alias("any_trusted")).where("copies > 1"), "copies")


def log_ratios(
    docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, prior: float = PRIOR, scratch: Scratch | None = None,
) -> DataFrame:
    """``bucket`` and its ``ratio``: log of trusted to expected count, in units of 2 ** -20.

    With ``scratch`` every different text counts once.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = flagged(docs.select("doc_id", text.alias("text")), "doc_id", trusted, "trusted")
    copies = F.lit(1).cast("long")
    if scratch is not None:
        docs = docs.withColumn("digest", F.unhex(F.sha2("text", 256)))
        found = copies_of(docs, scratch)
        few = found.limit(BROADCAST_TEXTS + 1).count() <= BROADCAST_TEXTS
        docs = docs.join(F.broadcast(found) if few else found, "digest", "left").withColumn(
            "trusted", F.coalesce("any_trusted", "trusted"))
        copies = F.coalesce("copies", copies)
    each = docs.select(
        "trusted", copies.alias("copies"), F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w)).alias("hashes")
    ).select("trusted", "copies", F.explode(grams("hashes", buckets)).alias("bucket"))
    # All rows of a text have its number of copies, so each sum is a multiple of that number.
    sums = each.groupBy("bucket", "copies").agg(
        F.count(F.lit(1)).alias("raw"), F.count(F.when(F.col("trusted"), 1)).alias("target")
    )
    counts = sums.groupBy("bucket").agg(
        F.sum(F.expr("raw div copies")).alias("raw"), F.sum(F.expr("target div copies")).alias("target")
    )
    totals = counts.agg(F.sum("raw").alias("all_raw"), F.sum("target").alias("all_target"))
    expected = F.col("raw") * F.col("all_target") / F.col("all_raw")
    ratio = F.round(F.log((F.col("target") + prior) / (expected + prior)) * _UNIT).cast("long")
    return counts.join(F.broadcast(totals)).select("bucket", ratio.alias("ratio"))


def quality_rules(
    docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    buckets: int = BUCKETS, threshold: float = THRESHOLD, texts_once: bool = False,
) -> DataFrame:
    """Per row of ``docs``: id, base counts, ``base_failed``, ``score`` and ``kept``.

    ``trusted`` has one column of ids of trusted documents. ``texts_once`` counts every
    different text once.
    """
    scratch = Scratch(docs.sparkSession, "quality-rules")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    trusted = scratch.keep(trusted.dropna().distinct(), "trusted")
    ratios = scratch.keep(log_ratios(docs, trusted, buckets, scratch=scratch if texts_once else None), "ratios")
    each = measured(docs).select("doc_id", "row", *BASE, F.explode_outer(grams("hashes", buckets)).alias("bucket"))
    scored = each.join(F.broadcast(ratios), "bucket", "left").groupBy("row", "doc_id", *BASE).agg(
        (F.coalesce(F.sum("ratio") / F.count("bucket"), F.lit(0.0)) / _UNIT).alias("score")
    )
    failed = (F.col("n_words") < MIN_WORDS) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT
    )
    return scored.select(
        "doc_id", *BASE, failed.alias("base_failed"), "score", (~failed & (F.col("score") >= threshold)).alias("kept")
    )
