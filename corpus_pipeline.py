"""The corpus pipeline: each stage works on all that the stage before it kept.

``STAGES`` lists (name, function); a function takes (spark, docs, folder) and returns a
DataFrame. ``run`` writes every stage's result as Parquet to the shared folder and
reads it again as the next stage's documents. All stages but the last return the
columns of ``documents``.

The classifier and the rules judge every row on its own, whatever its id: a rejected row
without an id goes, and a row that repeats the id of a rejected one stays if its own text
passes. The two dedup stages know copies by their ids: rows without an id stay, rows that
repeat an id stay or go together. Null and empty texts fail the rules for want of words.
Ties are broken by the id, as each stage says. Texts of any length are worked on whole.
Of an empty table nothing is left; columns beyond those of ``documents`` are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from risingtide.llm import quality_classifier
from risingtide.llm.exact_dedup import exact_duplicates
from risingtide.llm.near_dedup import near_duplicates
from risingtide.llm.packing import pack_documents
from risingtide.llm.quality_rules import quality_rules
from risingtide.llm.queries import tokenizer_path, trusted_ids
from risingtide.llm.tables import Scratch, documents, with_ids, without_ids

# The column of row numbers beside those of the documents.
ROW = "__pipeline_row"


def classified(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    model = quality_classifier.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    scored = quality_classifier.scored(docs, model)
    return scored.where(F.col(quality_classifier.SCORE) >= quality_classifier.THRESHOLD).drop(quality_classifier.SCORE)


def ruled(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that pass the quality rules; the rows are numbered, since ids may be missing or repeated."""
    scratch = Scratch(spark, "ruled")
    rows = scratch.keep(docs.withColumn(ROW, F.monotonically_increasing_id()), "rows")
    good = scratch.keep(trusted_ids(spark, folder).dropna().distinct(), "good")
    trusted = with_ids(rows, "doc_id", good).select(ROW)
    verdicts = quality_rules(rows, trusted, id_col=ROW, texts_once=True)
    rejected = scratch.keep(verdicts.where("not kept").select("doc_id"), "rejected")
    return without_ids(rows, ROW, rejected).drop(ROW)


def distinct(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Of equal texts, the document with the largest id."""
    return _without(spark, docs, exact_duplicates(docs).where("not kept"), "copies")


def near_distinct(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Of each component of near copies, the document with the smallest id."""
    return _without(spark, docs, near_duplicates(docs).where("not kept"), "near-copies")


def packed(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The pieces of all remaining documents and their places in sequences."""
    return pack_documents(docs, tokenizer_path())


def _without(spark: SparkSession, docs: DataFrame, rejected: DataFrame, name: str) -> DataFrame:
    """All columns of the documents that are not rejected. Rows without an id stay."""
    ids = Scratch(spark, name).keep(rejected.select("doc_id").dropna().distinct(), "ids")
    return without_ids(docs, "doc_id", ids)


STAGES = [
    ("quality classifier", classified),
    ("quality rules", ruled),
    ("exact dedup", distinct),
    ("MinHash near-dedup", near_distinct),
    ("best-fit packing", packed),
]

# SQL can express neither the classifier nor the banding; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
