"""Feature vectors with Spark ML stages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.feature import (
    CountVectorizer,
    HashingTF,
    IDF,
    OneHotEncoder,
    StandardScaler,
    StringIndexer,
    VectorAssembler,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from risingtide.session import materialise

# Hash buckets for words and for tags.
WORD_BUCKETS = 512
TAG_BUCKETS = 64

# The feature columns of the duration study.
DURATION_NUMERIC = (
    "becomeTrendingDuration", "view_count", "likes", "dislikes", "comment_count",
    "channelAvgVisits", "channelAvgLikes", "channelAvgComments",
)
DURATION_CODED = ("category", "region")


def hashed_text_stages(
    words: str = "filtered_words",
    tags: str = "filtered_tags",
    plain: Sequence[str] = ("comments_disabled", "categoryId"),
    out: str = "features",
) -> list:
    """Hash words and tags, then assemble; rows with an invalid value are skipped."""
    return [
        HashingTF(numFeatures=WORD_BUCKETS, inputCol=words, outputCol="final_words"),
        HashingTF(numFeatures=TAG_BUCKETS, inputCol=tags, outputCol="final_tags"),
        VectorAssembler(
            inputCols=[*plain, "final_words", "final_tags"], outputCol=out, handleInvalid="skip"
        ),
    ]


def coded_stages(
    numeric: Sequence[str] = DURATION_NUMERIC,
    coded: Sequence[str] = DURATION_CODED,
    out: str = "features",
    scaled: str | None = "scaledFeatures",
    unseen: str = "error",
) -> list:
    """Index and one-hot the coded columns, assemble, and scale to unit deviation.

    Coded columns are dimensions such as category or region: the indexer keeps
    their distinct labels on the driver; ``indexing.scaled_entries`` takes any number
    of labels. ``unseen`` is what a label absent from
    train does: ``error``, ``keep`` (a bucket of its own) or ``skip``.
    """
    indexers = [
        StringIndexer(
            inputCol=c, outputCol=f"{c}Index", stringOrderType="frequencyDesc", handleInvalid=unseen
        )
        for c in coded
    ]
    encoders = [OneHotEncoder(inputCol=f"{c}Index", outputCol=f"{c}Vec") for c in coded]
    stages = [
        *indexers,
        *encoders,
        VectorAssembler(inputCols=[*numeric, *[f"{c}Vec" for c in coded]], outputCol=out),
    ]
    if scaled:
        stages.append(StandardScaler(inputCol=out, outputCol=scaled))
    return stages


def fit_stages(stages: list, train: DataFrame) -> tuple[PipelineModel, DataFrame]:
    """The fitted stages and the train rows.

    Every stage that learns something reads the rows once more, so where there
    is one they are stored first.
    """
    if any(isinstance(s, Estimator) for s in stages):
        train = materialise(train, "train")
    return Pipeline(stages=stages).fit(train), train


def fit_transform(stages: list, train: DataFrame, *others: DataFrame) -> tuple[DataFrame, ...]:
    """Fit on train only; transform train and the others."""
    model, train = fit_stages(stages, train)
    return tuple(model.transform(df) for df in (train, *others))


def as_array(df: DataFrame, vector: str, out: str | None = None) -> DataFrame:
    return df.withColumn(out or vector, vector_to_array(F.col(vector)))


def tfidf_vectors(
    df: DataFrame, tokens: str, vocabulary: int, out: str = "tfidf"
) -> tuple[DataFrame, list[str]]:
    """Spark ML TF-IDF that keeps the index -> term mapping: vectors and terms.

    Terms beyond the ``vocabulary`` most frequent ones have no weight; the terms kept
    are held by the driver. ``indexing.tfidf_entries`` keeps all terms, as a table.
    """
    model, df = fit_stages(
        [
            CountVectorizer(inputCol=tokens, outputCol="__counts", vocabSize=vocabulary),
            IDF(inputCol="__counts", outputCol=out),
        ],
        df,
    )
    return model.transform(df).drop("__counts"), model.stages[0].vocabulary


def hashed_tfidf_vectors(
    df: DataFrame, tokens: str, buckets: int = WORD_BUCKETS, out: str = "tfidf"
) -> DataFrame:
    """TF-IDF over hash buckets, for vocabularies that need not be named."""
    model, df = fit_stages(
        [
            HashingTF(inputCol=tokens, outputCol="__counts", numFeatures=buckets),
            IDF(inputCol="__counts", outputCol=out),
        ],
        df,
    )
    return model.transform(df).drop("__counts")


def top_weighted_terms(vectors: DataFrame, vector: str, terms: list[str], n: int = 10) -> DataFrame:
    """Terms by their summed weight over all vectors: ``term``, ``score``.

    ``terms`` is the fitted vocabulary, bounded by its ``vocabSize``.
    """
    names = vectors.sparkSession.createDataFrame(list(enumerate(terms)), "pos int, term string")
    # Vectors are added up as vectors; only the one total is unfolded.
    total = vectors.agg(Summarizer.sum(F.col(vector)).alias("total"))
    sums = total.select(F.posexplode(vector_to_array("total")).alias("pos", "score")).where("score <> 0")
    return sums.join(names, "pos").select("term", "score").orderBy(F.desc("score"), "term").limit(n)
