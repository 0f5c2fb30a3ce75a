"""Predicting view counts from hashed text with tree models."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from risingtide.functions.text import lower_words, remove_stopwords, tag_tokens
from risingtide.operators.features import hashed_text_stages
from risingtide.operators.metrics import rank_metrics, with_ranks
from risingtide.operators.models import fit
from risingtide.operators.snapshots import typed_snapshot
from risingtide.sinks.writers import write_csv
from risingtide.schemas import VIDEOS, all_strings
from risingtide.session import materialise
from risingtide.sources.records import read_records

# The columns of the report.
REPORT = (
    "video_id", "title", "channelId", "channelTitle",
    "expected", "predicted", "view_count", "prediction",
)


def with_tokens(df: DataFrame, stopwords: Iterable[str], text: str = "description", tags: str = "tags") -> DataFrame:
    return df.withColumns(
        {
            "filtered_words": remove_stopwords(lower_words(text), stopwords),
            "filtered_tags": tag_tokens(tags),
        }
    )


def prepare(videos: DataFrame, stopwords: Iterable[str], cutoff: str = "2023-11-01") -> DataFrame:
    """Latest snapshot before the cutoff, typed and tokenised."""
    return with_tokens(typed_snapshot(videos, cutoff), stopwords)


def train(prepared: DataFrame, regressor, plain: Sequence[str] = ("comments_disabled", "categoryId")) -> PipelineModel:
    """Fit hashing, assembling and the regressor on the train rows."""
    return fit([*hashed_text_stages(plain=plain), regressor], prepared)


def evaluate(model: PipelineModel, prepared: DataFrame, channel: str = "channelId", label: str = "view_count") -> DataFrame:
    """MAE and MSE of ranks within the channel, on held-out channels."""
    return rank_metrics(model.transform(prepared), [channel], label, "prediction")


def sample_report(
    model: PipelineModel, prepared: DataFrame, path: str | None = None, rows: int = 100,
    columns: Sequence[str] = REPORT, channel: str = "channelId", label: str = "view_count",
    key: Sequence[str] = ("video_id",),
) -> DataFrame:
    """The first predictions by channel and rank, with their ranks, optionally written as CSV.

    The model is applied once, to the stored result of which ranks are taken.
    """
    predicted = materialise(model.transform(prepared).select(*[c for c in columns if c not in ("expected", "predicted")]), "predictions")
    ranked = with_ranks(predicted, [channel], label, "prediction")
    report = ranked.select(*columns).orderBy(channel, "expected", *key).limit(rows)
    if path:
        write_csv(report, path)
    return report


def train_and_evaluate(
    spark: SparkSession, train_paths: Sequence[str], test_paths: Sequence[str], regressor,
    stopwords: Iterable[str] = (), report_path: str | None = None, cutoff: str = "2023-11-01",
) -> tuple[PipelineModel, DataFrame]:
    """Fit on all train files, score on all held-out files: (model, rank metrics)."""
    known, held_out = (
        prepare(read_records(spark, list(paths), all_strings(VIDEOS))[0], stopwords, cutoff)
        for paths in (train_paths, test_paths)
    )
    model = train(known, regressor)
    if report_path:
        sample_report(model, held_out, report_path)
    return model, evaluate(model, held_out)
