"""Predicting how long an item trends: features, neighbours and a forest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from risingtide.functions.text import normalised_name
from risingtide.operators.durations import duration_features
from risingtide.operators.enrich import join_on_name
from risingtide.operators.features import (
    DURATION_CODED,
    DURATION_NUMERIC,
    as_array,
    coded_stages,
    fit_transform,
)
from risingtide.operators.metrics import regression_metrics
from risingtide.operators.models import fit, plain_forest
from risingtide.operators.neighbours import nearest_neighbours, neighbour_mean
from risingtide.operators.split import exact_sample, sample_rows, split_by_key
from risingtide.session import materialise
from risingtide.sinks.writers import write_parquet

LABEL = "endTrendingDuration"

CHANNEL_COLUMNS = {
    "Suscribers": "channelSuscribers",
    "Visits": "channelAvgVisits",
    "Likes": "channelAvgLikes",
    "Comments": "channelAvgComments",
}


def with_channel_stats(rows: DataFrame, stats: DataFrame) -> DataFrame:
    """Add the channel's figures; channels without figures drop out."""
    side = stats.select(
        "Username", *[F.col(c).alias(new) for c, new in CHANNEL_COLUMNS.items()]
    )
    return join_on_name(
        rows, side, normalised_name("channelTitle"), normalised_name("Username")
    ).drop("Username")


def feature_table(rows: DataFrame, stats: DataFrame, per_region: bool = False) -> DataFrame:
    return duration_features(with_channel_stats(rows, stats), per_region=per_region)


def write_train_and_test(
    features: DataFrame, train_path: str, test_path: str,
    fraction: float = 20_000 / 39_000, held_out: float = 0.2, rows: int | None = None,
) -> None:
    """Sample, split and store the feature table. With ``rows`` the sample has exactly so many rows."""
    if rows is None:
        chosen = sample_rows(features, "video_id", fraction, "sample")
    else:
        chosen = exact_sample(features, "video_id", rows, "sample")
    train, test = split_by_key(materialise(chosen, "sample"), "video_id", held_out)
    write_parquet(train, train_path)
    write_parquet(test, test_path)


def knn_predictions(
    train: DataFrame, test: DataFrame, key: Sequence[str], k: int = 5, label: str = LABEL,
    numeric: Sequence[str] = DURATION_NUMERIC, coded: Sequence[str] = DURATION_CODED,
    unseen: str = "error",
) -> DataFrame:
    """Test rows' label next to the mean label of their ``k`` nearest train rows."""
    # A missing part is marked, so ("a", null) and ("a") are different rows.
    row_id = F.concat_ws("\u0001", *[F.coalesce(F.col(k).cast("string"), F.lit("\u0002")) for k in key])
    train, test = train.withColumn("id", row_id), test.withColumn("id", row_id)
    stages = coded_stages(numeric, coded, unseen=unseen)
    train, test = (as_array(df, "scaledFeatures", "vec") for df in fit_transform(stages, train, test))
    found = nearest_neighbours(test, train, k, query_vector="vec", point_vector="vec")
    predicted = neighbour_mean(found, train, "id", label)
    return predicted.join(test.select(F.col("id").alias("query_id"), F.col(label).alias("label")), "query_id")


def forest_predictions(
    train: DataFrame, test: DataFrame, label: str = LABEL,
    numeric: Sequence[str] = DURATION_NUMERIC, coded: Sequence[str] = DURATION_CODED,
    unseen: str = "error",
) -> DataFrame:
    """Random forest with Spark's defaults, fitted on train only."""
    stages = [*coded_stages(numeric, coded, scaled=None, unseen=unseen), plain_forest(label)]
    return fit(stages, train).transform(test)


def score(predictions: DataFrame, label: str = LABEL, prediction: str = "prediction") -> DataFrame:
    return regression_metrics(predictions, label, prediction)
