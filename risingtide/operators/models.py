"""Tree regressors with the settings of the view-count and duration studies."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, RandomForestRegressor
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from risingtide.operators.features import fit_stages
from risingtide.session import materialise

SEED = 17
# Train rows of one partition, and the fewest partitions. Both are part of a model: other
# values sample other rows. A round of boosting reads a partition's binned rows three times,
# 7 KB a row at 578 features.
FIT_ROWS = 25_000
FIT_PARTITIONS = 8
# MB of node statistics that every task holds at once. Nodes beyond them are split in a later
# pass, with the same splits where all features are looked at; where a node draws its features,
# as in a forest, nodes of later passes draw others.
NODE_MB = 512
# As NODE_MB, for a forest: a level of 20 trees fills what it is given, and two tasks of an executor hold
# it next to the stored rows, which take most of the memory once the train table is larger than it.
FOREST_MB = 128


def decision_tree(label: str = "view_count", depth: int = 15, memory_mb: int = NODE_MB, **more):
    return DecisionTreeRegressor(
        maxDepth=depth, maxMemoryInMB=memory_mb, labelCol=label, seed=SEED, **more
    )


def random_forest(
    label: str = "view_count", trees: int = 20, depth: int = 12, share: float = 0.5,
    memory_mb: int = FOREST_MB, **more,
):
    return RandomForestRegressor(
        numTrees=trees, maxDepth=depth, maxMemoryInMB=memory_mb, labelCol=label,
        subsamplingRate=share, seed=SEED, **more,
    )


def plain_forest(label: str = "endTrendingDuration", **more):
    """Spark's default forest: 20 trees of depth 5."""
    return RandomForestRegressor(labelCol=label, seed=SEED, **more)


def boosted_trees(
    label: str = "view_count", depth: int = 15, share: float = 0.5, memory_mb: int = NODE_MB, **more
):
    return GBTRegressor(
        maxDepth=depth, maxMemoryInMB=memory_mb, labelCol=label, subsamplingRate=share,
        seed=SEED, **more,
    )


def fit(stages: list, train: DataFrame, partition_rows: int = FIT_ROWS) -> PipelineModel:
    """Fit feature stages and, last, a regressor.

    Tree training reads its input several times, so the finished vectors are
    stored first. Spark samples rows by partition and position, so rows are placed
    by a hash of their values into a number of partitions that follows from the number
    of rows alone, and sorted inside: the model does not depend on the cluster or on how
    the train table is stored.
    """
    *feature_stages, regressor = stages
    features, train = fit_stages(feature_stages, train)
    vector, label = regressor.getFeaturesCol(), regressor.getLabelCol()
    values = vector_to_array(F.col(vector))
    ready = materialise(
        features.transform(train).select(vector, label, F.xxhash64(values, label).alias("__place")), "vectors"
    )
    partitions = max(FIT_PARTITIONS, -(-ready.count() // partition_rows))
    ready = ready.repartition(partitions, "__place").sortWithinPartitions("__place")
    return PipelineModel(stages=[*features.stages, regressor.fit(ready)])


def importances(model, spark: SparkSession) -> DataFrame:
    """(feature index, weight) of the fitted trees; all features, also unused ones."""
    fitted = model.stages[-1] if isinstance(model, PipelineModel) else model
    weights = fitted.featureImportances.toArray()
    return spark.createDataFrame(
        [(i, float(w)) for i, w in enumerate(weights)], "feature int, weight double"
    )


def save(model, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)
