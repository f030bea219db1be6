"""One-vs-rest boosted trees, scored out of fold, on features that may be missing."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightline.sources.scratch import stored

#: Stands for a missing feature; trees can split it off, and an indicator column says so as well.
MISSING = -1.0e9


def with_indicators(df: DataFrame, features: list[str]) -> tuple[DataFrame, list[str]]:
    """Spark's trees do not route missing values: fill them and add a 0/1 column for each feature."""
    out = df.withColumns({f"{c}_missing": F.col(c).isNull().cast("double") for c in features} | {c: F.coalesce(F.col(c).cast("double"), F.lit(MISSING)) for c in features})
    return out, [*features, *[f"{c}_missing" for c in features]]


def fit(df: DataFrame, features: list[str], label: str, iterations: int = 20, depth: int = 4, seed: int = 0) -> PipelineModel:
    assembler = VectorAssembler(inputCols=features, outputCol="_features")
    trees = GBTClassifier(featuresCol="_features", labelCol=label, maxIter=iterations, maxDepth=depth, stepSize=0.1, seed=seed)
    return Pipeline(stages=[assembler, trees]).fit(df)


def scored(model: PipelineModel, df: DataFrame, name: str) -> DataFrame:
    return model.transform(df).withColumn(name, vector_to_array("probability")[1]).drop("_features", "rawPrediction", "probability", "prediction")


def out_of_fold(df: DataFrame, features: list[str], label: str, folds: int, **options) -> DataFrame:
    """``score`` of each row by the model of the other folds (column ``fold``); rows are made once, for all fits and scores."""
    filled, columns = with_indicators(stored(df, "models-folds"), features)
    parts = [scored(fit(filled.where(F.col("fold") != k), columns, label, **options), filled.where(F.col("fold") == k), "score") for k in range(folds)]
    return reduce(DataFrame.unionByName, parts).drop(*[c for c in columns if c not in df.columns])


def fit_all(df: DataFrame, features: list[str], labels: list[str], **options) -> dict[str, PipelineModel]:
    """One model for each label column, one against the rest; rows may lack features."""
    filled, columns = with_indicators(df, features)
    return {label: fit(filled, columns, label, **options) for label in labels}


def score_all(models: dict[str, PipelineModel], df: DataFrame, features: list[str], keys: list[str]) -> DataFrame:
    """``keys`` and each class's probability ``p_<class>``."""
    filled, _ = with_indicators(df, features)
    for label, model in models.items():
        filled = scored(model, filled, f"p_{label}")
    return filled.select(*keys, *[f"p_{label}" for label in models])


def save(models: dict[str, PipelineModel], path: str) -> None:
    """Models in Spark's own format, a folder for each class."""
    for label, model in models.items():
        model.write().overwrite().save(f"{path}/{label}")


def load(path: str, labels: list[str]) -> dict[str, PipelineModel]:
    return {label: PipelineModel.load(f"{path}/{label}") for label in labels}


def principal_axes(df: DataFrame, vector: str, k: int = 3) -> DataFrame:
    """Coordinates ``x, y, z`` on the first principal axes.  (A linear stand-in for a neighbour embedding, which Spark lacks.)"""
    dense = df.withColumn("_v", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))
    at = vector_to_array(F.col("_p"))
    return PCA(k=k, inputCol="_v", outputCol="_p").fit(dense).transform(dense).select(*df.columns, *[at[i].alias("xyz"[i]) for i in range(k)])
