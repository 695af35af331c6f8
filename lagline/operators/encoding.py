"""Feature encoding with Spark ML stages."""

from __future__ import annotations

from pyspark.ml import Estimator, Pipeline, Transformer
from pyspark.ml.feature import (
    Imputer,
    OneHotEncoder,
    StandardScaler,
    StringIndexer,
    VectorAssembler,
)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagline.schemas import CATEGORICAL_FEATURES, NUMERIC_FEATURES

Stage = Estimator | Transformer
IMPUTED = "_imputed"


def indexer(columns: list[str] = CATEGORICAL_FEATURES) -> StringIndexer:
    """Most frequent value first, ties by text; unseen values and nulls get a slot of their own."""
    return StringIndexer(
        inputCols=columns,
        outputCols=[f"{name}_index" for name in columns],
        handleInvalid="keep",
    )


def one_hot(columns: list[str] = CATEGORICAL_FEATURES) -> OneHotEncoder:
    return OneHotEncoder(
        inputCols=[f"{name}_index" for name in columns],
        outputCols=[f"{name}_ohe" for name in columns],
        handleInvalid="keep",
    )


def assembler(numeric: list[str], columns: list[str] = CATEGORICAL_FEATURES) -> VectorAssembler:
    """Numbers first, then the one-hot blocks; a missing number becomes NaN."""
    return VectorAssembler(
        inputCols=[*numeric, *[f"{name}_ohe" for name in columns]],
        outputCol="features",
        handleInvalid="keep",
    )


def preprocessing_stages(impute: bool = False) -> list[Stage]:
    """Index, one-hot and assemble.

    ``impute`` fills missing numbers with the column mean first, for the
    estimators that refuse NaN.
    """
    numeric = list(NUMERIC_FEATURES)
    stages: list[Stage] = []
    if impute:
        numeric = [f"{name}{IMPUTED}" for name in NUMERIC_FEATURES]
        stages.append(Imputer(inputCols=NUMERIC_FEATURES, outputCols=numeric, strategy="mean"))
    return [*stages, indexer(), one_hot(), assembler(numeric)]


def encoder(impute: bool = False) -> Pipeline:
    return Pipeline(stages=preprocessing_stages(impute))


def category_order(data: DataFrame, columns: list[str] = CATEGORICAL_FEATURES) -> DataFrame:
    """The fitted index as a table: column_name, value, value_index."""
    model = indexer(columns).fit(data)
    rows = [
        (name, value, position)
        for name, values in zip(columns, model.labelsArray)
        for position, value in enumerate(values)
    ]
    return data.sparkSession.createDataFrame(
        rows, "column_name string, value string, value_index int"
    )


def vector_names(data: DataFrame, column: str = "features") -> list[str]:
    """Slot names of a vector column, in slot order, out of its metadata."""
    groups = data.schema[column].metadata.get("ml_attr", {}).get("attrs", {})
    slots = {slot["idx"]: slot["name"] for group in groups.values() for slot in group}
    return [slots[i].replace(IMPUTED, "") for i in sorted(slots)]


def feature_names(data: DataFrame, column: str = "features") -> DataFrame:
    """The same as a table: slot, feature."""
    return data.sparkSession.createDataFrame(
        list(enumerate(vector_names(data, column))), "slot int, feature string"
    )


def source_column(feature: str) -> str:
    """The input column a vector slot was made from."""
    for name in CATEGORICAL_FEATURES:
        if feature.startswith(f"{name}_ohe"):
            return name
    return feature


def scale_standard(data: DataFrame, columns: list[str], output: str = "scaled") -> DataFrame:
    """Zero mean and unit sample standard deviation, as an array column."""
    model = Pipeline(stages=scaling_stages(columns, output="scaled_vector")).fit(data)
    return (
        model.transform(data)
        .withColumn(output, vector_to_array(F.col("scaled_vector")))
        .drop("scaled_vector", "numbers", *[f"{name}{IMPUTED}" for name in columns])
    )


def scaling_stages(columns: list[str], output: str = "features") -> list[Stage]:
    """Scaling of numbers; a missing one takes the column's mean and so scales to 0."""
    filled = [f"{name}{IMPUTED}" for name in columns]
    return [
        Imputer(inputCols=columns, outputCols=filled, strategy="mean"),
        VectorAssembler(inputCols=filled, outputCol="numbers"),
        StandardScaler(inputCol="numbers", outputCol=output, withMean=True, withStd=True),
    ]
