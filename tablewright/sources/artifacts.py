"""Small result tables ("artifacts") as JSON, and fitted models."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..functions.types import clean_value


def write_artifact(df: DataFrame, path: str) -> None:
    """Write a result table as JSON lines, NaN as null, nulls kept as keys."""
    clean = df.select(*[clean_value(f).alias(f.name) for f in df.schema])
    clean.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_artifact(spark: SparkSession, path: str, schema: str | T.StructType, default: DataFrame | None = None) -> DataFrame:
    """Read an artifact; a missing one gives ``default``, or an error without it."""
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in (error.getCondition() or str(error)):
            raise
        if default is None:
            raise FileNotFoundError(path) from error
        return default


def save_model(model: PipelineModel, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
