"""A space for comparing vectors: standardised, turned to their leading principal axes and of length one, fitted on some rows for all."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import PCA, Normalizer, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Principal axes that are kept (a fixed value).
AXES = 25


def fit(rows: DataFrame, vec: str = "vec", axes: int = AXES) -> PipelineModel:
    """The space of the rows (training rows, say): means and deviations, axes, length. Its size depends on the vectors' width alone."""
    v = rows.where(F.col(vec).isNotNull()).select(array_to_vector(F.col(vec).cast("array<double>")).alias("_v"))
    steps = [StandardScaler(inputCol="_v", outputCol="_s", withMean=True), PCA(k=axes, inputCol="_s", outputCol="_p"), Normalizer(inputCol="_p", outputCol="_u")]
    return Pipeline(stages=steps).fit(v)


def place(model: PipelineModel, rows: DataFrame, vec: str = "vec", name: str = "place") -> DataFrame:
    """rows with their place in the space; a null vector has none. A constant coordinate counts as zero."""
    known = model.transform(rows.where(F.col(vec).isNotNull()).withColumn("_v", array_to_vector(F.col(vec).cast("array<double>"))))
    known = known.withColumn(name, vector_to_array("_u")).drop("_v", "_s", "_p", "_u")
    return known.unionByName(rows.where(F.col(vec).isNull()).withColumn(name, F.lit(None).cast("array<double>")))
