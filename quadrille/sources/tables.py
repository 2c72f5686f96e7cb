"""Parquet tables of a data folder, one file or one folder of part files each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def finite(c: Column) -> Column:
    """True for a number that is neither null, NaN nor infinite."""
    d = c.cast("double")
    return d.isNotNull() & ~F.isnan(d) & (F.abs(d) < F.lit(float("inf")))


def nan_to_null(c: Column) -> Column:
    d = c.cast("double")
    return F.when(~F.isnan(d), d)


def clean_split(c: Column) -> Column:
    """Split names trimmed and in lower case; blank names count as missing."""
    s = F.lower(F.trim(c))
    return F.when(s != "", s)


def tile_of_path(path: Column) -> Column:
    """The tile id within any spelling of a path, or null."""
    found = F.regexp_extract(path, r"([A-Z]\d+[A-Z]\d+_x\d+_y\d+)", 1)
    return F.when(found != "", found)


def usable_points(points: DataFrame) -> DataFrame:
    """Distinct (tile_id, point_idx, x, y) with both coordinates; deliveries that repeat a row count once."""
    return (
        points.where(finite(F.col("x")) & finite(F.col("y")) & F.col("tile_id").isNotNull() & F.col("point_idx").isNotNull())
        .select("tile_id", "point_idx", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
        .distinct()
    )
