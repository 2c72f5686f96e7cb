"""Samples that are the same in every run: rows are ordered by hashes of their keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrille.functions.hashing import uniform


def order(*keys: Column | str, seed: int = 0) -> Column:
    return F.md5(F.concat_ws("|", *keys, F.lit(str(seed))))


def per_group(df: DataFrame, by: Sequence[str], keys: Sequence[str], k: int, seed: int = 0) -> DataFrame:
    """At most k rows of each group, without replacement. Only each task's first k travel."""
    w = Window.partitionBy(*by).orderBy(order(*by, *keys, seed=seed), *keys)
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).drop("place")


def weighted(df: DataFrame, by: Sequence[str], keys: Sequence[str], weight: Column, k: int, seed: int = 0) -> DataFrame:
    """k rows of each group without replacement, drawn in proportion to a positive weight (the smallest exponential clocks win)."""
    clock = -F.log(uniform(*[F.col(c).cast("string") for c in (*by, *keys)], F.lit(str(seed)))) / weight
    rows = df.withColumn("clock", F.when(weight > 0, clock)).where("clock is not null")
    w = Window.partitionBy(*by).orderBy("clock", *keys)
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).drop("place", "clock")


def balanced(df: DataFrame, by: Sequence[str], label: str, keys: Sequence[str], cap: int, seed: int = 0) -> DataFrame:
    """At most cap rows of each group, taken from its classes in turn, as evenly as they last."""
    inner = Window.partitionBy(*by, label).orderBy(order(*by, label, *keys, seed=seed), *keys)
    turns = df.withColumn("turn", F.row_number().over(inner)).where(F.col("turn") <= cap)
    outer = Window.partitionBy(*by).orderBy("turn", label)
    return turns.withColumn("place", F.row_number().over(outer)).where(F.col("place") <= cap).drop("turn", "place")
