"""Exact statistics by group that hold no group in memory.

Percentiles go over counted values: equal values are added up before the
shuffle, and a running sum over a group's sorted values (a stream that spills,
whatever the group's size) finds the ranks. Nulls and NaN never count.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrille.session import cut
from quadrille.sources.tables import nan_to_null


def percentiles(df: DataFrame, by: Sequence[str], values: Mapping[str, Column], qs: Sequence[float]) -> DataFrame:
    """One row per group: columns `<name>_p<100q>` with linear interpolation between ranks; groups without any value are absent.

    All values go through one shuffle: they are stacked under their names.
    """
    stack = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), nan_to_null(c).alias("v")) for n, c in values.items()]))
    long = df.select(*by, stack.alias("s")).select(*by, "s.name", "s.v").where("v is not null")
    counted = long.groupBy(*by, "name", "v").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*by, "name").orderBy("v")
    upto = F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))
    totals = counted.groupBy(*by, "name").agg(F.sum("n").alias("total"))
    ranked = counted.withColumn("upto", upto).join(totals, [*by, "name"])

    def at(rank: Column) -> Column:
        return F.min(F.when(F.col("upto") > rank, F.col("v")))

    cols = []
    for q in qs:
        pos = (F.col("total") - 1) * F.lit(float(q))
        low, high = F.floor(pos), F.ceil(pos)
        cols += [at(low).alias(f"lo{q}"), at(high).alias(f"hi{q}"), F.first(pos - low).alias(f"fr{q}")]
    got = ranked.groupBy(*by, "name").agg(*cols)
    got = got.select(*by, "name", *[(F.col(f"`lo{q}`") + (F.col(f"`hi{q}`") - F.col(f"`lo{q}`")) * F.col(f"`fr{q}`")).alias(tag(q)) for q in qs])
    wide = [F.max(F.when(F.col("name") == n, F.col(tag(q)))).alias(f"{n}_{tag(q)}") for n in values for q in qs]
    return got.groupBy(*by).agg(*wide)


def running(df: DataFrame, order: Sequence[str], value: str, name: str) -> tuple[DataFrame, int]:
    """(df with the inclusive running total of value along order, the whole total), by ranges of the order.

    Each range adds up its own rows; only the ranges' totals, a number for each
    task, come to the driver.
    """
    ranged = cut(df.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    sums = sorted((r["part"], r["s"]) for r in ranged.groupBy("part").agg(F.sum(value).alias("s")).collect())
    before, total = [], 0
    for part, s in sums:
        before.append((part, total))
        total += s or 0
    ahead = df.sparkSession.createDataFrame(before, "part int, before bigint")
    here = F.sum(value).over(Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    out = ranged.withColumn("here", here).join(ahead, "part").withColumn(name, F.col("here") + F.col("before"))
    return out.drop("part", "here", "before"), total


def whole_percentiles(df: DataFrame, value: str, qs: Sequence[float]) -> DataFrame:
    """One row of percentiles() over all rows, by ranges of the values instead of one group's task; null columns where there is no value."""
    counted = df.select(nan_to_null(F.col(value)).alias("v")).where("v is not null").groupBy("v").agg(F.count("*").alias("n"))
    upto, total = running(counted, ["v"], "n", "upto")
    cols = []
    for q in qs:
        pos = (total - 1) * float(q)
        low, high = (F.min(F.when(F.col("upto") > int(f(pos)), F.col("v"))) for f in (math.floor, math.ceil))
        cols.append((low + (high - low) * (pos - math.floor(pos))).alias(f"{value}_{tag(q)}"))
    return upto.agg(*cols)


def tag(q: float) -> str:
    return f"p{round(q * 1000) / 10:g}".replace(".", "_")


def gini(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """by, gini: of non-negative values; 0 for fewer than two values or a sum of 0."""
    known = df.where(nan_to_null(F.col(value)).isNotNull()).select(*by, F.greatest(nan_to_null(F.col(value)), F.lit(0.0)).alias("v"))
    ranked = known.withColumn("i", F.row_number().over(Window.partitionBy(*by).orderBy("v")))
    g = ranked.groupBy(*by).agg(F.count("*").alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("i")).alias("si"))
    return g.select(*by, F.when((F.col("n") >= 2) & (F.col("s") > 0), 2 * F.col("si") / (F.col("n") * F.col("s")) - (F.col("n") + 1) / F.col("n")).otherwise(0.0).alias("gini"))


def train_quantiles(df: DataFrame, columns: Mapping[str, Sequence[float]], split: str = "split", pool: Sequence[str] = ("train",)) -> DataFrame:
    """One row with `<column>_p<100q>` over the rows of the pool: class borders that other rows are held against."""
    rows, out = df.where(F.col(split).isin(*pool)), None
    for c, qs in columns.items():
        one = whole_percentiles(rows, c, qs)
        out = one if out is None else out.join(F.broadcast(one))
    return out


def percentile_ranks(df: DataFrame, key: str, value: str, train: Column, midrank: bool = False) -> DataFrame:
    """key, rank: where each value stands among the training values.

    Tied with training values: the mean of its first and last place over the
    count; else the count of training values below over the count. With midrank
    ((below + up to) / 2 + 0.5) / count, at most 1, for all. Missing values have
    no rank.
    """
    rows = df.select(key, nan_to_null(F.col(value)).alias("v"), train.alias("t")).where("v is not null")
    # Ranks are taken over counted values, so equal values meet before the sort.
    counted = rows.groupBy("v").agg(F.count_if("t").alias("n"))
    upto, total = running(counted, ["v"], "n", "right")
    joined = rows.join(upto.select("v", "right", (F.col("right") - F.col("n")).alias("left")), "v").withColumn("total", F.lit(total))
    left, right, n = F.col("left"), F.col("right"), F.nullif(F.col("total"), F.lit(0))
    if midrank:
        rank = F.least(((left + right) / 2 + 0.5) / n, F.lit(1.0))
    else:
        rank = F.when(right > left, (left + 1 + right) / (2 * n)).otherwise(right / n)
    return joined.select(key, rank.alias("rank"))
