"""Joins of tables that must agree on their keys, and the checks behind them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("tile_id", "split")


def duplicates(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """keys, count of the keys that occur more than once."""
    return df.groupBy(*keys).count().where(F.col("count") > 1)


def key_difference(a: DataFrame, b: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """keys, side: keys of one table that the other lacks ('left' or 'right'); null keys equal each other."""
    one = a.select(*keys).distinct().withColumn("l", F.lit(1)).unionByName(b.select(*keys).distinct().withColumn("l", F.lit(2)))
    seen = one.groupBy(*keys).agg(F.sum("l").alias("l")).where("l < 3")
    return seen.select(*keys, F.when(F.col("l") == 1, "left").otherwise("right").alias("side"))


def audit(a: DataFrame, b: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """One row of counts: null keys, repeated keys and keys that only one side has."""
    null = " or ".join(f"{k} is null" for k in keys)

    def sides(df: DataFrame, side: str) -> DataFrame:
        return df.groupBy(*keys).count().agg(
            F.coalesce(F.sum(F.when(F.expr(null), F.col("count"))), F.lit(0)).alias(f"{side}_null"), F.count_if(F.col("count") > 1).alias(f"{side}_repeated")
        )

    apart = key_difference(a, b, keys).agg(F.count_if(F.col("side") == "left").alias("left_only"), F.count_if(F.col("side") == "right").alias("right_only"))
    return sides(a, "left").crossJoin(sides(b, "right")).crossJoin(apart)  # three single rows


def strict_join(a: DataFrame, b: DataFrame, keys: Sequence[str] = KEYS, allow_extra: bool = False) -> DataFrame:
    """a with b's columns, one row for each of a's; raises unless both have the same unique, non-null keys (b may have more if allowed)."""
    found = audit(a, b, keys).first().asDict()
    wrong = {k: v for k, v in found.items() if v and not (allow_extra and k == "right_only")}
    if wrong:
        raise ValueError(f"tables do not share their keys: {wrong}")
    return a.join(b, list(keys))


def checked_join(a: DataFrame, b: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """strict_join within one plan: the rows themselves raise when the query runs.

    The check rides on the join's own partitioning (a full join, then counts by
    the same keys), so no table is read twice and nothing more is shuffled.
    """
    left, right = a.withColumn("_l", F.lit(True)), b.withColumn("_r", F.lit(True))
    j = left.join(right, list(keys), "full").withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    whole = F.col("_l").isNotNull() & F.col("_r").isNotNull() & (F.col("_n") == 1)
    fail = F.raise_error(F.concat(F.lit("tables do not share their keys at "), F.coalesce(F.concat_ws(", ", *keys), F.lit("null")))).cast("boolean")
    return j.where(F.when(whole, True).otherwise(fail)).drop("_l", "_r", "_n")


def assemble(tables: Mapping[str, DataFrame], keys: Sequence[str] = KEYS) -> DataFrame:
    """All columns of any number of tables in one row a key; the rows raise when the query runs unless every table holds each key once.

    The tables are stacked and shuffled together once, whatever their number.
    Their columns must have different names beside the keys.
    """
    names = [c for t in tables.values() for c in t.columns if c not in keys]
    if len(names) != len(set(names)):
        raise ValueError(f"columns {sorted({c for c in names if names.count(c) > 1})} are in several tables")
    stacked = None
    for i, t in enumerate(tables.values()):
        one = t.withColumn("_t", F.lit(i))
        stacked = one if stacked is None else stacked.unionByName(one, allowMissingColumns=True)
    counts = [F.count_if(F.col("_t") == i).alias(f"_n{i}") for i in range(len(tables))]
    # A key's columns come from one row each: the largest value is the only one that is not null.
    one = stacked.groupBy(*keys).agg(*[F.max(c).alias(c) for c in names], *counts)
    bad = [F.when((F.col(f"_n{i}") != 1) | F.col(keys[0]).isNull(), F.lit(n)) for i, n in enumerate(tables)]
    where = F.concat(F.lit("tables do not share the key "), F.coalesce(F.concat_ws(", ", *keys), F.lit("null")), F.lit(": "), F.concat_ws(", ", *bad))
    whole = F.concat_ws("", *bad) == ""
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    return one.where(F.when(whole, True).otherwise(F.raise_error(where).cast("boolean"))).select(*keys, *names)
