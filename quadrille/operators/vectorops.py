"""Vectors of tiles against few anchors, against a library in blocks, and their spread within a tile."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

#: Vectors in a block of a library, and most rows of a table of anchors.
BLOCK, ANCHORS = 1024, 256


def usable(vec: Column, width: int = 256) -> Column:
    """Exactly width finite numbers that are not all zero."""
    fine = F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce((F.size(vec) == width) & fine & F.exists(vec, lambda v: v != 0), F.lit(False))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def anchor_distances(vectors: DataFrame, anchors: DataFrame, key: str) -> DataFrame:
    """key, anchor, distance, margin: the nearest of the anchors by cosine distance, and how much farther the second is.

    anchors: anchor, vec; a small fixed table, whose size is checked.
    """
    rows = anchors.where("anchor is not null and vec is not null").orderBy("anchor").limit(ANCHORS + 1).collect()
    if len(rows) > ANCHORS:
        raise ValueError(f"more than {ANCHORS} anchors; use nearest_in_library")
    kind = vectors.schema[key].dataType.simpleString()
    if not rows:
        return vectors.select(key, F.lit(None).cast("int").alias("anchor"), F.lit(None).cast("double").alias("distance"), F.lit(None).cast("double").alias("margin")).limit(0)
    names, library = np.array([r["anchor"] for r in rows]), _unit(np.array([r["vec"] for r in rows]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                d = 1 - _unit(np.stack(b["vec"].to_numpy())) @ library.T
                order = np.argsort(d, axis=1, kind="stable")
                first = np.take_along_axis(d, order[:, :1], 1)[:, 0]
                second = np.take_along_axis(d, order[:, 1:2], 1)[:, 0] if d.shape[1] > 1 else np.full(len(d), np.nan)
                yield pd.DataFrame({"key": list(b[key]), "anchor": names[order[:, 0]], "distance": first, "margin": second - first})

    got = vectors.select(key, "vec").mapInPandas(run, f"key {kind}, anchor int, distance double, margin double")
    return got.withColumnRenamed("key", key)


def isolation(queries: DataFrame, library: DataFrame, key: str, k: int) -> DataFrame:
    """key, isolation: mean cosine distance of each query to its k nearest library vectors other than its own.

    Queries and library meet in blocks of vectors: each pair of blocks is one
    small product whose k best per query alone go on, so no list of all pairs
    ever exists.
    """

    def blocks(df: DataFrame, side: str) -> DataFrame:
        n = df.count()
        b = F.pmod(F.xxhash64(key), F.lit(max(1, -(-n // BLOCK))))
        return df.groupBy(b.alias(f"{side}_block")).agg(F.collect_list(F.struct(F.col(key).alias("k"), "vec")).alias(side))

    kind = queries.schema[key].dataType.simpleString()

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for q, lib in zip(b["q"], b["lib"]):
                qk, lk = np.array([r["k"] for r in q], object), np.array([r["k"] for r in lib], object)
                d = 1 - np.clip(_unit(np.stack([r["vec"] for r in q])) @ _unit(np.stack([r["vec"] for r in lib])).T, -1, 1)
                d[qk[:, None] == lk[None]] = np.inf
                take = min(k, d.shape[1])
                near = np.partition(d, take - 1, axis=1)[:, :take]
                keep = np.isfinite(near)
                i = np.nonzero(keep)[0]
                yield pd.DataFrame({"key": list(qk[i]), "d": near[keep]})

    met = blocks(queries, "q").join(blocks(library, "lib"))  # blocks of vectors against blocks
    pairs = met.select("q", "lib").repartition(met.sparkSession.sparkContext.defaultParallelism).mapInPandas(best, f"key {kind}, d double")
    w = Window.partitionBy("key").orderBy("d")
    near = pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return near.groupBy(F.col("key").alias(key)).agg(F.avg("d").alias("isolation"))


@F.pandas_udf(ArrayType(DoubleType()))
def _pooled(vecs: pd.Series) -> pd.Series:
    """RMS of the residuals from the mean, RMS of the vectors, and the Gini of the residuals' norms."""
    out = []
    for v in vecs:
        x = np.stack(v).astype(np.float64)
        r = np.sqrt(((x - x.mean(axis=0)) ** 2).sum(axis=1))
        s = np.sort(r)
        total = s.sum()
        g = 2 * (s * np.arange(1, len(s) + 1)).sum() / (len(s) * total) - (len(s) + 1) / len(s) if total > 0 else np.nan
        out.append([float(np.sqrt((r * r).mean())), float(np.sqrt((x * x).sum(axis=1).mean())), float(g)])
    return pd.Series(out)


def dispersion(cells: DataFrame, key: str) -> DataFrame:
    """key, dispersion, gini: spread of a tile's cell vectors (at most 64) around their mean; null for fewer than two."""
    g = cells.groupBy(key).agg(F.collect_list("vec").alias("vecs")).where(F.size("vecs") >= 2).select(key, _pooled("vecs").alias("p"))
    return g.select(key, (F.col("p")[0] / F.greatest(F.col("p")[1], F.lit(1e-12))).alias("dispersion"), F.nanvl(F.col("p")[2], F.lit(None).cast("double")).alias("gini"))
