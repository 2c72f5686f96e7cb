"""Clusters of similar vectors by grid density.

1. Features, leading principal axes turned at random, are quantised into the
   cells of several shifted grids; cells are counted.
2. Rows of a dense cell (two or more) that are alike are linked, and minimum
   labels travel over the links until they rest.
3. Adjacent cells of a grid, one step apart in one feature, are joined, and those
   that do not hold one label alone already are linked where rows of different
   labels are alike. Labels travel once more.

A cluster's typical members are those in its densest cells.

Equal vectors are one row from the start, whatever their number. Cells are
compared in blocks of BLOCK rows, so no task holds more than two blocks; rows
that are alike to the first row of a crowded cell need no other comparison in it,
and rows of two cells that share the label most frequent there none at all, so a
crowded neighbourhood of one cluster costs a pass over its rows and not its pairs.

The axes are fitted on a bounded sample (SAMPLE rows by hash); all rows are
placed in cells. Alike rows that no grid puts in one cell or in adjacent ones,
nor a chain of other rows connects, are missed: tests measure this against brute
force.

Defined cases: unusable vectors (null, of another width, not finite, all zero)
and rows with a null key belong to no cluster; of several rows with one key the
latest usable one counts, of equally late ones any that is largest; equal
vectors are alike; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from quadrille.llm.components import components
from quadrille.llm.vectors import matrix, rotation
from quadrille.session import cut

#: Sample for the axes; axes kept; features of a grid; grids; width of a cell as a part of the distance of a pair just alike.
SAMPLE, AXES, FEATURES, GRIDS, CELL = 8192, 12, 6, 4, 0.6
#: Rows of a cell that one task compares at once; copies of a vector that one task labels.
BLOCK, COPIES = 1024, 65_536


def unit_rows(rows: DataFrame, key: str, vec: str, late: str) -> DataFrame:
    """key, vec (array<float>, of length one): the latest usable vector of each key."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            places, x = matrix(b.column(2))
            lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(places)), b.column(1).take(pa.array(places)), lists], names=["key", "late", "vec"])

    good = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(late).cast("string").alias("late"), F.col(vec).cast("array<float>").alias("vec"))
    good = good.mapInArrow(run, f"key {kind}, late string, vec array<float>")
    return good.groupBy("key").agg(F.max(F.struct("late", "vec")).getField("vec").alias("vec"))


def _axes(units: DataFrame) -> np.ndarray:
    """Leading principal axes of the sample, one a column. Only its moments come to the driver."""
    sample = units.orderBy(F.xxhash64("key"), "key").limit(SAMPLE).select("vec")

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total, product = 0, 0.0, 0.0
        for b in batches:
            if len(b):
                x = np.stack(b["vec"].to_numpy()).astype(np.float64)
                n, total, product = n + len(x), total + x.sum(axis=0), product + x.T @ x
        if n:
            yield pd.DataFrame({"n": [n], "total": [total.tobytes()], "product": [product.tobytes()]})

    got = sample.mapInPandas(moments, "n bigint, total binary, product binary").collect()
    n = sum(r["n"] for r in got)
    mean = sum(np.frombuffer(r["total"]) for r in got) / n
    product = sum(np.frombuffer(r["product"]) for r in got).reshape(len(mean), -1)
    values, axes = np.linalg.eigh(product / n - np.outer(mean, mean) if n > 1 else np.eye(len(mean)))
    return axes[:, ::-1][:, :AXES].astype(np.float32)


def cells(reps: DataFrame, width: float) -> DataFrame:
    """(key, n, cell, up): each row's cell in every grid and the cells one step up in each feature, as hashes. reps: key, n, vec."""
    axes = _axes(reps)
    turns = np.concatenate([axes @ rotation(100 + g, AXES, FEATURES) for g in range(GRIDS)], axis=1)
    shifts = np.random.default_rng(7).uniform(0, 1, (GRIDS, FEATURES))
    kind = reps.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"key": list(b["key"]), "n": b["n"].to_numpy(), "f": list(np.stack(b["vec"].to_numpy()) @ turns)})

    features = reps.select("key", "n", "vec").mapInPandas(run, f"key {kind}, n bigint, f array<float>")
    grids = []
    for g in range(GRIDS):
        steps = F.array(*[F.floor(F.col("f")[g * FEATURES + i] / F.lit(width) + F.lit(float(shifts[g, i]))) for i in range(FEATURES)])
        grids.append(F.struct(F.lit(g).alias("grid"), steps.alias("q")))
    placed = features.select("key", "n", F.inline(F.array(*grids)))
    up = [F.xxhash64("grid", *[F.col("q")[j] + F.lit(int(i == j)) for j in range(FEATURES)]) for i in range(FEATURES)]
    # Should two cells share a hash, more rows are compared and none is lost.
    return placed.select("key", "n", F.xxhash64("grid", *[F.col("q")[j] for j in range(FEATURES)]).alias("cell"), F.array(*up).alias("up"))


def _links(x: np.ndarray, y: np.ndarray | None, least: float) -> list[tuple[int, int]]:
    """Links from every row to the smallest one it is connected to through alike rows, of x alone or between x and y; y's rows count on from x's."""
    alike = x @ (x if y is None else y).T >= least
    n, m = alike.shape
    if y is None:
        label = np.arange(n)
        while True:
            new = np.minimum(label, np.where(alike, label[None], n).min(axis=1, initial=n))
            if (new == label).all():
                return [(int(label[i]), i) for i in np.nonzero(label != np.arange(n))[0]]
            label = new
    left, right = np.arange(n), np.full(m, n)
    while True:
        new_right = np.minimum(right, np.where(alike, left[:, None], n).min(axis=0, initial=n))
        new_left = np.minimum(left, np.where(alike, new_right[None], n).min(axis=1, initial=n))
        if (new_left == left).all() and (new_right == right).all():
            return [(int(left[i]), i) for i in np.nonzero(left != np.arange(n))[0]] + [(int(right[j]), n + j) for j in np.nonzero(right < n)[0]]
        left, right = new_left, new_right


def _meet(rows: DataFrame, reps: DataFrame, least: float) -> DataFrame:
    """(a, b): links between alike rows that meet. rows: meeting, i, j, side (0 against 1, or 2 among themselves), key."""
    kind = reps.schema["key"].dataType.simpleString()

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["side", "key"], kind="stable")
        x = np.stack(pdf["vec"].to_numpy()).astype(np.float64)
        x /= np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
        keys, split = pdf["key"].to_numpy(), int((pdf["side"] == 0).sum())
        found = _links(x, None, least) if pdf["side"].iloc[0] == 2 else _links(x[:split], x[split:], least)
        out = [(keys[p], keys[q]) for p, q in found if keys[p] != keys[q]]
        return pd.DataFrame({"a": [p for p, _ in out], "b": [q for _, q in out]}, dtype=object)

    return rows.join(reps.select("key", "vec"), "key").groupBy("meeting", "i", "j").applyInPandas(join, f"a {kind}, b {kind}")


def _blocks(n: str) -> Column:
    return F.ceil(F.col(n) / BLOCK)


def _opposed(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows for _meet: every block of the left rows against every block of the right ones. Either has meeting, key, and the sizes l and r of both sides."""
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), _blocks(n) - 1))
    part = lambda n: F.pmod(F.xxhash64("key"), _blocks(n))
    some = (F.col("l") > 0) & (F.col("r") > 0)
    a = left.where(some).select("meeting", "key", part("l").alias("i"), every("r").alias("j"), F.lit(0).alias("side"))
    return a.unionByName(right.where(some).select("meeting", "key", part("r").alias("j"), every("l").alias("i"), F.lit(1).alias("side")))


@F.pandas_udf(DoubleType())
def _cosine(a: pd.Series, b: pd.Series) -> pd.Series:
    if not len(a):
        return pd.Series([], dtype=float)
    x, y = np.stack(a).astype(np.float64), np.stack(b).astype(np.float64)
    return pd.Series(np.einsum("ij,ij->i", x, y) / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y)))


def within(reps: DataFrame, placed: DataFrame, least: float) -> DataFrame:
    """(a, b): links between the alike rows of each dense cell."""
    counted = cut(placed.groupBy("cell").agg(F.count("*").alias("m"), F.min("key").alias("first")).where("m > 1"))
    dense = placed.select("key", "cell").join(counted, "cell")
    small = dense.where(F.col("m") <= BLOCK).select(F.col("cell").alias("meeting"), "key", F.lit(0).cast("bigint").alias("i"), F.lit(0).cast("bigint").alias("j"), F.lit(2).alias("side"))
    crowded = counted.where(F.col("m") > BLOCK)
    if crowded.isEmpty():
        return _meet(small, reps, least)
    centres = cut(crowded.join(reps.select(F.col("key").alias("first"), F.col("vec").alias("centre")), "first").select("cell", "m", "first", "centre"))
    held = placed.select("key", "cell").join(centres, "cell").join(reps.select("key", "vec"), "key")
    held = cut(held.select("key", "cell", "m", "first", (_cosine("vec", "centre") >= least).alias("alike")))
    star = held.where("alike and key <> first").select(F.col("first").alias("a"), F.col("key").alias("b"))
    rest = held.where("not alike").groupBy("cell").agg(F.count("*").alias("l"))
    sized = held.join(rest, "cell").select(F.col("cell").alias("meeting"), "key", "alike", "l", F.col("m").alias("r"))
    return _meet(small.unionByName(_opposed(sized.where("not alike"), sized)), reps, least).unionByName(star)


def between(reps: DataFrame, placed: DataFrame, label: DataFrame, least: float) -> DataFrame:
    """(a, b): links between alike rows of adjacent cells that hold more than one label. label: node, component."""
    rows = placed.join(label.toDF("key", "label"), "key", "left").select("key", "cell", "up", F.coalesce("label", "key").alias("label"))
    rows = cut(rows)
    per = cut(rows.groupBy("cell", "label").agg(F.count("*").alias("n"), F.first("up").alias("up")))
    held = per.groupBy("cell").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.sum("n").alias("n"), F.max(F.struct("n", "label")).alias("top"), F.first("up").alias("up"))
    held = cut(held.select("cell", "lo", "hi", "n", F.col("top.label").alias("top"), F.col("top.n").alias("n_top"), "up"))
    a = held.select(F.col("cell").alias("a"), F.col("lo").alias("a_lo"), F.col("hi").alias("a_hi"), F.col("n").alias("a_n"), "top", F.col("n_top").alias("a_top"), F.explode("up").alias("b"))
    b = held.select(F.col("cell").alias("b"), F.col("lo").alias("b_lo"), F.col("hi").alias("b_hi"), F.col("n").alias("b_n"))
    pairs = a.join(b, "b").where("a <> b and not (a_lo = a_hi and b_lo = b_hi and a_lo = b_lo)")
    pairs = pairs.join(per.select(F.col("cell").alias("b"), F.col("label").alias("top"), F.col("n").alias("b_top")), ["b", "top"], "left")
    pairs = cut(pairs.select("a", "b", "top", "a_n", "b_n", "a_top", F.coalesce("b_top", F.lit(0)).alias("b_top"), F.xxhash64("a", "b").alias("meeting")))
    rows = rows.select("key", "cell", "label")
    at_a, at_b = pairs.join(rows.withColumnRenamed("cell", "a"), "a"), pairs.join(rows.withColumnRenamed("cell", "b"), "b")
    # All rows of b against those of a without the label most frequent in a; then those with it against what has another one in b.
    one = [F.col("meeting"), F.col("key"), (F.col("a_n") - F.col("a_top")).alias("l"), F.col("b_n").alias("r")]
    two = [F.xxhash64("meeting").alias("meeting"), F.col("key"), (F.col("b_n") - F.col("b_top")).alias("l"), F.col("a_top").alias("r")]
    first = _opposed(at_a.where("label <> top").select(*one), at_b.select(*one))
    second = _opposed(at_b.where("label <> top").select(*two), at_a.where("label = top").select(*two))
    return _meet(first.unionByName(second), reps, least)


def cluster(rows: DataFrame, least: float, smallest: int = 3, key: str = "tile_id", vec: str = "vec", late: str = "ingested_at") -> tuple[DataFrame, DataFrame]:
    """((key, cluster_id, density), cells): the members of all clusters of at least smallest rows.

    cluster_id is the smallest key; density counts, over all grids, the rows
    that share a member's cell.
    """
    units = cut(unit_rows(rows, key, vec, late))
    if units.isEmpty():
        empty = units.select("key", F.col("key").alias("cluster_id"), F.lit(0).cast("bigint").alias("density")).limit(0)
        return empty.withColumnRenamed("key", key), empty
    same = [F.xxhash64("vec").alias("h1"), F.hash("vec").alias("h2")]
    groups = cut(units.select(F.struct("key", "vec").alias("r"), *same).groupBy("h1", "h2").agg(F.min("r").alias("r"), F.count("*").alias("n")))
    reps = groups.select("r.key", "r.vec", "n")
    placed = cut(cells(reps, CELL * math.sqrt(2 - 2 * least)))
    first = cut(within(reps, placed, least))
    label = cut(components(first))
    second = cut(between(reps, placed, label, least))
    # What the first labels join stays one node.
    links = second.unionByName(label.select(F.col("component").alias("a"), F.col("node").alias("b")))
    label = components(links)
    several = groups.where("n > 1").select("h1", "h2", F.col("r.key").alias("rep"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("n") / COPIES))).alias("salt"), F.floor(F.col("n") / COPIES + 1).alias("salts"))
    salts = several.groupBy("h1", "h2").agg(F.max("salts").alias("salts"))
    copied = units.select("key", *same).join(salts, ["h1", "h2"]).withColumn("salt", F.pmod(F.xxhash64("key"), "salts"))
    copied = copied.join(several.drop("salts"), ["h1", "h2", "salt"]).where("key <> rep").select("rep", "key")
    alone = groups.where("n > 1").select(F.col("r.key").alias("node"), F.col("r.key").alias("component"))
    label = cut(label.unionByName(alone.join(label.select("node"), "node", "left_anti")))
    label = label.unionByName(copied.join(label.withColumnRenamed("node", "rep"), "rep").select(F.col("key").alias("node"), "component"))
    label = cut(label)
    sizes = label.groupBy("component").count().where(F.col("count") >= smallest).select("component")
    members = label.join(sizes, "component").select(F.col("node").alias("key"), F.col("component").alias("cluster_id"))
    counted = placed.groupBy("cell").agg(F.sum("n").alias("rows"))
    density = placed.join(counted, "cell").groupBy("key").agg(F.sum("rows").alias("density"))
    density = cut(density.unionByName(copied.join(density.withColumnRenamed("key", "rep"), "rep").select("key", "density")))
    return members.join(density, "key").withColumnRenamed("key", key), placed


def describe(members: DataFrame, anchors: DataFrame, typical: int = 3, key: str = "tile_id") -> DataFrame:
    """(cluster_id, size, typical_tiles, commonest_anchor) of each cluster; ties go to the smaller key or anchor.

    anchors: key, anchor; rows with a null anchor do not count and repeated ones count once.
    """
    ranked = members.select("cluster_id", F.struct((-F.col("density")).alias("d"), F.col(key).alias("k")).alias("s"))
    # Only the best of each task's rows travel, so a cluster of any size needs no more room than its report.
    best = ranked.groupBy("cluster_id").agg(F.count("*").alias("size"))
    top = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("cluster_id").orderBy("s"))).where(F.col("rank") <= typical)
    top = top.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["k"]).alias("typical_tiles"))
    votes = members.join(anchors.where("anchor is not null").select(F.col(key), "anchor").distinct(), key).groupBy("cluster_id", "anchor").count()
    common = votes.groupBy("cluster_id").agg(F.max(F.struct("count", (-F.col("anchor")).alias("a"))).alias("m")).select("cluster_id", (-F.col("m.a")).cast("int").alias("commonest_anchor"))
    return best.join(top, "cluster_id").join(common, "cluster_id", "left")
