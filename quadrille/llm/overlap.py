"""Point sets of one split that lie, wholly or for the most part, in another split.

A set's fingerprint is the occupancy of the plane by its points: a long bit
string, one bit a cell, cut into segments of 64 bits, one for each block of
8 x 8 cells that holds a point. Cells of an evaluation set with several points
have them written in binary, in one segment for each binary place, so that
shared bits count points and none hides behind another.

Two points at most `near` apart may still fall in neighbouring cells. So the
fingerprint is taken on three grids, each shifted by a third of a cell along
both axes: a border parts the two in at most one grid per axis, hence at least
one of the three shows them in one cell. If `share` of a set's points have a near
one in another set, at least share / 3 of all its bits are therefore set there
too, and so they are in at least one segment. Hence, and no pair is lost:

1. segments of the same place are joined across the splits, within a Hamming
   radius: at most 1 - share / 3 of the evaluation segment's bits may be missing
   in the training segment;
2. pairs with such a segment add up the shared bits of all their segments, and
   those with fewer than share of the points fall away;
3. the rest are verified point by point.

A place where very many sets have a segment is salted: the segments of both
splits are dealt in parts, and every part of one meets every part of the other in
a task of its own.

Defined cases: null keys and points without both coordinates are left out; a
set without usable points overlaps nothing; a key in both splits pairs with
itself; repeated rows count once; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.session import cut, forget

#: Side of a cell in multiples of the distance (more than three); rows of one place on either side beyond which it is salted.
CELL, SALTED = 12.0, 1024
GRIDS = 3


PLACE = ["grid", "bx", "by"]


def cells(points: DataFrame, near: float) -> DataFrame:
    """(tile_id, grid, bx, by, bit): the cell of each point on each grid. points: tile_id, x, y, a row for each point."""
    size = CELL * near
    at = points.withColumn("grid", F.explode(F.sequence(F.lit(0), F.lit(GRIDS - 1))))
    shift = F.col("grid") * F.lit(size / GRIDS)
    cx, cy = F.floor((F.col("x") + shift) / size), F.floor((F.col("y") + shift) / size)
    return at.select("tile_id", "grid", F.floor(cx / 8).alias("bx"), F.floor(cy / 8).alias("by"), (F.pmod(cx, F.lit(8)) * 8 + F.pmod(cy, F.lit(8))).cast("int").alias("bit"))


def occupied(at: DataFrame) -> DataFrame:
    """(tile_id, grid, bx, by, bits): segments with a bit for every cell that holds a point. Points of a segment meet before the shuffle."""
    return at.groupBy("tile_id", *PLACE).agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits"))


def counted(at: DataFrame) -> DataFrame:
    """(tile_id, grid, bx, by, power, bits): segments for each binary place of the cells' numbers of points."""
    held = at.groupBy("tile_id", *PLACE, "bit").agg(F.count("*").alias("n"))
    power = F.explode(F.expr("filter(sequence(0, 62), p -> (shiftright(n, p) & 1) = 1)")).alias("power")
    return held.select("tile_id", *PLACE, "bit", power).groupBy("tile_id", *PLACE, "power").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits"))


def salted_join(left: DataFrame, right: DataFrame, on: list[str], most: int) -> DataFrame:
    """Inner join in blocks: groups of more than `most` rows are dealt in parts on either side, and each pair of parts is a task's own."""

    def sizes(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*on).count().where(F.col("count") > most).select(*on, F.ceil(F.col("count") / most).alias(name))

    hot = cut(sizes(left, "ls").join(sizes(right, "rs"), on, "full"))
    if hot.isEmpty():
        return left.join(right, on)
    one = lambda c: F.coalesce(c, F.lit(1).cast("long"))
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), one(c) - 1))
    part = lambda df, c: F.pmod(F.xxhash64(*[x for x in df.columns if x not in on]), one(c))
    a = left.join(hot, on, "left").withColumn("i", part(left, "ls")).withColumn("j", every("rs")).drop("ls", "rs")
    b = right.join(hot, on, "left").withColumn("j", part(right, "rs")).withColumn("i", every("ls")).drop("ls", "rs")
    return a.join(b, [*on, "i", "j"]).drop("i", "j")


def overlaps(points: DataFrame, splits: DataFrame, near: float, share: float, train: str = "train") -> DataFrame:
    """(eval_tile, train_tile, eval_split, matched, n): sets of other splits of whose points at least `share` lie within `near` of one of a training set.

    points: tile_id, x, y and whatever tells two points of one place apart; splits: tile_id, split.
    """
    splits = splits.where("tile_id is not null and split is not null").select("tile_id", "split").distinct()
    in_train, in_eval = splits.where(F.col("split") == train).select("tile_id"), splits.where(F.col("split") != train)
    own = points.join(splits.select("tile_id").distinct(), "tile_id", "left_semi")
    own = cut(own.select("tile_id", "x", "y", F.xxhash64(*[c for c in points.columns if c != "tile_id"]).alias("point")).distinct())
    counts = own.groupBy("tile_id").agg(F.count("*").alias("n"))

    one = own.select("tile_id", "x", "y")
    ours = cut(counted(cells(one.join(in_eval.select("tile_id").distinct(), "tile_id", "left_semi"), near)).withColumnsRenamed({"tile_id": "e", "bits": "e_bits"}))
    theirs = cut(occupied(cells(one.join(in_train, "tile_id", "left_semi"), near)).withColumnsRenamed({"tile_id": "t", "bits": "t_bits"}))
    radius = F.floor(F.bit_count("e_bits") * F.lit(1 - share / GRIDS) + 1e-9)
    met = salted_join(ours, theirs, PLACE, SALTED).where((F.col("e") != F.col("t")) & (F.expr("bit_count(e_bits & ~t_bits)") <= radius))
    pairs = cut(met.select("e", "t").distinct())
    shared = pairs.join(ours, "e").join(theirs, ["t", *PLACE]).groupBy("e", "t").agg(F.sum(F.expr("shiftleft(cast(bit_count(e_bits & t_bits) as bigint), power)")).alias("points"))
    shared = shared.join(counts.withColumnRenamed("tile_id", "e"), "e")
    pairs = cut(shared.where(F.col("points") >= F.col("n") * F.lit(share) - 1e-9).select("e", "t", "n"))
    forget(ours), forget(theirs)

    size = 2 * near
    e = pairs.join(own.select(F.col("tile_id").alias("e"), "point", "x", "y"), "e")
    for c, v in (("cx", "x"), ("cy", "y")):
        e = e.withColumn(c, F.explode(F.sequence(F.floor((F.col(v) - near) / size), F.floor((F.col(v) + near) / size))))
    t = own.join(pairs.select(F.col("t").alias("tile_id")).distinct(), "tile_id", "left_semi")
    t = t.select(F.col("tile_id").alias("t"), F.col("x").alias("tx"), F.col("y").alias("ty"), F.floor(F.col("x") / size).alias("cx"), F.floor(F.col("y") / size).alias("cy"))
    dx, dy = F.col("x") - F.col("tx"), F.col("y") - F.col("ty")
    close = salted_join(e, t, ["t", "cx", "cy"], SALTED).where(dx * dx + dy * dy <= near * near)
    # A point may have many near ones: partly counted before the shuffle, each point once.
    matched = close.select("e", "t", "n", "point").distinct().groupBy("e", "t", "n").agg(F.count("*").alias("matched"))
    matched = matched.where(F.col("matched") >= F.col("n") * F.lit(share) - 1e-9)
    both = in_eval.join(in_train, "tile_id").join(counts, "tile_id", "left").select("tile_id", F.col("tile_id").alias("t"), "split", F.col("n").alias("matched"), "n")
    out = matched.join(in_eval.withColumnRenamed("tile_id", "e"), "e").select("e", "t", "split", "matched", "n")
    return out.union(both).toDF("eval_tile", "train_tile", "eval_split", "matched", "n")
