"""A tile's points in 8 x 8 cells, and statistics over cells and their neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells to a side, side of a tile in metres, points that make a cell count (fixed values).
SIDE, TILE, SUPPORT = 8, 7000.0, 5


def _place(c: Column, centre: Column) -> Column:
    at = F.floor((c - centre + TILE / 2) / TILE * SIDE)
    return F.least(F.greatest(at, F.lit(0)), F.lit(SIDE - 1)).cast("int")


def binned(points: DataFrame, counts: Column | None = None) -> DataFrame:
    """points with bin = row * 8 + column, centred on the mean of the points that count (all by default), which alone are kept."""
    rows = points.where(counts) if counts is not None else points
    centre = rows.groupBy("tile_id").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    placed = rows.join(centre, "tile_id")
    return placed.withColumn("bin", _place(F.col("y"), F.col("my")) * SIDE + _place(F.col("x"), F.col("mx"))).drop("mx", "my")


def cell_name(c: Column) -> Column:
    return F.concat(F.lit("r"), F.floor(c / SIDE).cast("string"), F.lit("c"), (c % SIDE).cast("string"))


def top_cell(cells: DataFrame, value: str) -> DataFrame:
    """tile_id, bin, value of the cell with the largest value; ties go to more points, then the lower bin. cells: tile_id, bin, n, value."""
    best = cells.groupBy("tile_id").agg(F.max(F.struct(F.col(value).alias("v"), "n", (-F.col("bin")).alias("b"))).alias("m"))
    return best.select("tile_id", (-F.col("m.b")).alias("bin"), F.col("m.v").alias(value))


def neighbour_steps(cells: DataFrame, value: str) -> DataFrame:
    """tile_id, bin, other, place, step: |difference| between each cell and its right and lower neighbour; place orders the pairs."""
    right = cells.select("tile_id", F.col("bin").alias("other"), F.col(value).alias("w"))
    ways = F.array(F.struct(F.lit(1).alias("by"), F.lit(0).alias("way")), F.struct(F.lit(SIDE).alias("by"), F.lit(1).alias("way")))
    out = cells.withColumn("d", F.explode(ways)).where((F.col("d.way") == 1) | (F.col("bin") % SIDE < SIDE - 1)).withColumn("other", F.col("bin") + F.col("d.by"))
    met = out.join(right, ["tile_id", "other"])
    return met.select("tile_id", "bin", "other", (F.col("bin") * 2 + F.col("d.way")).alias("place"), F.abs(F.col(value) - F.col("w")).alias("step"))
