"""Points near other points or inside regions, by adaptive cell coverage.

A region is covered by square cells. A cell wholly inside the region is an
interior cell: every point in it is accepted by the equi-join alone. A cell the
region's border runs through is a boundary cell: its points take an exact test.
Coverage is adaptive: only where points crowd is a cell split into smaller ones,
of which many are interior. Cells that stay crowded (copies of one place) are
salted: the points of a cell are dealt over several tasks and its regions sent
to each of them, so no task holds an unbounded group.

Defined cases: rows with a null key or a missing coordinate match nothing;
repeated rows count once; an empty table gives an empty result; extra columns
are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.session import cut
from quadrille.sources.tables import finite

#: Points of a cell beyond which it is split, and of a smallest cell beyond which it is salted.
CROWDED, SALTED = 32, 2048
#: Times that a region's boundary cells are split in four.
DEPTH = 4
#: Sub-cells to a side of a crowded cell.
FINE = 4


def _keyed(df: DataFrame, key: str, x: str, y: str) -> DataFrame:
    return (
        df.where(F.col(key).isNotNull() & finite(F.col(x)) & finite(F.col(y)))
        .select(F.col(key).alias("key"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
        .distinct()
    )


def _cell(c: Column, size: float) -> Column:
    return F.floor(c / F.lit(size)).cast("long")


def _span(lo: Column, hi: Column) -> Column:
    return F.explode(F.sequence(lo, hi))


def _disc_cover(discs: DataFrame, size: float, r: float) -> DataFrame:
    """Cells (cx, cy) of the given size that a disc touches, with interior true where the cell lies wholly inside."""
    out = discs.withColumn("cx", _span(_cell(F.col("x") - r, size), _cell(F.col("x") + r, size)))
    out = out.withColumn("cy", _span(_cell(F.col("y") - r, size), _cell(F.col("y") + r, size)))
    x0, y0 = F.col("cx") * F.lit(size), F.col("cy") * F.lit(size)
    nx = F.greatest(x0 - F.col("x"), F.col("x") - x0 - size, F.lit(0.0))
    ny = F.greatest(y0 - F.col("y"), F.col("y") - y0 - size, F.lit(0.0))
    fx = F.greatest(F.col("x") - x0, x0 + size - F.col("x"))
    fy = F.greatest(F.col("y") - y0, y0 + size - F.col("y"))
    # A hair of slack on either side: rounding may send a cell to the exact test, never past it.
    return out.where(nx * nx + ny * ny <= r * r * (1 + 1e-9) + 1e-12).withColumn("interior", fx * fx + fy * fy < r * r * (1 - 1e-9))


def pairs_within(points: DataFrame, radius: float, key: str = "key", x: str = "x", y: str = "y") -> DataFrame:
    """Distinct (key_a, key_b), key_a < key_b, of points at most radius apart.

    Each point is read as the disc of that radius; the disc's coverage meets the
    other points by cell. Cells of twice the radius hold sparse places (a disc
    touches four), crowded ones are split in FINE x FINE, whose inner cells lie
    inside the disc and need no distance.
    """
    if not radius > 0:
        raise ValueError("radius must be positive")
    coarse, fine = 2.0 * radius, 2.0 * radius / FINE
    pts = _keyed(points, key, x, y)
    home = pts.withColumn("hx", _cell(F.col("x"), coarse)).withColumn("hy", _cell(F.col("y"), coarse))
    # Written first, so the planner knows how few they are (or are not) before it moves any point.
    crowd = cut(home.groupBy("hx", "hy").count().where(F.col("count") > CROWDED).select("hx", "hy", F.lit(True).alias("crowded")))

    right = home.join(crowd, ["hx", "hy"], "left")
    right = right.select(
        F.col("key").alias("key_b"),
        F.col("x").alias("bx"),
        F.col("y").alias("by"),
        F.coalesce("crowded", F.lit(False)).alias("split"),
        F.when(F.col("crowded"), _cell(F.col("x"), fine)).otherwise(F.col("hx")).alias("cx"),
        F.when(F.col("crowded"), _cell(F.col("y"), fine)).otherwise(F.col("hy")).alias("cy"),
    )
    salts = right.where("split").groupBy("cx", "cy").count().where(F.col("count") > SALTED)
    salts = cut(salts.select("cx", "cy", F.lit(True).alias("split"), F.ceil(F.col("count") / SALTED).cast("int").alias("salts")))
    right = right.join(salts, ["split", "cx", "cy"], "left").withColumn("salt", F.pmod(F.xxhash64("key_b"), F.coalesce("salts", F.lit(1)).cast("long"))).drop("salts")

    cover = _disc_cover(pts, coarse, radius).withColumnsRenamed({"cx": "hx", "cy": "hy"}).drop("interior").join(crowd, ["hx", "hy"], "left")
    sparse = cover.where(F.col("crowded").isNull()).select("key", "x", "y", F.lit(False).alias("split"), F.col("hx").alias("cx"), F.col("hy").alias("cy"), F.lit(False).alias("interior"))
    # A disc's fine cells fall apart by coarse cell; each is made once, by the coarse cell that holds it.
    dense = _disc_cover(cover.where("crowded"), fine, radius)
    dense = dense.where((F.floor(F.col("cx") / FINE) == F.col("hx")) & (F.floor(F.col("cy") / FINE) == F.col("hy")))
    dense = dense.select("key", "x", "y", F.lit(True).alias("split"), "cx", "cy", "interior")
    dense = dense.join(salts, ["split", "cx", "cy"], "left")
    dense = dense.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("salts", F.lit(1)).cast("long") - 1))).drop("salts")
    left = sparse.withColumn("salt", F.lit(0).cast("long")).unionByName(dense)

    dx, dy = F.col("x") - F.col("bx"), F.col("y") - F.col("by")
    return (
        left.join(right, ["split", "cx", "cy", "salt"])
        .where((F.col("key") < F.col("key_b")) & (F.col("interior") | (dx * dx + dy * dy <= radius * radius)))
        .select(F.col("key").alias("key_a"), "key_b")
        .distinct()
    )


def _border_in(x0: np.ndarray, y0: np.ndarray, s: float, xs: np.ndarray, ys: np.ndarray) -> np.ndarray:
    """For each closed cell of side s at (x0, y0): does an edge of the ring touch it? Clips every edge against every cell."""
    dx, dy = np.roll(xs, -1) - xs, np.roll(ys, -1) - ys
    x0, y0 = x0[:, None], y0[:, None]
    t0, t1, ok = np.zeros((len(x0), len(xs))), np.ones((len(x0), len(xs))), np.ones((len(x0), len(xs)), bool)
    for p, q in ((-dx, xs - x0), (dx, x0 + s - xs), (-dy, ys - y0), (dy, y0 + s - ys)):
        ok &= ~((p == 0) & (q < 0))
        with np.errstate(divide="ignore", invalid="ignore"):
            t = q / p
        t0 = np.where(p < 0, np.maximum(t0, t), t0)
        t1 = np.where(p > 0, np.minimum(t1, t), t1)
    return (ok & (t0 <= t1)).any(axis=1)


def cover_polygon(xs: np.ndarray, ys: np.ndarray, depth: int = DEPTH) -> list[tuple[int, int, int, bool]]:
    """Quadtree cells (level, cx, cy, interior) of side 2**level that cover a simple polygon.

    The first level is the one whose cell is about the bounding box; boundary
    cells are split at most depth times. Interior cells are kept as large as
    they come.
    """
    side = max(float(xs.max() - xs.min()), float(ys.max() - ys.min()), 1e-9)
    top = int(np.ceil(np.log2(side)))
    size = 2.0**top
    gx, gy = np.meshgrid(np.arange(np.floor(xs.min() / size), np.floor(xs.max() / size) + 1), np.arange(np.floor(ys.min() / size), np.floor(ys.max() / size) + 1))
    cx, cy, out = gx.ravel(), gy.ravel(), []
    for level in range(top, top - depth - 1, -1):
        s = 2.0**level
        border = _border_in(cx * s, cy * s, s, xs, ys)
        inside = ~border & in_polygon((cx + 0.5) * s, (cy + 0.5) * s, xs, ys)
        out += [(level, int(i), int(j), True) for i, j in zip(cx[inside], cy[inside])]
        cx, cy = cx[border], cy[border]
        if level > top - depth:
            cx = np.concatenate([2 * cx + i for i in (0, 1) for _ in (0, 1)])
            cy = np.concatenate([2 * cy + j for _ in (0, 1) for j in (0, 1)])
    return out + [(top - depth, int(i), int(j), False) for i, j in zip(cx, cy)]


def in_polygon(px: np.ndarray, py: np.ndarray, xs: np.ndarray, ys: np.ndarray) -> np.ndarray:
    """Even-odd test: the lower and left border belong to the polygon, the upper and right one do not."""
    inside = np.zeros(len(px), bool)
    for x1, y1, x2, y2 in zip(xs, ys, np.roll(xs, -1), np.roll(ys, -1)):
        cross = (y1 > py) != (y2 > py)
        if cross.any():
            at = x1 + (py - y1) * (x2 - x1) / (y2 - y1 if y2 != y1 else 1.0)
            inside ^= cross & (px < at)
    return inside


def regions_of_points(points: DataFrame, regions: DataFrame, key: str = "key", x: str = "x", y: str = "y", depth: int = DEPTH) -> DataFrame:
    """Distinct (region_id, key) of every point inside a polygon.

    regions: region_id, xs array<double>, ys array<double> (the ring, unclosed).
    Polygons with fewer than three vertices or a missing one hold no point.
    Coverage cells of all levels meet the points by equi-join; only boundary
    cells carry the ring and take the exact test.
    """
    pts = _keyed(points, key, x, y)
    good = regions.where(F.col("region_id").isNotNull() & (F.size("xs") >= 3) & (F.size("xs") == F.size("ys")))
    good = good.where(F.forall("xs", finite) & F.forall("ys", finite)).select("region_id", F.col("xs").cast("array<double>"), F.col("ys").cast("array<double>"))

    def cover(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for rid, xs, ys in zip(b["region_id"], b["xs"], b["ys"]):
                xs, ys = np.asarray(xs, float), np.asarray(ys, float)
                rows += [(rid, lv, cx, cy, i, None if i else xs, None if i else ys) for lv, cx, cy, i in cover_polygon(xs, ys, depth)]
            yield pd.DataFrame(rows, columns=["region_id", "level", "cx", "cy", "interior", "xs", "ys"])

    kind = regions.schema["region_id"].dataType.simpleString()
    cells = cut(good.mapInPandas(cover, f"region_id {kind}, level int, cx long, cy long, interior boolean, xs array<double>, ys array<double>"))
    # The levels in use are few: one for each power of two between the largest and the smallest cell.
    levels = [r[0] for r in cells.select("level").distinct().collect()]
    if not levels:
        return pts.crossJoin(good.limit(0)).select("region_id", "key")
    at = pts.withColumn("level", F.explode(F.array(*[F.lit(v) for v in sorted(levels)])))
    s = F.pow(F.lit(2.0), F.col("level"))
    at = at.withColumn("cx", F.floor(F.col("x") / s)).withColumn("cy", F.floor(F.col("y") / s))
    place = ["level", "cx", "cy"]
    at = at.join(cells.select(*place).distinct(), place, "left_semi")
    # The points of a crowded cell are dealt over tasks and its regions sent to each of them.
    hot = cut(at.groupBy(*place).count().where(F.col("count") > SALTED).select(*place, F.ceil(F.col("count") / SALTED).alias("salts")))
    one = F.coalesce("salts", F.lit(1).cast("long"))
    at = at.join(hot, place, "left").withColumn("salt", F.pmod(F.xxhash64("key"), one)).drop("salts")
    sent = cells.join(hot, place, "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), one - 1))).drop("salts")
    met = at.join(sent, [*place, "salt"])
    sure = met.where("interior").select("region_id", "key")

    n = F.size("xs")
    i = F.sequence(F.lit(0), n - 1)

    def crosses(k: Column) -> Column:
        x1, y1 = F.get("xs", k), F.get("ys", k)
        x2, y2 = F.get("xs", (k + 1) % n), F.get("ys", (k + 1) % n)
        hit = (y1 > F.col("y")) != (y2 > F.col("y"))
        return F.when(hit, (F.col("x") < x1 + (F.col("y") - y1) * (x2 - x1) / F.when(y2 != y1, y2 - y1).otherwise(1.0)).cast("int")).otherwise(0)

    exact = met.where(~F.col("interior")).where(F.aggregate(F.transform(i, crosses), F.lit(0), lambda a, b: a + b) % 2 == 1).select("region_id", "key")
    return sure.unionByName(exact).distinct()
