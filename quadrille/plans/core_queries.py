"""Queries of the general data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.operators import near, packing
from quadrille.sources.tables import finite, table

POINT_RADIUS, TILE_RADIUS = 4.4, 1500.0


def manifest_centres(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "split_manifest")
    x, y = F.col("centroid_x"), F.col("centroid_y")
    return m.where(finite(x) & finite(y) & ~((x == 0) & (y == 0))).select(F.col("tile_id").alias("key"), x.alias("x"), y.alias("y"))


def keyed_points(spark: SparkSession, sf: str) -> DataFrame:
    """Usable points under their keys; the operators count repeated rows once."""
    p = table(spark, sf, "tile_points").where("tile_id is not null and point_idx is not null")
    return p.where(finite(F.col("x")) & finite(F.col("y"))).select(F.concat_ws("#", "tile_id", "point_idx").alias("key"), "x", "y")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Points at most 4.4 m apart and tile centres at most 1,500 m apart."""
    points = near.pairs_within(keyed_points(spark, sf), POINT_RADIUS).select(F.lit("point").alias("kind"), "key_a", "key_b")
    tiles = near.pairs_within(manifest_centres(spark, sf), TILE_RADIUS).select(F.lit("tile").alias("kind"), "key_a", "key_b")
    return points.unionByName(tiles)


def tile_squares(spark: SparkSession, sf: str) -> DataFrame:
    """The 7 km square of every tile of the manifest, from the corner in its id."""
    corner = (
        table(spark, sf, "split_manifest").select("tile_id").distinct()
        .select(F.col("tile_id").alias("region_id"), F.regexp_extract("tile_id", r"_x(\d+)_", 1).try_cast("double").alias("x0"), F.regexp_extract("tile_id", r"_y(\d+)$", 1).try_cast("double").alias("y0"))
        .where("x0 is not null and y0 is not null")
    )
    return corner.select("region_id", F.expr("array(x0, x0 + 7000D, x0 + 7000D, x0)").alias("xs"), F.expr("array(y0, y0, y0 + 7000D, y0 + 7000D)").alias("ys"))


def p2_points_in_tiles(spark: SparkSession, sf: str) -> DataFrame:
    """How many usable points lie within the square of each tile, whichever tile they were filed under."""
    met = near.regions_of_points(keyed_points(spark, sf), tile_squares(spark, sf))
    return met.groupBy("region_id").agg(F.count("*").alias("n_points"))


def p7_archive(spark: SparkSession, sf: str) -> DataFrame:
    """The index of the packed files."""
    return packing.index(packing.scratch_archive(table(spark, sf, "tile_files")))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return packing.same_records(packing.scratch_archive(table(spark, sf, "tile_files")))


def p7_records(spark: SparkSession, sf: str) -> DataFrame:
    return packing.consolidated(packing.scratch_archive(table(spark, sf, "tile_files")))


QUERIES = {f.__name__: f for f in (p2_found, p2_points_in_tiles, p7_archive, p7_found, p7_records)}

_POINTS = """SELECT DISTINCT tile_id, point_idx, CAST(x AS DOUBLE) x, CAST(y AS DOUBLE) y FROM tile_points
  WHERE x IS NOT NULL AND y IS NOT NULL AND isfinite(x) AND isfinite(y) AND tile_id IS NOT NULL AND point_idx IS NOT NULL"""

ORACLE = {
    "p2_found": f"""
WITH pts AS (SELECT tile_id || '#' || point_idx AS k, x, y FROM ({_POINTS})),
c AS (SELECT *, CAST(floor(x / 4.4) AS BIGINT) cx, CAST(floor(y / 4.4) AS BIGINT) cy FROM pts),
n AS (SELECT k, x, y, cx + i AS cx, cy + j AS cy FROM c, (SELECT unnest([-1, 0, 1]) i), (SELECT unnest([-1, 0, 1]) j)),
t AS (SELECT DISTINCT tile_id k, centroid_x x, centroid_y y FROM split_manifest
  WHERE isfinite(centroid_x) AND isfinite(centroid_y) AND NOT (centroid_x = 0 AND centroid_y = 0) AND tile_id IS NOT NULL)
SELECT DISTINCT 'point' AS kind, n.k AS key_a, c.k AS key_b FROM n JOIN c USING (cx, cy)
  WHERE n.k < c.k AND (n.x - c.x) * (n.x - c.x) + (n.y - c.y) * (n.y - c.y) <= 4.4 * 4.4
UNION ALL
SELECT DISTINCT 'tile', a.k, b.k FROM t a JOIN t b ON a.k < b.k
  WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 1500.0 * 1500.0""",
    "p2_points_in_tiles": f"""
WITH pts AS ({_POINTS}),
t AS (SELECT DISTINCT tile_id, CAST(regexp_extract(tile_id, '_x(\\d+)_', 1) AS DOUBLE) x0, CAST(regexp_extract(tile_id, '_y(\\d+)$', 1) AS DOUBLE) y0 FROM split_manifest WHERE tile_id IS NOT NULL)
SELECT t.tile_id AS region_id, count(*) AS n_points FROM t JOIN pts ON x >= x0 AND x < x0 + 7000 AND y >= y0 AND y < y0 + 7000 GROUP BY 1""",
    "p7_found": """
WITH f AS (SELECT DISTINCT file_id, coalesce(tile_id, regexp_extract(path, '([A-Z]\\d+[A-Z]\\d+_x\\d+_y\\d+)', 1)) tile_id, content FROM tile_files),
l AS (SELECT file_id, tile_id, unnest(string_split_regex(coalesce(content, ''), '[\\r\\n]+')) s FROM f),
n AS (SELECT file_id, tile_id, regexp_extract_all(regexp_replace(s, '"[a-z_]+"', '', 'g'), '[-+]?\\d+(?:\\.\\d+)?') v FROM l WHERE regexp_matches(s, '\\d')),
r AS (SELECT file_id, tile_id, list_sort(list(DISTINCT [CAST(v[1] AS DOUBLE), CAST(v[2] AS DOUBLE), CAST(v[3] AS DOUBLE)])) recs FROM n WHERE len(v) = 3 GROUP BY 1, 2)
SELECT DISTINCT a.file_id AS file_a, b.file_id AS file_b FROM r a JOIN r b ON a.tile_id = b.tile_id AND a.recs = b.recs AND a.file_id < b.file_id""",
    "p7_records": """
WITH f AS (SELECT DISTINCT file_id, coalesce(tile_id, regexp_extract(path, '([A-Z]\\d+[A-Z]\\d+_x\\d+_y\\d+)', 1)) tile_id, content FROM tile_files),
l AS (SELECT tile_id, unnest(string_split_regex(coalesce(content, ''), '[\\r\\n]+')) s FROM f),
n AS (SELECT tile_id, regexp_extract_all(regexp_replace(s, '"[a-z_]+"', '', 'g'), '[-+]?\\d+(?:\\.\\d+)?') v FROM l WHERE regexp_matches(s, '\\d'))
SELECT DISTINCT tile_id, CAST(v[1] AS BIGINT) point_idx, CAST(v[2] AS DOUBLE) x, CAST(v[3] AS DOUBLE) y FROM n WHERE len(v) = 3""",
}
