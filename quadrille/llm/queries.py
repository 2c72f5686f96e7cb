"""Queries of the operators for training data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm import binpack, bpe, gridcluster, mojibake, multiselect, neighbours, overlap, pairs
from quadrille.plans.tile_tasks import _vectors_sql
from quadrille.session import cut
from quadrille.sources.tables import clean_split, table, usable_points

CAPACITY = 2048
NEAR = 4.4


def _tile_clusters(spark: SparkSession, sf: str) -> DataFrame:
    summaries = table(spark, sf, "egms_tokens").where("token_idx = 0 and valid").select("tile_id", "vec", "ingested_at")
    return gridcluster.cluster(summaries, 0.90)[0]


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return _tile_clusters(spark, sf).select("tile_id", "cluster_id")


def p1_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Size, most typical tiles and commonest anchor of each cluster."""
    anchors = table(spark, sf, "s1_final_table").select("tile_id", F.col("reference_anchor_id").alias("anchor"))
    return gridcluster.describe(cut(_tile_clusters(spark, sf)), anchors)


def p3_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """(key, other, cosine): the 3 most similar vectors, at least 0.90 alike, of every vector in other tiles."""
    tokens = table(spark, sf, "egms_tokens").where("valid")
    return neighbours.nearest(tokens, F.concat_ws(":", "tile_id", "token_idx"), F.col("tile_id"), F.col("vec"), F.col("ingested_at"), 3, 0.90)


def p3_search(spark: SparkSession, sf: str) -> DataFrame:
    """Greedy search of the graph: every usable vector whose hashed key is divisible by 100 against all others."""
    tokens = table(spark, sf, "egms_tokens").where("valid")
    nodes = gridcluster.unit_rows(tokens.select(F.concat_ws(":", "tile_id", "token_idx").alias("key"), "vec", "ingested_at"), "key", "vec", "ingested_at")
    nodes = cut(nodes.select("key", F.substring_index("key", ":", 1).alias("grp"), "vec"))
    graph = cut(neighbours.nearest(nodes, F.col("key"), F.col("grp"), F.col("vec"), F.lit(None), 10, 0.90))
    return neighbours.search(nodes.where(F.pmod(F.xxhash64("key"), F.lit(100)) == 0), nodes, graph, 3, 0.90)


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return p3_neighbours(spark, sf).select(F.least("key", "other").alias("key_a"), F.greatest("key", "other").alias("key_b")).distinct()


def _cross_split(spark: SparkSession, sf: str) -> DataFrame:
    points = usable_points(table(spark, sf, "tile_points").select("tile_id", "point_idx", "x", "y"))
    splits = table(spark, sf, "split_manifest").select("tile_id", clean_split(F.col("split")).alias("split")).where("split in ('train', 'val', 'test')")
    return overlap.overlaps(points, splits, NEAR, 0.8)


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Evaluation tiles whose points lie in a training tile."""
    return _cross_split(spark, sf).select(F.least("eval_tile", "train_tile").alias("tile_a"), F.greatest("eval_tile", "train_tile").alias("tile_b"), "eval_split").distinct()


def p4_report(spark: SparkSession, sf: str) -> DataFrame:
    """Overlapping evaluation tiles and overlaps by evaluation split and grid_id, the id within tile_id where the manifest has none."""
    grids = table(spark, sf, "split_manifest").where("tile_id is not null").groupBy("tile_id").agg(F.min("grid_id").alias("grid_id"))
    grids = grids.select(F.col("tile_id").alias("eval_tile"), F.coalesce("grid_id", F.regexp_extract("tile_id", r"^([A-Z]\d+[A-Z]\d+)_", 1)).alias("grid_id"))
    found = _cross_split(spark, sf).join(grids, "eval_tile")
    return found.groupBy("eval_split", "grid_id").agg(F.count_distinct("eval_tile").alias("n_tiles"), F.count("*").alias("n_overlaps"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return pairs.defects(table(spark, sf, "eval_records"), table(spark, sf, "task_catalog"))


def p5_report(spark: SparkSession, sf: str) -> DataFrame:
    """How many answers of each field have each kind of defect, by model."""
    models = table(spark, sf, "eval_records").groupBy("record_id").agg(F.max(F.struct("evaluated_at", "model")).getField("model").alias("model"))
    return p5_found(spark, sf).join(models, "record_id").groupBy("field", "defect", "model").agg(F.count("*").alias("n"))


def _daily(spark: SparkSession, sf: str, name: str, value: str) -> DataFrame:
    return table(spark, sf, name).select("tile_id", clean_split(F.col("split")).alias("split"), F.col(value).alias("value"), "run_day").distinct()


DAILY = (("b3_final_table", "B33_vel_abs_p90_mm_yr"), ("b5_final_table", "B51_seasonality_p90"))


def _both_daily(spark: SparkSession, sf: str) -> DataFrame:
    """(measure, split, value, run_day) of both tables, so that one selection serves both."""
    a, b = (_daily(spark, sf, name, value).withColumn("measure", F.lit(value)) for name, value in DAILY)
    return a.unionByName(b)


def p6_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """Exact percentiles per split, and per split and day: the groups of one selection."""
    rows = _both_daily(spark, sf)
    whole = F.struct(F.lit("whole").alias("part"), F.lit("").alias("day"))
    day = F.struct(F.lit("day").alias("part"), F.col("run_day").cast("string").alias("day"))
    one = rows.select("measure", "split", "value", F.inline(F.array(whole, day))).where("day is not null")
    out = multiselect.percentiles(one, ["measure", "part", "split", "day"], "value")
    return out.select("measure", "part", "split", F.when(F.col("day") != "", F.col("day")).alias("run_day"), "percent", F.round("value", 6).alias("value"), "n")


def p6_days(spark: SparkSession, sf: str) -> DataFrame:
    """Joinable summaries of each split and day: weighted values."""
    return multiselect.summaries(_both_daily(spark, sf), ["measure", "split", "run_day"], "value")


def p6_whole_from_days(spark: SparkSession, sf: str) -> DataFrame:
    """Percentiles per split from the days' summaries alone."""
    out = multiselect.percentiles(p6_days(spark, sf), ["measure", "split"], "v", weight="w")
    return out.withColumn("value", F.round("value", 6))


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.encode(table(spark, sf, "documents").select("doc_id", "text"))


def p8_decoded(spark: SparkSession, sf: str) -> DataFrame:
    """Digest of every document's text as it comes back from its ids; invalid surrogates apart, that of the text itself."""
    texts = bpe.decode(cut(p8_ids(spark, sf)))
    return texts.select("doc_id", F.md5(F.encode("text", "UTF-8")).alias("digest"))


def p9_containers(spark: SparkSession, sf: str) -> DataFrame:
    """Every document, or part of one larger than a container, with its container."""
    return binpack.pack(bpe.sizes(table(spark, sf, "documents").select("doc_id", "text")), CAPACITY)


def p9_check(spark: SparkSession, sf: str) -> DataFrame:
    """Documents placed, containers beyond their capacity, and documents in several containers though they would fit one."""
    placed = cut(p9_containers(spark, sf))
    over = placed.groupBy("container_id").agg(F.sum("n_tokens").alias("used")).agg(F.count_if(F.col("used") > CAPACITY).alias("overfull"))
    docs = placed.groupBy("doc_id").agg(F.sum("n_tokens").alias("size"), F.count_distinct("container_id").alias("containers"))
    docs = docs.agg(F.count("*").alias("documents"), F.count_if((F.col("size") <= CAPACITY) & (F.col("containers") > 1)).alias("split_small"))
    return docs.join(F.broadcast(over))


def _garbled(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return mojibake.judge(docs, mojibake.learn(docs))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return _garbled(spark, sf).select("doc_id").distinct()


def p10_restored(spark: SparkSession, sf: str) -> DataFrame:
    """The garbled documents with their text as far as it can be restored."""
    return _garbled(spark, sf)


QUERIES = {f.__name__: f for f in (p1_found, p1_clusters, p3_found, p3_neighbours, p3_search, p4_found, p4_report, p5_found, p5_report, p6_percentiles, p6_days, p6_whole_from_days, p8_ids, p8_decoded, p9_containers, p9_check, p10_found, p10_restored)}

_PAIRS = """
WITH pts AS (SELECT DISTINCT tile_id, point_idx, CAST(x AS DOUBLE) x, CAST(y AS DOUBLE) y FROM tile_points
  WHERE x IS NOT NULL AND y IS NOT NULL AND isfinite(x) AND isfinite(y) AND tile_id IS NOT NULL AND point_idx IS NOT NULL),
s AS (SELECT DISTINCT tile_id, lower(trim(split)) sp FROM split_manifest WHERE lower(trim(split)) IN ('train', 'val', 'test')),
e AS (SELECT pts.*, CAST(floor(x / 4.4) AS BIGINT) cx, CAST(floor(y / 4.4) AS BIGINT) cy FROM pts WHERE tile_id IN (SELECT tile_id FROM s WHERE sp <> 'train')),
t AS (SELECT tile_id, x, y, CAST(floor(x / 4.4) AS BIGINT) + i AS cx, CAST(floor(y / 4.4) AS BIGINT) + j AS cy
  FROM pts, (SELECT unnest([-1, 0, 1]) i), (SELECT unnest([-1, 0, 1]) j) WHERE tile_id IN (SELECT tile_id FROM s WHERE sp = 'train')),
m AS (SELECT e.tile_id et, t.tile_id tt, count(DISTINCT e.point_idx) k FROM e JOIN t USING (cx, cy)
  WHERE e.tile_id <> t.tile_id AND (e.x - t.x) * (e.x - t.x) + (e.y - t.y) * (e.y - t.y) <= 4.4 * 4.4 GROUP BY 1, 2),
n AS (SELECT tile_id, count(*) n FROM pts GROUP BY 1),
o AS (SELECT m.et, m.tt, s.sp FROM m JOIN n ON n.tile_id = m.et JOIN s ON s.tile_id = m.et WHERE s.sp <> 'train' AND m.k * 10 >= n.n * 8
  UNION ALL SELECT a.tile_id, a.tile_id, a.sp FROM s a JOIN s b USING (tile_id) WHERE a.sp <> 'train' AND b.sp = 'train')"""


def _percentile_sql() -> str:
    parts = []
    for name, value in DAILY:
        rows = f"(SELECT DISTINCT tile_id, nullif(lower(trim(split)), '') split, CAST({value} AS DOUBLE) v, run_day FROM {name})"
        good = "WHERE split IS NOT NULL AND v IS NOT NULL AND isfinite(v)"
        for p in multiselect.PERCENTS:
            common = f"CAST({p} AS DOUBLE) AS percent, round(quantile_cont(v, {p / 100}), 6) AS value, count(*) AS n, '{value}' AS measure FROM {rows} {good}"
            parts.append(f"SELECT 'whole' AS part, split, CAST(NULL AS VARCHAR) AS run_day, {common} GROUP BY split")
            parts.append(f"SELECT 'day' AS part, split, CAST(CAST(run_day AS DATE) AS VARCHAR) AS run_day, {common} AND run_day IS NOT NULL GROUP BY split, run_day")
    return " UNION ALL ".join(parts)


ORACLE: dict[str, str] = {
    "p4_found": f"{_PAIRS} SELECT DISTINCT least(et, tt) AS tile_a, greatest(et, tt) AS tile_b, sp AS eval_split FROM o",
    "p4_report": f"""{_PAIRS}, g AS (SELECT tile_id, coalesce(min(grid_id), regexp_extract(tile_id, '^([A-Z]\\d+[A-Z]\\d+)_', 1)) grid_id FROM split_manifest WHERE tile_id IS NOT NULL GROUP BY tile_id)
SELECT sp AS eval_split, grid_id, count(DISTINCT et) AS n_tiles, count(*) AS n_overlaps FROM o JOIN g ON g.tile_id = o.et GROUP BY 1, 2""",
    "p6_percentiles": _percentile_sql(),
    # Days of fewer rows than a summary has points keep all their values, so the joined result is exact where every day is.
    "p6_days": " UNION ALL ".join(
        f"SELECT '{value}' AS measure, split, run_day, v, count(*) AS w FROM (SELECT DISTINCT tile_id, nullif(lower(trim(split)), '') split, CAST({value} AS DOUBLE) v, run_day FROM {name}) WHERE split IS NOT NULL AND run_day IS NOT NULL AND v IS NOT NULL AND isfinite(v) GROUP BY ALL"
        for name, value in DAILY
    ),
    "p6_whole_from_days": " UNION ALL ".join(
        f"SELECT '{value}' AS measure, split, CAST({p} AS DOUBLE) AS percent, round(quantile_cont(v, {p / 100}), 6) AS value, count(*) AS n FROM (SELECT DISTINCT tile_id, nullif(lower(trim(split)), '') split, CAST({value} AS DOUBLE) v, run_day FROM {name}) WHERE split IS NOT NULL AND run_day IS NOT NULL AND v IS NOT NULL AND isfinite(v) GROUP BY split"
        for name, value in DAILY for p in multiselect.PERCENTS
    ),
    "p1_found": f"""WITH RECURSIVE {_vectors_sql("token_idx = 0")}, a AS (SELECT x.tile_id a, y.tile_id b FROM v x JOIN v y ON x.tile_id <> y.tile_id WHERE list_cosine_similarity(x.vec, y.vec) >= 0.9),
r AS (SELECT a, b FROM a UNION SELECT r.a, a.b FROM r JOIN a ON r.b = a.a), c AS (SELECT a, least(a, min(b)) c FROM r GROUP BY a)
SELECT a AS tile_id, c AS cluster_id FROM c WHERE c IN (SELECT c FROM c GROUP BY c HAVING count(*) >= 3)""",
    "p8_decoded": "SELECT doc_id, md5(coalesce(text, '')) AS digest FROM documents",
    "p9_check": "SELECT count(DISTINCT doc_id) AS documents, 0 AS overfull, 0 AS split_small FROM documents WHERE doc_id IS NOT NULL AND text <> ''",
}
