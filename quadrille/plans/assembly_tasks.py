"""Assembly of tables, question rows and samples: unions, aligned joins, orders of an epoch, draws, inventories and text forms."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadrille.functions import stats, texts
from quadrille.operators import sampling, trend
from quadrille.plans import corpus_tasks, season_tasks, tile_tasks
from quadrille.plans.corpus_tasks import B33, B51
from quadrille.session import cut
from quadrille.sources.tables import clean_split, nan_to_null, table


def run_day_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Mean, least, median and largest tail velocity of every tile over its runs."""
    b = corpus_tasks._b3(spark, sf).where("tile_id is not null and v is not null").select("tile_id", "run_day", "v").distinct()
    a = b.groupBy("tile_id").agg(F.round(F.avg("v"), 6).alias("mean"), F.min("v").alias("least"), F.max("v").alias("largest"), F.count("*").alias("runs"))
    return a.join(stats.percentiles(b, ["tile_id"], {"v": F.col("v")}, [0.5]), "tile_id").select("tile_id", "mean", F.round("least", 6).alias("least"), F.round("v_p50", 6).alias("median"), F.round("largest", 6).alias("largest"), "runs")


def weighted_distance(spark: SparkSession, sf: str) -> DataFrame:
    """Mean distance to the nearest anchor of each split, weighted by the tiles' points."""
    d = table(spark, sf, "s1_final_table").where("tile_id is not null").groupBy("tile_id").agg(F.max("S12_reference_anchor_distance").alias("d"), F.max(clean_split(F.col("split"))).alias("split"))
    n = table(spark, sf, "tile_points").where("tile_id is not null").groupBy("tile_id").agg(F.count("*").alias("n"))
    j = d.where(nan_to_null(F.col("d")).isNotNull() & F.col("split").isNotNull()).join(n, "tile_id")
    return j.groupBy("split").agg(F.round(F.sum(F.col("d") * F.col("n")) / F.sum("n"), 6).alias("mean_distance"), F.sum("n").alias("points"))


def _clean_path(c: Column) -> Column:
    return F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("/")), r"^(?:\./|/)+", "")


def release_bytes(spark: SparkSession, sf: str) -> DataFrame:
    """Files and bytes of every top folder and file type."""
    f = table(spark, sf, "tile_files").where("file_id is not null and path is not null").groupBy("file_id").agg(F.max(F.struct("path", "n_bytes")).alias("r"))
    p = _clean_path(F.col("r.path"))
    f = f.select(F.substring_index(p, "/", 1).alias("folder"), F.lower(F.regexp_extract(p, r"\.([A-Za-z0-9]+)$", 1)).alias("kind"), F.col("r.n_bytes").alias("n_bytes"))
    top = F.when(F.col("folder").contains("."), "").otherwise(F.col("folder"))
    return f.groupBy(top.alias("folder"), "kind").agg(F.count("*").alias("files"), F.sum("n_bytes").alias("bytes"))


def release_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Tiles, points and distinct grid cells of the manifest by split."""
    m = table(spark, sf, "split_manifest").select("tile_id", clean_split(F.col("split")).alias("split"), "grid_id", "n_points").where("tile_id is not null and split is not null")
    one = m.groupBy("split", "tile_id").agg(F.max("n_points").alias("n_points"), F.max("grid_id").alias("grid_id"))
    return one.groupBy("split").agg(F.count("*").alias("tiles"), F.sum("n_points").alias("points"), F.count_distinct("grid_id").alias("grids"))


def anchor_medoids(spark: SparkSession, sf: str) -> DataFrame:
    """The tile of least total cosine distance to the others of its anchor: n less the product with the sum of unit vectors."""
    v = tile_tasks._latest_vectors(spark, sf, "token_idx = 0").select("tile_id", "vec")
    length = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    of = table(spark, sf, "s1_final_table").where("tile_id is not null and reference_anchor_id is not null").groupBy("tile_id").agg(F.min("reference_anchor_id").alias("anchor"))
    u = cut(v.select("tile_id", F.transform("vec", lambda x: x.cast("double") / length).alias("u")).join(of, "tile_id"))
    total = u.groupBy("anchor").agg(Summarizer.sum(array_to_vector("u")).alias("s"), F.count("*").alias("n")).select("anchor", "n", vector_to_array("s").alias("s"))
    product = F.aggregate(F.zip_with("u", "s", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    d = u.join(F.broadcast(total), "anchor").select("anchor", "tile_id", F.round(F.col("n") - product, 7).alias("d"))
    return d.groupBy("anchor").agg(F.min(F.struct("d", "tile_id")).alias("m"), F.count("*").alias("tiles")).select("anchor", F.col("m.tile_id").alias("medoid"), F.round("m.d", 5).alias("total_distance"), "tiles")


def top_values(spark: SparkSession, sf: str) -> DataFrame:
    """The twelve commonest rendered values of class answers, a report's list."""
    r = corpus_tasks._records(spark, sf).where("answer_type = 'categorical' and rendered_target_value is not null")
    return r.groupBy(F.col("rendered_target_value").alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(12)


def chosen_tiles(spark: SparkSession, sf: str) -> DataFrame:
    """Twenty tiles by hash, the same in every run."""
    t = table(spark, sf, "split_manifest").where("tile_id is not null").select("tile_id").distinct()
    return t.orderBy(F.md5(F.concat(F.col("tile_id"), F.lit("|4"))), "tile_id").limit(20)


def shard_union(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of each tile as its shard reports them, the shards' tables put together again in order of the tiles."""
    p = table(spark, sf, "tile_points").where("tile_id is not null").withColumn("shard", F.pmod(F.crc32("tile_id"), F.lit(4)))
    out = None
    for s in range(4):
        one = p.where(F.col("shard") == s).groupBy("tile_id").agg(F.count("*").alias("rows"), F.count_distinct("point_idx").alias("points"))
        out = one if out is None else out.unionByName(one)
    return out.orderBy("tile_id")


def _catalog_rows(spark: SparkSession, sf: str) -> DataFrame:
    tiles = table(spark, sf, "split_manifest").where("tile_id is not null").groupBy("tile_id").agg(F.max(clean_split(F.col("split"))).alias("split"))
    return tiles.join(F.broadcast(table(spark, sf, "task_catalog").select("task_id")))


def strict_epoch(spark: SparkSession, sf: str) -> DataFrame:
    """An epoch that takes each tile once for every token task, phrases in turn, and at most 30 tiles for the tasks to be declined."""
    place = F.row_number().over(Window.partitionBy("task_id").orderBy(sampling.order("task_id", "tile_id", seed=6), "tile_id"))
    rows = _catalog_rows(spark, sf).select("task_id", "tile_id").withColumn("place", place)
    return rows.where("task_id not like 'X%' or place <= 30").select("task_id", "tile_id", ((F.col("place") - 1) % len(corpus_tasks.PHRASES)).alias("phrase_id"))


def balanced_eval_rows(spark: SparkSession, sf: str, total: int = 600) -> DataFrame:
    """As many records of every task, ceil(total / tasks); a task with fewer gives its records again in turn."""
    r = corpus_tasks._records(spark, sf).where("task is not null").select("task", "record_id")
    sizes = r.groupBy("task").agg(F.count("*").alias("n"))
    need = sizes.agg(F.ceil(F.lit(total) / F.count("*")).alias("need"))
    place = F.row_number().over(Window.partitionBy("task").orderBy(sampling.order("task", F.col("record_id").cast("string"), seed=9), "record_id")) - 1
    ranked = r.withColumn("place", place).join(F.broadcast(need)).where(F.col("place") < F.col("need"))
    wanted = sizes.join(F.broadcast(need)).select("task", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("need") - 1)).alias("slot"), "n")
    return wanted.withColumn("place", (F.col("slot") % F.col("n")).cast("int")).join(ranked.select("task", "record_id", "place"), ["task", "place"]).select("task", "slot", "record_id")


def task_draws(spark: SparkSession, sf: str, draws: int = 500) -> DataFrame:
    """How often each task comes up in draws in proportion to its records, by ranges of cumulative weights."""
    w = cut(corpus_tasks._records(spark, sf).where("task is not null").groupBy("task").agg(F.count("*").alias("n")))
    upto, total = stats.running(w, ["task"], "n", "upto")
    u = spark.range(draws).select((F.conv(F.substring(F.md5(F.concat(F.col("id").cast("string"), F.lit("|draw"))), 1, 8), 16, 10).cast("double") / 4294967296.0 * total).alias("u"))
    # The tasks are a fixed catalog, so their ranges go to every draw.
    hit = u.join(F.broadcast(upto), (F.col("u") >= F.col("upto") - F.col("n")) & (F.col("u") < F.col("upto")))
    return hit.groupBy("task").agg(F.count("*").alias("drawn"))


def padded_batches(spark: SparkSession, sf: str, size: int = 8) -> DataFrame:
    """The point numbers of the tiles of each batch, padded with -1 to the longest of the batch, and how many are real."""
    s = table(spark, sf, "tile_series").where("tile_id is not null and point_idx is not null").groupBy("tile_id").agg(F.array_sort(F.collect_set("point_idx")).alias("points"))
    b = F.pmod(F.conv(F.substring(F.md5("tile_id"), 1, 8), 16, 10).cast("bigint"), F.lit(size))
    s = s.withColumn("batch", b)
    width = s.groupBy("batch").agg(F.max(F.size("points")).alias("width"))
    padded = F.concat("points", F.array_repeat(F.lit(-1), F.col("width") - F.size("points")))
    return s.join(width, "batch").select("batch", "tile_id", F.array_join(F.transform(padded, lambda x: x.cast("string")), ",").alias("padded"), F.size("points").alias("real"))


def four_way_intersection(spark: SparkSession, sf: str) -> DataFrame:
    """Tiles that the manifest, both run tables and the anchors all hold, and whether their splits agree."""
    out = None
    for name in ("split_manifest", "b3_final_table", "b5_final_table", "s1_final_table"):
        t = table(spark, sf, name).where("tile_id is not null").groupBy("tile_id").agg(F.min(clean_split(F.col("split"))).alias(f"{name}_split"))
        out = t if out is None else out.join(t, "tile_id")
    names = [c for c in out.columns if c != "tile_id"]
    same = F.coalesce(F.least(*names) == F.greatest(*names), F.lit(False)) & F.forall(F.array(*names), lambda s: s.isNotNull())
    return out.select("tile_id", F.col(names[0]).alias("split"), same.alias("agree"))


def cache_order(spark: SparkSession, sf: str) -> DataFrame:
    """Anchors in the order of the token cache (here: of hashed tile ids), with tiles missing on either side shown."""
    ids = table(spark, sf, "egms_tokens").where("tile_id is not null").select("tile_id").distinct().withColumn("h", F.md5("tile_id"))
    at, _ = stats.running(ids.withColumn("one", F.lit(1)), ["h", "tile_id"], "one", "position")
    s = table(spark, sf, "s1_final_table").where("tile_id is not null").groupBy("tile_id").agg(F.min("reference_anchor_id").alias("anchor"), F.lit(True).alias("labelled"))
    out = at.select("tile_id", (F.col("position") - 1).alias("position")).join(s, "tile_id", "full")
    return out.select("tile_id", "position", "anchor", F.coalesce("labelled", F.lit(False)).alias("labelled"))


def task_selection(spark: SparkSession, sf: str, include: tuple[str, ...] = ("B21", "B33", "C11", "Z99"), exclude: tuple[str, ...] = ("C11", "Y11")) -> DataFrame:
    """Which of the tasks asked for are kept or excluded, and which asked-for names no catalog knows."""
    known = table(spark, sf, "task_catalog").select("task_id").distinct().withColumn("known", F.lit(True))
    asked = spark.createDataFrame([(t, t in include, t in exclude) for t in sorted({*include, *exclude})], "task_id string, included boolean, excluded boolean")
    state = F.when(F.col("known").isNull(), "unknown").when(F.col("excluded"), "excluded").otherwise("kept")
    return asked.join(known, "task_id", "left").select("task_id", state.alias("state"))


def component_files(spark: SparkSession, sf: str, groups: tuple[str, ...] = ("data/", "artifacts/")) -> DataFrame:
    """Files below the folders of the chosen component groups."""
    p = _clean_path(F.col("path"))
    f = table(spark, sf, "tile_files").where("file_id is not null and path is not null").select("file_id", p.alias("path")).distinct()
    inside = F.lit(False)
    for g in groups:
        inside = inside | F.col("path").startswith(g)
    return f.where(inside).groupBy("path").agg(F.count_distinct("file_id").alias("files"))


def pending_records(spark: SparkSession, sf: str) -> DataFrame:
    """By task: records whose question was not yet put to the first model in order of names, and keys that came more than once."""
    r = table(spark, sf, "eval_records").where("record_id is not null")
    often = r.groupBy("record_id").agg(F.max("task").alias("task"), F.count("*").alias("times")).where("times > 1").groupBy("task").agg(F.count("*").alias("repeated"))
    key = ["task", "tile_id", "phrase_id"]
    full = r.where("task is not null and tile_id is not null and phrase_id is not null")
    first = full.agg(F.min("model").alias("model"))
    done = full.join(F.broadcast(first), "model").select(*key).distinct()
    open_ = full.select(*key).distinct().join(done, key, "left_anti").groupBy("task").agg(F.count("*").alias("pending"))
    out = open_.join(often, "task", "full").where("task is not null")
    return out.select("task", F.coalesce("pending", F.lit(0)).alias("pending"), F.coalesce("repeated", F.lit(0)).alias("repeated"))


def top_pair(spark: SparkSession, sf: str) -> DataFrame:
    """The two processes that stand highest among the training tiles, whatever their order, missing ones last."""
    d = tile_tasks.d4_dominance(spark, sf)
    names = ("trend", "seasonal", "acceleration")
    order = F.array_sort(F.array(*[F.struct((-F.coalesce(F.round(n, 6), F.lit(-1.0))).alias("r"), F.lit(k).alias("k"), F.lit(n).alias("n")) for k, n in enumerate(names)]))
    return d.select("tile_id", F.concat_ws("_and_", F.array_sort(F.transform(F.slice(order, 1, 2), lambda s: s["n"]))).alias("pair"))


def residual_rms(spark: SparkSession, sf: str) -> DataFrame:
    """Root mean square of what a straight line leaves of each history."""
    r = season_tasks._rests(season_tasks._years(spark, sf))
    return r.groupBy("tile_id", "point_idx").agg(F.round(F.sqrt(F.avg(F.col("r") * F.col("r"))), 5).alias("rms"))


def subsample_seeds(spark: SparkSession, sf: str) -> DataFrame:
    """The seed of each tile's five subsamples."""
    t = table(spark, sf, "split_manifest").where("tile_id is not null").select("tile_id").distinct().withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(4))))
    return t.select("tile_id", "draw", texts.seed(F.col("tile_id"), F.lit("0.2"), F.col("draw").cast("string")).alias("seed"))


def label_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Every class name as a reader would write it, at the start of a sentence and inside one."""
    names = corpus_tasks._records(spark, sf).where("answer_type = 'categorical' and rendered_target_value is not null").select(F.col("rendered_target_value").alias("label")).distinct()
    h = texts.humanised(F.col("label"))
    return names.select("label", texts.capitalised(h).alias("first"), texts.decapitalised(h).alias("inside"))


def cell_texts(spark: SparkSession, sf: str) -> DataFrame:
    """The tiles' dominant cells in words."""
    return tile_tasks.c1_dominant_cell(spark, sf).select("tile_id", F.coalesce(texts.grid_place(F.col("c13_cell")), F.lit("no cell")).alias("place"))


def label_aliases(spark: SparkSession, sf: str) -> DataFrame:
    """The forms of a label that an answer may use: as it is, in words, and in the full sentence."""
    r = corpus_tasks._records(spark, sf).where("answer_type = 'categorical' and rendered_target_value is not null").select("task", F.col("rendered_target_value").alias("label")).distinct()
    words = texts.humanised(F.col("label"))
    named = r.join(F.broadcast(table(spark, sf, "task_catalog").select(F.col("task_id").alias("task"), "task_name")), "task")
    forms = F.array_distinct(F.array("label", words, F.concat(F.lit("the "), F.col("task_name"), F.lit(" is "), words)))
    return named.select("task", "label", F.explode(forms).alias("alias"))


def numeric_target_stats(spark: SparkSession, sf: str, floor: float = 1e-6) -> DataFrame:
    """Mean, spread (never below a floor), known and missing values of the training rows of each numeric target."""
    out = None
    for name, c in (("b3_final_table", B33), ("b5_final_table", B51)):
        t = table(spark, sf, name).where("tile_id is not null").select("tile_id", clean_split(F.col("split")).alias("split"), nan_to_null(F.col(c)).alias("v"), "run_day").distinct().where("split = 'train'")
        one = t.agg(F.lit(c).alias("target"), F.round(F.avg("v"), 6).alias("mean"), F.round(F.greatest(F.stddev_pop("v"), F.lit(floor)), 6).alias("std"), F.count("v").alias("n_valid"), F.count_if(F.col("v").isNull()).alias("n_missing"))
        out = one if out is None else out.unionByName(one)
    return out


def family_medians(spark: SparkSession, sf: str) -> DataFrame:
    """Means and medians of the bounded scores of each family of tasks."""
    n = corpus_tasks.eval_numeric_metrics(spark, sf).select("task", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("r2"))).alias("score"))
    s = n.unionByName(corpus_tasks.eval_balanced_accuracy(spark, sf).select("task", F.col("balanced_accuracy").alias("score"))).where("score is not null")
    s = cut(s.select(F.substring("task", 1, 1).alias("family"), "score"))
    m = stats.percentiles(s, ["family"], {"score": F.col("score")}, [0.5])
    return s.groupBy("family").agg(F.count("*").alias("tasks"), F.round(F.avg("score"), 5).alias("mean")).join(m, "family").select("family", "tasks", "mean", F.round("score_p50", 5).alias("median"))


def shuffled_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """A control that gives each tile the summary of another of its split: the next in the order of hashes, the first for the last one."""
    t = tile_tasks._latest_vectors(spark, sf, "token_idx = 0").where("split is not null").select("split", "tile_id")
    w = Window.partitionBy("split").orderBy(F.md5("tile_id"), "tile_id")
    first = t.groupBy("split").agg(F.min(F.struct(F.md5("tile_id").alias("h"), "tile_id")).alias("f"))
    return t.withColumn("next", F.lead("tile_id").over(w)).join(F.broadcast(first), "split").select("tile_id", F.coalesce("next", "f.tile_id").alias("summary_of"))


def cycle_rows(spark: SparkSession, sf: str, cycle: int = 1) -> DataFrame:
    """The question rows of a cycle by split: all tiles for the token tasks, at most 30 for those to be declined, in hashed order dealt to ten files."""
    q = corpus_tasks.question_rows(spark, sf, cycle)
    split = table(spark, sf, "split_manifest").where("tile_id is not null").groupBy("tile_id").agg(F.min(clean_split(F.col("split"))).alias("split"))
    declined = sampling.per_group(q.where("task_id like 'X%'"), ["task_id"], ["tile_id"], 30, 5)
    rows = q.where("task_id not like 'X%'").unionByName(declined).join(split, "tile_id")
    part = F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", "task_id", "tile_id", F.lit(str(cycle)))), 1, 8), 16, 10).cast("bigint"), F.lit(10))
    return rows.select("split", "task_id", "tile_id", "phrase_id", part.alias("part"))


EXAMPLES = ("the cause of the motion", "the motion of next year", "the state of a single house")
WRAPPERS = ("{e} cannot be told from these data.", "These data do not show {e}.", "No statement on {e} is possible here.", "{e} lies outside what was measured.")


def refusal_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Answers to the tasks to be declined: the phrase number chooses the example, and how often it went round the wrapper."""
    rows = _catalog_rows(spark, sf).where("task_id like 'X%'").withColumn("phrase_id", F.explode(F.sequence(F.lit(0), F.lit(11))))
    example = F.element_at(F.array(*map(F.lit, EXAMPLES)), F.col("phrase_id") % len(EXAMPLES) + 1)
    wrapper = F.element_at(F.array(*map(F.lit, WRAPPERS)), (F.floor(F.col("phrase_id") / len(EXAMPLES)) % len(WRAPPERS) + 1).cast("int"))
    return rows.select("tile_id", "task_id", "phrase_id", texts.capitalised(F.replace(wrapper, F.lit("{e}"), example)).alias("answer"))


def value_bins(spark: SparkSession, sf: str) -> DataFrame:
    """The bin of every tile's B51 between the eight-quantiles of the training tiles."""
    b = cut(tile_tasks.b5_seasonality(spark, sf))
    return b.select("tile_id", trend.year_bins(b, b.where("split = 'train'"), "b51_p90").alias("bin"))


QUERIES = {
    f.__name__: f
    for f in (
        run_day_stats, weighted_distance, release_bytes, release_totals, anchor_medoids, top_values, chosen_tiles, shard_union, strict_epoch, balanced_eval_rows, task_draws,
        padded_batches, four_way_intersection, cache_order, task_selection, component_files, pending_records, top_pair, residual_rms, subsample_seeds, label_texts, cell_texts,
        label_aliases, numeric_target_stats, family_medians, shuffled_tokens, cycle_rows, refusal_rows, value_bins,
    )
}

C, T = corpus_tasks.ORACLE, tile_tasks.ORACLE
_R = f"WITH {corpus_tasks._RECORDS}"
_SPLIT = "nullif(lower(trim(split)), '')"
_PATH = r"regexp_replace(replace(path, '\', '/'), '^(?:\./|/)+', '')"
_HEX = "CAST('0x' || substr(md5({0}), 1, 8) AS BIGINT)"
_HUMAN = "replace(replace(replace({0}, '_', ' '), '|', ' / '), 'encoder', 'representation')"
_ROWS = f"c AS (SELECT t.tile_id, k.task_id FROM (SELECT DISTINCT tile_id FROM split_manifest WHERE tile_id IS NOT NULL) t, task_catalog k)"
_LABELS = "SELECT DISTINCT task, rendered_target_value AS label FROM r WHERE answer_type = 'categorical' AND rendered_target_value IS NOT NULL"
_ARRAY = lambda items: "[" + ", ".join(f"'{x}'" for x in items) + "]"
_EDGES = ", ".join(f"round(quantile_cont(b51_p90, {i / 8}), 9) q{i}" for i in range(9))
_ALL_EDGES = ", ".join(f"q{i}" for i in range(9))

ORACLE: dict[str, str] = {
    "run_day_stats": f"""WITH b AS (SELECT DISTINCT tile_id, run_day, {B33} v FROM b3_final_table WHERE tile_id IS NOT NULL AND {B33} IS NOT NULL AND NOT isnan({B33}))
SELECT tile_id, round(avg(v), 6) AS mean, round(min(v), 6) AS least, round(quantile_cont(v, 0.5), 6) AS median, round(max(v), 6) AS largest, count(*) AS runs FROM b GROUP BY 1""",
    "weighted_distance": f"""WITH d AS (SELECT tile_id, max(S12_reference_anchor_distance) d, max({_SPLIT}) split FROM s1_final_table WHERE tile_id IS NOT NULL GROUP BY 1), n AS (SELECT tile_id, count(*) n FROM tile_points WHERE tile_id IS NOT NULL GROUP BY 1)
SELECT split, round(sum(d * n) / sum(n), 6) AS mean_distance, sum(n) AS points FROM d JOIN n USING (tile_id) WHERE d IS NOT NULL AND NOT isnan(d) AND split IS NOT NULL GROUP BY 1""",
    "release_bytes": f"""WITH f AS (SELECT file_id, path, n_bytes FROM tile_files WHERE file_id IS NOT NULL AND path IS NOT NULL QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY path DESC, n_bytes DESC NULLS LAST) = 1),
p AS (SELECT split_part({_PATH}, '/', 1) folder, lower(regexp_extract({_PATH}, '\\.([A-Za-z0-9]+)$', 1)) kind, n_bytes FROM f)
SELECT CASE WHEN contains(folder, '.') THEN '' ELSE folder END AS folder, kind, count(*) AS files, sum(n_bytes) AS bytes FROM p GROUP BY 1, 2""",
    "release_totals": f"""WITH m AS (SELECT {_SPLIT} split, tile_id, max(n_points) n_points, max(grid_id) grid_id FROM split_manifest WHERE tile_id IS NOT NULL GROUP BY 1, 2)
SELECT split, count(*) AS tiles, sum(n_points) AS points, count(DISTINCT grid_id) AS grids FROM m WHERE split IS NOT NULL GROUP BY 1""",
    "anchor_medoids": f"""WITH {tile_tasks._vectors_sql("token_idx = 0")}, a AS (SELECT tile_id, min(reference_anchor_id) anchor FROM s1_final_table WHERE tile_id IS NOT NULL AND reference_anchor_id IS NOT NULL GROUP BY 1),
u AS (SELECT a.anchor, v.tile_id, unnest(v.vec) / sqrt(list_inner_product(v.vec, v.vec)) x, unnest(range(256)) k FROM v JOIN a USING (tile_id)), s AS (SELECT anchor, k, sum(x) s, count(*) n FROM u GROUP BY 1, 2),
d AS (SELECT u.anchor, u.tile_id, round(max(n) - sum(x * s), 7) d FROM u JOIN s ON s.anchor = u.anchor AND s.k = u.k GROUP BY 1, 2)
SELECT anchor, min(struct_pack(d := d, t := tile_id)).t AS medoid, round(min(d), 5) AS total_distance, count(*) AS tiles FROM d GROUP BY 1""",
    "top_values": f"{_R} SELECT rendered_target_value AS value, count(*) AS n FROM r WHERE answer_type = 'categorical' AND rendered_target_value IS NOT NULL GROUP BY 1 ORDER BY n DESC, value LIMIT 12",
    "chosen_tiles": "SELECT tile_id FROM (SELECT DISTINCT tile_id FROM split_manifest WHERE tile_id IS NOT NULL) ORDER BY md5(tile_id || '|4'), tile_id LIMIT 20",
    "shard_union": "SELECT tile_id, count(*) AS rows, count(DISTINCT point_idx) AS points FROM tile_points WHERE tile_id IS NOT NULL GROUP BY 1",
    "strict_epoch": f"""WITH {_ROWS}, p AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY md5(task_id || '|' || tile_id || '|6'), tile_id) place FROM c)
SELECT task_id, tile_id, (place - 1) % 5 AS phrase_id FROM p WHERE task_id NOT LIKE 'X%' OR place <= 30""",
    "balanced_eval_rows": f"""{_R}, p AS (SELECT task, record_id, row_number() OVER (PARTITION BY task ORDER BY md5(task || '|' || record_id || '|9'), record_id) - 1 place FROM r WHERE task IS NOT NULL),
s AS (SELECT task, count(*) n FROM p GROUP BY 1), w AS (SELECT task, n, unnest(range(CAST(ceil(600.0 / (SELECT count(*) FROM s)) AS BIGINT))) slot FROM s)
SELECT w.task, w.slot, p.record_id FROM w JOIN p ON p.task = w.task AND p.place = w.slot % w.n""",
    "task_draws": f"""{_R}, w AS (SELECT task, count(*) n FROM r WHERE task IS NOT NULL GROUP BY 1), c AS (SELECT task, n, sum(n) OVER (ORDER BY task) upto FROM w),
u AS (SELECT {_HEX.format("CAST(i AS VARCHAR) || '|draw'")} / 4294967296.0::DOUBLE * (SELECT sum(n) FROM w) u FROM range(500) g(i)) SELECT task, count(*) AS drawn FROM u JOIN c ON u >= upto - n AND u < upto GROUP BY 1""",
    "padded_batches": f"""WITH s AS (SELECT tile_id, list_sort(list(DISTINCT point_idx)) p, {_HEX.format("tile_id")} % 8 batch FROM tile_series WHERE tile_id IS NOT NULL AND point_idx IS NOT NULL GROUP BY 1),
w AS (SELECT batch, max(len(p)) width FROM s GROUP BY 1)
SELECT batch, tile_id, array_to_string(list_concat(p, [-1 for i in range(width - len(p))]), ',') AS padded, len(p) AS "real" FROM s JOIN w USING (batch)""",
    "four_way_intersection": "WITH " + ", ".join(f"{a} AS (SELECT tile_id, min({_SPLIT}) s FROM {n} WHERE tile_id IS NOT NULL GROUP BY 1)" for a, n in (("m", "split_manifest"), ("b3", "b3_final_table"), ("b5", "b5_final_table"), ("s1", "s1_final_table")))
    + " SELECT tile_id, m.s AS split, coalesce(m.s = b3.s AND m.s = b5.s AND m.s = s1.s, FALSE) AS agree FROM m JOIN b3 USING (tile_id) JOIN b5 USING (tile_id) JOIN s1 USING (tile_id)",
    "cache_order": """WITH i AS (SELECT tile_id, row_number() OVER (ORDER BY md5(tile_id), tile_id) - 1 AS position FROM (SELECT DISTINCT tile_id FROM egms_tokens WHERE tile_id IS NOT NULL)),
s AS (SELECT tile_id, min(reference_anchor_id) anchor, TRUE l FROM s1_final_table WHERE tile_id IS NOT NULL GROUP BY 1) SELECT tile_id, position, anchor, coalesce(l, FALSE) AS labelled FROM i FULL JOIN s USING (tile_id)""",
    "task_selection": """SELECT a.task_id, CASE WHEN k.task_id IS NULL THEN 'unknown' WHEN a.x THEN 'excluded' ELSE 'kept' END AS state
FROM (VALUES ('B21', FALSE), ('B33', FALSE), ('C11', TRUE), ('Z99', FALSE), ('Y11', TRUE)) a(task_id, x) LEFT JOIN (SELECT DISTINCT task_id FROM task_catalog) k USING (task_id)""",
    "component_files": f"WITH f AS (SELECT DISTINCT file_id, {_PATH} AS path FROM tile_files WHERE file_id IS NOT NULL AND path IS NOT NULL) SELECT path, count(DISTINCT file_id) AS files FROM f WHERE starts_with(path, 'data/') OR starts_with(path, 'artifacts/') GROUP BY 1",
    "pending_records": """WITH o AS (SELECT task, count(*) repeated FROM (SELECT record_id, max(task) task FROM eval_records WHERE record_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1) GROUP BY 1),
f AS (SELECT * FROM eval_records WHERE record_id IS NOT NULL AND task IS NOT NULL AND tile_id IS NOT NULL AND phrase_id IS NOT NULL), d AS (SELECT DISTINCT task, tile_id, phrase_id FROM f WHERE model = (SELECT min(model) FROM f)),
p AS (SELECT k.task, count(*) pending FROM (SELECT DISTINCT task, tile_id, phrase_id FROM f) k LEFT JOIN d ON d.task = k.task AND d.tile_id = k.tile_id AND d.phrase_id = k.phrase_id WHERE d.task IS NULL GROUP BY 1)
SELECT task, coalesce(pending, 0) AS pending, coalesce(repeated, 0) AS repeated FROM p FULL JOIN o USING (task) WHERE task IS NOT NULL""",
    "top_pair": f"""WITH d AS ({T["d4_dominance"]}), l AS (SELECT tile_id, unnest([coalesce(trend, -1), coalesce(seasonal, -1), coalesce(acceleration, -1)]) v, unnest([0, 1, 2]) k, unnest(['trend', 'seasonal', 'acceleration']) n FROM d),
t AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY tile_id ORDER BY round(v, 6) DESC, k) <= 2) SELECT tile_id, string_agg(n, '_and_' ORDER BY n) AS pair FROM t GROUP BY 1""",
    "residual_rms": f"""WITH {tile_tasks._AXIS}, sy AS (SELECT tile_id, point_idx, y, 2019.0 + (step + 8) * 6.0 / 365.25 t FROM st), l AS (SELECT tile_id, point_idx, regr_slope(y, t) sl, regr_intercept(y, t) ic FROM sy GROUP BY 1, 2 HAVING count(*) >= 50)
SELECT sy.tile_id, sy.point_idx, round(sqrt(avg((y - sl * t - ic) * (y - sl * t - ic))), 5) AS rms FROM sy JOIN l ON l.tile_id = sy.tile_id AND l.point_idx = sy.point_idx GROUP BY 1, 2""",
    "subsample_seeds": "SELECT tile_id, draw, CAST('0x' || substr(sha1(tile_id || ':0.2:' || draw), 1, 8) AS BIGINT) AS seed FROM (SELECT DISTINCT tile_id FROM split_manifest WHERE tile_id IS NOT NULL), range(5) g(draw)",
    "label_texts": f"{_R}, l AS (SELECT DISTINCT label, {_HUMAN.format('label')} h FROM ({_LABELS})) SELECT label, upper(h[1]) || h[2:] AS first, lower(h[1]) || h[2:] AS inside FROM l",
    "cell_texts": f"SELECT tile_id, CASE WHEN c13_cell LIKE 'r%' THEN 'row ' || regexp_extract(c13_cell, '^r(\\d+)c(\\d+)$', 1) || ', column ' || regexp_extract(c13_cell, '^r(\\d+)c(\\d+)$', 2) ELSE 'no cell' END AS place FROM ({T['c1_dominant_cell']})",
    "label_aliases": f"""{_R}, l AS ({_LABELS}), k AS (SELECT l.*, {_HUMAN.format('label')} h, task_name FROM l JOIN task_catalog c ON c.task_id = l.task)
SELECT task, label, label AS alias FROM k UNION SELECT task, label, h FROM k UNION SELECT task, label, 'the ' || task_name || ' is ' || h FROM k""",
    "numeric_target_stats": " UNION ALL ".join(
        f"SELECT '{c}' AS target, round(avg(v), 6) AS mean, round(greatest(stddev_pop(v), 1e-6), 6) AS std, count(v) AS n_valid, count(*) FILTER (WHERE v IS NULL) AS n_missing FROM (SELECT DISTINCT tile_id, {_SPLIT} split, CASE WHEN isnan({c}) THEN NULL ELSE {c} END v, run_day FROM {n} WHERE tile_id IS NOT NULL) WHERE split = 'train'"
        for n, c in (("b3_final_table", B33), ("b5_final_table", B51))
    ),
    "family_medians": f"""WITH s AS (SELECT task, greatest(-1.0, least(1.0, r2)) score FROM ({C["eval_numeric_metrics"]}) UNION ALL SELECT task, balanced_accuracy FROM ({C["eval_balanced_accuracy"]}))
SELECT substr(task, 1, 1) AS family, count(*) AS tasks, round(avg(score), 5) AS mean, round(quantile_cont(score, 0.5), 5) AS median FROM s WHERE score IS NOT NULL GROUP BY 1""",
    "shuffled_tokens": f"""WITH {tile_tasks._vectors_sql("token_idx = 0")}, o AS (SELECT tile_id, lead(tile_id) OVER w nx, first_value(tile_id) OVER w fs FROM v WHERE split IS NOT NULL WINDOW w AS (PARTITION BY split ORDER BY md5(tile_id), tile_id))
SELECT tile_id, coalesce(nx, fs) AS summary_of FROM o""",
    "cycle_rows": f"""WITH t AS (SELECT tile_id, min({_SPLIT}) split FROM split_manifest WHERE tile_id IS NOT NULL GROUP BY 1), q AS (SELECT t.split, t.tile_id, c.task_id, ({corpus_tasks._FNV} + 1) % 5 AS phrase_id FROM t, task_catalog c),
p AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY md5(task_id || '|' || tile_id || '|5'), tile_id) place FROM q)
SELECT split, task_id, tile_id, phrase_id, {_HEX.format("task_id || '|' || tile_id || '|1'")} % 10 AS part FROM p WHERE task_id NOT LIKE 'X%' OR place <= 30""",
    "refusal_rows": f"""WITH {_ROWS}, x AS (SELECT tile_id, task_id, p AS phrase_id, replace({_ARRAY(WRAPPERS)}[p // 3 % 4 + 1], '{{e}}', {_ARRAY(EXAMPLES)}[p % 3 + 1]) a FROM c, range(12) g(p) WHERE task_id LIKE 'X%')
SELECT tile_id, task_id, phrase_id, upper(a[1]) || a[2:] AS answer FROM x""",
    "value_bins": f"""WITH b AS ({T["b5_seasonality"]}), q AS (SELECT {_EDGES}, count(b51_p90) n FROM b WHERE split = 'train'),
e AS (SELECT n, CASE WHEN len(list_distinct([{_ALL_EDGES}])) = 9 THEN [{_ALL_EDGES}] ELSE [q0 + (q8 - q0) * i / 8 for i in range(9)] END w FROM q)
SELECT tile_id, CASE WHEN n >= 40 AND b51_p90 IS NOT NULL THEN 'cp_bin_0' || ({" + ".join(f"CAST(b51_p90 >= w[{i + 1}] AS INTEGER)" for i in range(1, 8))}) END AS bin FROM b, e""",
}
