"""Queries over whole tables of targets: joins and their checks, label tables, profiles, question rows, scores and samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadrille.functions import answers, classify, stats
from quadrille.functions.hashing import fnv1a
from quadrille.operators import keyed, mixture, sampling
from quadrille.plans import tile_tasks
from quadrille.session import cut
from quadrille.sources.tables import clean_split, finite, nan_to_null, table, tile_of_path
from quadrille.streaming.windows import windowed

CLASSES = ("low", "typ_low", "typ_high", "high", "extreme")
B33, B51 = "B33_vel_abs_p90_mm_yr", "B51_seasonality_p90"


def _b3(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "b3_final_table").select("tile_id", clean_split(F.col("split")).alias("split"), nan_to_null(F.col(B33)).alias("v"), F.col("B36_european_velocity_typicality").alias("kind"), "run_day").distinct()


def class_counts_by_split(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of every class in every split, zero where there is none."""
    b = _b3(spark, sf).where("split is not null")
    frame = b.select("split").distinct().withColumn("kind", F.explode(F.array(*map(F.lit, CLASSES))))
    return frame.join(b.groupBy("split", "kind").agg(F.count("*").alias("n")), ["split", "kind"], "left").fillna(0, ["n"])


def crosstab_split_class(spark: SparkSession, sf: str) -> DataFrame:
    return _b3(spark, sf).where("split is not null").groupBy("split").pivot("kind", list(CLASSES)).agg(F.count("tile_id")).fillna(0)


def class_shares(spark: SparkSession, sf: str) -> DataFrame:
    c = _b3(spark, sf).where("kind is not null").groupBy("kind").agg(F.count("*").alias("n"))
    return c.join(F.broadcast(c.agg(F.sum("n").alias("total")))).select("kind", "n", F.round(F.col("n") / F.col("total"), 9).alias("share"))


PROFILE = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


def describe_profile(spark: SparkSession, sf: str) -> DataFrame:
    b = _b3(spark, sf).where("split is not null and v is not null")
    q = stats.percentiles(b, ["split"], {"v": F.col("v")}, PROFILE)
    m = b.groupBy("split").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("least"), F.max("v").alias("most"))
    return m.join(q, "split").select("split", "n", *[F.round(c, 6).alias(c) for c in ("mean", "std", "least", "most", *(f"v_{stats.tag(p)}" for p in PROFILE))])


def moments(spark: SparkSession, sf: str) -> DataFrame:
    b = _b3(spark, sf).where("split is not null and v is not null").withColumn("l", F.log1p("v"))
    return b.groupBy("split").agg(F.round(F.avg("l"), 6).alias("mean"), F.round(F.stddev_samp("l"), 6).alias("std"), F.round(F.skewness("l"), 5).alias("skew"), F.round(F.kurtosis("l"), 5).alias("kurtosis"))


def _average_rank(df: DataFrame, value: str, name: str) -> DataFrame:
    """Average ranks by counted values: equal values meet before the sorted ranges."""
    c = df.groupBy(value).agg(F.count("*").alias("n"))
    upto, _ = stats.running(c, [value], "n", "upto")
    return df.join(upto.select(value, (F.col("upto") - (F.col("n") - 1) / 2).alias(name)), value)


def correlations(spark: SparkSession, sf: str) -> DataFrame:
    """Pearson and Spearman correlation of tail velocity and seasonality over tiles and days."""
    b = table(spark, sf, "b5_final_table").select("tile_id", "run_day", nan_to_null(F.col(B51)).alias("w")).distinct().where("w is not null")
    j = _b3(spark, sf).where("v is not null").select("tile_id", "run_day", "v").join(b, ["tile_id", "run_day"])
    r = _average_rank(_average_rank(j, "v", "rv"), "w", "rw")
    return r.agg(F.count("*").alias("n"), F.round(F.corr("v", "w"), 6).alias("pearson"), F.round(F.corr("rv", "rw"), 6).alias("spearman"))


def train_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    q = stats.train_quantiles(_b3(spark, sf).where("v is not null"), {"v": (0.1, 0.5, 0.75, 0.9, 0.95, 0.99)})
    return q.select(*[F.round(c, 6).alias(c) for c in q.columns])


def calibrated_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Every row's class between the training rows' quantiles, for one reference day's borders."""
    b = _b3(spark, sf).where("v is not null")
    q = stats.train_quantiles(b, {"v": (0.75, 0.95, 0.99)})
    kind = classify.at_most(F.col("v"), [F.col("v_p75"), F.col("v_p95"), F.col("v_p99")], ("stable", "mild", "high", "extreme"))
    return b.join(F.broadcast(q)).withColumn("band", kind).groupBy("split", "band").agg(F.count("*").alias("n"))


def strict_join_audit(spark: SparkSession, sf: str) -> DataFrame:
    a, b = table(spark, sf, "b3_final_table"), table(spark, sf, "b5_final_table")
    return keyed.audit(a, b, ("tile_id", "run_day"))


def key_difference(spark: SparkSession, sf: str) -> DataFrame:
    """Tiles that only the manifest or only the points have."""
    return keyed.key_difference(table(spark, sf, "split_manifest"), table(spark, sf, "tile_points"), ("tile_id",))


def repeated_keys(spark: SparkSession, sf: str) -> DataFrame:
    return keyed.duplicates(table(spark, sf, "s1_final_table"), ("tile_id", "split")).withColumnRenamed("count", "n")


def manifest_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Each tile of the manifest once per split, its latest row, with the path in one spelling and what is wrong with it."""
    m = table(spark, sf, "split_manifest").withColumn("split", clean_split(F.col("split")))
    last = m.groupBy("tile_id", "split").agg(F.max(F.struct("ingested_at", "path", "grid_id", "n_points", "centroid_x", "centroid_y")).alias("r"), F.count("*").alias("n_rows"))
    located = finite(F.col("r.centroid_x")) & finite(F.col("r.centroid_y")) & ~((F.col("r.centroid_x") == 0) & (F.col("r.centroid_y") == 0))
    found = tile_of_path(F.col("r.path"))
    return last.select(
        "tile_id", "split", "n_rows", F.concat(F.lit("data/tiles/"), F.coalesce(found, "tile_id"), F.lit(".npz")).alias("path"),
        F.coalesce("r.grid_id", F.regexp_extract("tile_id", r"^([A-Z]\d+[A-Z]\d+)_", 1)).alias("grid_id"),
        (~F.coalesce(located, F.lit(False))).alias("no_centre"), F.coalesce(found != F.col("tile_id"), F.lit(False)).alias("other_path"), F.col("split").isin("train", "val", "test").alias("legal_split"),
    )


def manifest_points(spark: SparkSession, sf: str) -> DataFrame:
    """Points and centre of every tile as the points have them."""
    p = tile_tasks.placed(spark, sf)
    return p.groupBy("tile_id").agg(F.count("*").alias("n_points"), F.round(F.avg("x"), 3).alias("centroid_x"), F.round(F.avg("y"), 3).alias("centroid_y"))


def token_validation(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of the token table by what is wrong with their vector."""
    t = table(spark, sf, "egms_tokens").select("token_idx", "valid", "vec")
    bad = F.exists("vec", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    kind = (
        F.when(~F.col("valid"), F.when(F.col("vec").isNull(), "invalid").otherwise("invalid_with_vector"))
        .when(F.col("vec").isNull(), "no_vector").when(F.size("vec") != 256, "wrong_size").when(bad, "not_finite").when(F.forall("vec", lambda v: v == 0), "all_zero").otherwise("usable")
    )
    return t.groupBy(F.when(F.col("token_idx") == 0, "summary").otherwise("cell").alias("token"), kind.alias("state")).agg(F.count("*").alias("n"))


def labels_wide(spark: SparkSession, sf: str) -> DataFrame:
    """Targets of all tiles with a split in one table, joined only if their keys agree."""
    # The points are read and cleared of repeats once, and the tables put together in one shuffle.
    p = cut(tile_tasks.points(spark, sf, "x", "y", "mean_velocity", "rmse", "acceleration", "seasonality"))
    parts = (tile_tasks.b3_tails, tile_tasks.b4_acceleration, tile_tasks.b5_seasonality, tile_tasks.a4_noise, tile_tasks.c1_moving_extent, tile_tasks.c2_concentration)
    return keyed.assemble({f.__name__: f(spark, sf, p).where("split is not null") for f in parts})


def _long(wide: DataFrame) -> DataFrame:
    numbers = [c for c, k in wide.dtypes if k == "double"]
    words = [c for c, k in wide.dtypes if k == "string" and c not in keyed.KEYS]
    rows = [F.struct(F.lit(c).alias("target"), nan_to_null(F.col(c)).alias("number"), F.lit(None).cast("string").alias("label")) for c in numbers]
    for c in words:
        # "none" is a class of its own; only these spellings are missing values.
        told = F.when(~F.lower(F.trim(c)).isin("", "nan", "<na>") & (F.trim(c) != "None"), F.trim(c))
        rows.append(F.struct(F.lit(c).alias("target"), F.lit(None).cast("double").alias("number"), told.alias("label")))
    return wide.select("tile_id", "split", F.inline(F.array(*rows)))


def labels_long(spark: SparkSession, sf: str) -> DataFrame:
    return _long(labels_wide(spark, sf))


def label_stats(spark: SparkSession, sf: str) -> DataFrame:
    long = labels_long(spark, sf)
    n = long.where("number is not null").groupBy("target").agg(F.count("*").alias("n"), F.round(F.avg("number"), 6).alias("mean"), F.round(F.stddev_pop("number"), 6).alias("std"))
    counts = long.where("label is not null").groupBy("target", "label").agg(F.count("*").alias("k"))
    c = counts.groupBy("target").agg(F.sum("k").alias("n"), F.count("*").cast("double").alias("classes"), F.round(F.max("k") / F.sum("k"), 6).alias("majority"), F.round(F.min("k") / F.sum("k"), 6).alias("minority"))
    return n.unionByName(c, allowMissingColumns=True)


AXES = {"quality": ("a4",), "motion": ("b33", "b41", "b51"), "spatial": ("c11", "c21", "c31", "c41"), "temporal": ("d31",)}


def s3_gap(spark: SparkSession, sf: str) -> DataFrame:
    """How rare a tile is among the training tiles by its vector, less how rare by its targets; and the axis it stands out on."""
    one = lambda f, old, new: f(spark, sf).select("tile_id", F.col(old).alias(new))
    parts = [
        one(tile_tasks.a4_noise, "a41_median", "a4"), one(tile_tasks.b3_tails, "b33_abs_p90", "b33"), one(tile_tasks.b4_acceleration, "b41_abs_p90", "b41"), one(tile_tasks.b5_seasonality, "b51_p90", "b51"),
        one(tile_tasks.c1_moving_extent, "c11_fraction", "c11"), one(tile_tasks.c2_concentration, "c21_gini", "c21"), one(tile_tasks.c3_front, "c31_strength", "c31"), one(tile_tasks.c4_fast_tail, "c41_fraction", "c41"),
        one(tile_tasks.d3_intensification, "d31_median", "d31"),
    ]
    base = tile_tasks.s2_isolation(spark, sf).select("tile_id", "split", F.col("s21_isolation").alias("s21"))
    wide = reduce(lambda a, b: a.join(b, "tile_id", "left"), parts, base)
    names = ["s21", *[c for cols in AXES.values() for c in cols]]
    # All ranks in one pass: values are stacked under their names and ranked within them.
    long = cut(wide.select("tile_id", "split", F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("v")) for c in names]))).where("v is not null"))
    ranked = _midranks(long)
    got = ranked.groupBy("tile_id", "split").agg(*[F.max(F.when(F.col("name") == c, 99 * F.col("rank"))).alias(c) for c in names])
    axes = {a: F.greatest(*[F.col(c) for c in cols]) if len(cols) > 1 else F.col(cols[0]) for a, cols in AXES.items()}
    known = [F.when(F.col(a).isNotNull(), 1).otherwise(0) for a in axes]
    got = cut(got.withColumns(axes)).withColumn("mean", reduce(lambda a, b: a + b, [F.coalesce(F.col(a), F.lit(0.0)) for a in axes]) / F.nullif(reduce(lambda a, b: a + b, known), F.lit(0)))
    mean = _midranks(got.select("tile_id", "split", F.lit("mean").alias("name"), F.round("mean", 9).alias("v")).where("v is not null")).select("tile_id", F.col("rank").alias("m"))
    got = got.join(mean, "tile_id").withColumn("gap", F.round(F.col("s21") - 99 * F.col("m"), 9))
    band = got.where("split = 'train'").agg(F.avg("gap").alias("mu"), F.stddev_samp("gap").alias("sd"))
    g, mu, sd = F.col("gap"), F.col("mu"), F.col("sd")
    relation = (
        F.when(g <= mu - 1.96 * sd, "strong_monitoring_excess").when(g <= mu - sd, "moderate_monitoring_excess").when(g >= mu + 1.96 * sd, "strong_encoder_excess")
        .when(g >= mu + sd, "moderate_encoder_excess").otherwise("aligned")
    )
    top = F.greatest(*[F.coalesce(F.round(a, 9), F.lit(-1.0)) for a in AXES])
    first = reduce(lambda c, a: c.when(F.round(a, 9) == top, a), list(AXES)[1:], F.when(F.round("quality", 9) == top, "quality"))
    return got.join(F.broadcast(band)).select("tile_id", "split", F.round("gap", 6).alias("s31_gap"), relation.alias("s32_relation"), first.alias("s33_axis"))


def _midranks(long: DataFrame) -> DataFrame:
    """long with rank: ((below + up to) / 2 + 0.5) / n among the training rows of the same name, at most 1."""
    c = long.groupBy("name", "v").agg(F.count_if(F.col("split") == "train").alias("k"))
    upto = F.sum("k").over(Window.partitionBy("name").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("k").over(Window.partitionBy("name"))
    rank = F.least(((2 * upto - F.col("k")) / 2 + 0.5) / total, F.lit(1.0))
    return long.join(c.select("name", "v", rank.alias("rank")), ["name", "v"])


PHRASES = ("What is the {t}?", "Please report the {t}.", "How large is the {t} here?", "State the {t}.", "Which {t} would you give?")


def _phrase_number(cycle: int) -> Column:
    return (fnv1a(F.concat("tile_id", F.lit("|"), "task_id")) + cycle) % len(PHRASES)


def question_rows(spark: SparkSession, sf: str, cycle: int = 0) -> DataFrame:
    """One question for every tile of the manifest and task of the fixed catalog; the phrase is chosen by hash and moves on with the cycle."""
    tiles = table(spark, sf, "split_manifest").where("tile_id is not null").select("tile_id").distinct()
    tasks = F.broadcast(table(spark, sf, "task_catalog").select("task_id", "task_name"))
    rows = tiles.join(tasks).withColumn("phrase_id", _phrase_number(cycle))
    text = F.replace(F.element_at(F.array(*map(F.lit, PHRASES)), (F.col("phrase_id") + 1).cast("int")), F.lit("{t}"), F.col("task_name"))
    return rows.select("tile_id", "task_id", "phrase_id", text.alias("question"))


def question_counts(spark: SparkSession, sf: str) -> DataFrame:
    return question_rows(spark, sf, 3).groupBy("task_id", "phrase_id").agg(F.count("*").alias("n"))


def rendered_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Question and answer rows of the tail velocity: number, or what is said where there is none."""
    b = tile_tasks.b3_tails(spark, sf).select("tile_id", "split", F.round("b33_abs_p90", 2).alias("v"))
    text = F.when(F.col("v").isNull(), "No valid value exists for this tile.").otherwise(F.concat(F.lit("The absolute tail velocity is "), F.col("v").cast("string"), F.lit(" mm/yr.")))
    return b.select("tile_id", "split", text.alias("answer"), F.when(F.col("v").isNull(), "missing").otherwise("numeric").alias("answer_type"))


def _records(spark: SparkSession, sf: str) -> DataFrame:
    keep = ["task", "model", "answer_type", "rendered_target_value", "llm_output"]
    r = table(spark, sf, "eval_records").where("record_id is not null")
    return r.groupBy("record_id").agg(F.max(F.struct("evaluated_at", *keep)).alias("r")).select("record_id", *[F.col(f"r.{c}") for c in keep])


def _numeric(spark: SparkSession, sf: str) -> DataFrame:
    """task, model, gold, pred: the number in front of a unit, else the first number."""
    text = F.regexp_replace(F.coalesce("llm_output", F.lit("")), r"(\d),(\d)", "$1.$2")
    unit, plain = F.regexp_extract(text, r"(-?\d+(?:\.\d+)?) ?(?:mm|days)", 1), F.regexp_extract(text, r"(-?\d+(?:\.\d+)?)", 1)
    r = _records(spark, sf).where("answer_type = 'numeric'")
    return r.select("task", "model", F.col("rendered_target_value").try_cast("double").alias("gold"), F.coalesce(F.nullif(unit, F.lit("")), F.nullif(plain, F.lit(""))).try_cast("double").alias("pred")).where("gold is not null")


def _scores(df: DataFrame, by: list[str]) -> DataFrame:
    e = F.col("pred") - F.col("gold")
    ok = F.col("pred").isNotNull()
    gold = F.when(ok, F.col("gold"))
    total = F.var_pop(gold) * F.count("pred")
    return df.groupBy(*by).agg(
        F.count("*").alias("n"), F.count("pred").alias("n_pred"), F.round(F.avg(F.abs(e)), 6).alias("mae"), F.round(F.sqrt(F.avg(e * e)), 6).alias("rmse"),
        F.round(F.when(total > 1e-12, 1 - F.sum(e * e) / total), 5).alias("r2"), F.round(F.avg(F.when(ok & (F.abs(e) <= 1e-9), 1.0).otherwise(0.0)), 6).alias("exact"),
    )


def eval_numeric_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return _scores(_numeric(spark, sf), ["task"])


def eval_value_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """Share of numeric answers within half a unit of the last rendered decimal."""
    text = F.regexp_replace(F.coalesce("llm_output", F.lit("")), r"(\d),(\d)", "$1.$2")
    unit, plain = F.regexp_extract(text, r"(-?\d+(?:\.\d+)?) ?(?:mm|days)", 1), F.regexp_extract(text, r"(-?\d+(?:\.\d+)?)", 1)
    decimals = F.length(F.regexp_extract("rendered_target_value", r"\.(\d+)$", 1))
    r = _records(spark, sf).where("answer_type = 'numeric'").select(
        "task", F.col("rendered_target_value").try_cast("double").alias("gold"), F.coalesce(F.nullif(unit, F.lit("")), F.nullif(plain, F.lit(""))).try_cast("double").alias("pred"), (0.5 * F.pow(F.lit(10.0), -decimals)).alias("tol")
    )
    ok = F.coalesce(F.abs(F.col("pred") - F.col("gold")) <= F.col("tol") + 1e-9, F.lit(False))
    return r.where("gold is not null").groupBy("task").agg(F.count("*").alias("n"), F.round(F.avg(ok.cast("int")), 6).alias("value_accuracy"), F.round(F.avg(F.col("pred").isNotNull().cast("int")), 6).alias("coverage"))


def eval_missing_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """Share of the questions without a value, by task, whose answer says so."""
    said = F.lower(F.coalesce("llm_output", F.lit(""))).rlike("|".join(answers.ABSENT))
    r = _records(spark, sf).where("answer_type = 'missing' and task is not null")
    return r.groupBy("task").agg(F.count("*").alias("n"), F.round(F.avg(said.cast("int")), 6).alias("missing_accuracy"))


def eval_report_pivot(spark: SparkSession, sf: str) -> DataFrame:
    """Mean absolute error of every task, a column for each model."""
    models = [r[0] for r in table(spark, sf, "eval_records").where("model is not null").select("model").distinct().orderBy("model").limit(65).collect()]
    if len(models) > 64:
        raise ValueError("more than 64 models: their columns would not all fit")
    s = _scores(_numeric(spark, sf), ["task", "model"])
    return s.groupBy("task").pivot("model", models).agg(F.first("mae"))


def _categorical(spark: SparkSession, sf: str) -> DataFrame:
    """task, gold, ok: whether the longest class name of the task found in the answer is the right one."""
    r = _records(spark, sf).where("answer_type = 'categorical' and rendered_target_value is not null")
    names = r.select("task", F.col("rendered_target_value").alias("name")).distinct()
    text = F.concat(F.lit(" "), F.regexp_replace(F.lower(F.coalesce("llm_output", F.lit(""))), r"[^a-z]+", " "), F.lit(" "))
    hit = F.instr(F.col("text"), F.concat(F.lit(" "), F.replace("name", F.lit("_"), F.lit(" ")), F.lit(" "))) > 0
    met = r.select("record_id", "task", F.col("rendered_target_value").alias("gold"), text.alias("text")).join(names, "task").where(hit)
    best = met.groupBy("record_id").agg(F.max(F.struct(F.length("name").alias("l"), "name")).alias("b")).select("record_id", F.col("b.name").alias("pred"))
    return r.select("record_id", "task", F.col("rendered_target_value").alias("gold")).join(best, "record_id", "left").select("task", "gold", F.when(F.col("pred") == F.col("gold"), 1.0).otherwise(0.0).alias("ok"))


def eval_balanced_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    c = _categorical(spark, sf).groupBy("task", "gold").agg(F.avg("ok").alias("recall"), F.sum("ok").alias("right"), F.count("*").alias("k"))
    return c.groupBy("task").agg(F.round(F.avg("recall"), 6).alias("balanced_accuracy"), F.round(F.sum("right") / F.sum("k"), 6).alias("accuracy"), F.sum("k").alias("n"), F.count("*").alias("classes"))


def eval_family_macro(spark: SparkSession, sf: str) -> DataFrame:
    """Bounded scores averaged within families of tasks and over all."""
    n = eval_numeric_metrics(spark, sf).select("task", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("r2"))).alias("score"))
    s = n.unionByName(eval_balanced_accuracy(spark, sf).select("task", F.col("balanced_accuracy").alias("score"))).where("score is not null")
    f = s.groupBy(F.substring("task", 1, 1).alias("family")).agg(F.count("*").alias("tasks"), F.round(F.avg("score"), 5).alias("mean_score"))
    return f.unionByName(s.agg(F.lit("all").alias("family"), F.count("*").alias("tasks"), F.round(F.avg("score"), 5).alias("mean_score")))


UNITS = {"A41": ("mm", 0, None), "B21": ("mm/yr", None, None), "B33": ("mm/yr", 0, None), "B51": ("mm", 0, None), "C11": (None, 0, None), "C31": ("mm/yr", 0, None), "D23": ("days", 0, None)}


def extract_answers(spark: SparkSession, sf: str) -> DataFrame:
    """What can be read out of every answer."""
    r = _records(spark, sf)
    names = r.where("answer_type = 'categorical' and rendered_target_value is not null").groupBy("task").agg(F.collect_set("rendered_target_value").alias("names"))
    return answers.extract(r.select("record_id", "task", F.col("llm_output").alias("text")), {x["task"]: sorted(x["names"]) for x in names.collect()}, UNITS)


def _keyed(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "tile_points").where("tile_id is not null and point_idx is not null").groupBy("tile_id", "point_idx").agg(F.max("rmse").alias("rmse"))


def sample_points(spark: SparkSession, sf: str) -> DataFrame:
    """Five points of every tile, by hash."""
    return sampling.per_group(_keyed(spark, sf), ["tile_id"], ["point_idx"], 5, 7).select("tile_id", "point_idx")


def sample_weighted(spark: SparkSession, sf: str) -> DataFrame:
    """Five points of every tile, the less noisy ones more often."""
    p = _keyed(spark, sf).withColumn("rmse", nan_to_null(F.col("rmse"))).where("rmse is not null")
    return sampling.weighted(p, ["tile_id"], ["point_idx"], 1 / (F.col("rmse") + 0.1), 5, 3).select("tile_id", "point_idx")


def sample_balanced(spark: SparkSession, sf: str) -> DataFrame:
    """Up to 40 records of every class task, its classes in turn."""
    r = _records(spark, sf).where("answer_type = 'categorical' and rendered_target_value is not null")
    return sampling.balanced(r, ["task"], "rendered_target_value", ["record_id"], 40, 1).select("task", "rendered_target_value", "record_id")


def question_sample_capped(spark: SparkSession, sf: str) -> DataFrame:
    """The questions meant to be declined, for at most 30 tiles of each task."""
    q = question_rows(spark, sf).where("task_id like 'X%'")
    return sampling.per_group(q, ["task_id"], ["tile_id"], 30, 5).select("task_id", "tile_id", "question")


def epoch_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Tiles of each split in the order of an epoch, eight to a batch."""
    t = tile_tasks.tiles(table(spark, sf, "tile_points").where("tile_id is not null")).where("split is not null")
    place = F.row_number().over(Window.partitionBy("split").orderBy(sampling.order("split", "tile_id", seed=2), "tile_id"))
    return t.withColumn("place", place).select("split", "tile_id", F.floor((F.col("place") - 1) / 8).cast("int").alias("batch"))


def s14_status(spark: SparkSession, sf: str, most: int = 6, starts: int = 20) -> DataFrame:
    """Mixture of distance and margin to the nearest anchor, its size chosen by BIC on the training tiles; the far and the undecided component get names."""
    split = tile_tasks.tiles(table(spark, sf, "tile_points").where("tile_id is not null"))
    s = cut(tile_tasks.s1_anchor(spark, sf).join(split, "tile_id").select("tile_id", "split", "s12_distance", "s13_margin").where("s12_distance is not null and s13_margin is not null"))
    train = s.where("split = 'train'")
    n, dm, ds, gm, gs = train.agg(F.count("*"), F.avg("s12_distance"), F.stddev_pop("s12_distance"), F.avg("s13_margin"), F.stddev_pop("s13_margin")).first()
    if not n:
        # Without a training tile there is no mixture.
        return s.select("tile_id", "split", F.lit(None).cast("string").alias("s14_status"))
    x, y = (F.col("s12_distance") - dm) / (ds or 1.0), (F.col("s13_margin") - gm) / (gs or 1.0)
    model = mixture.fit(cut(train.select(x.alias("x"), y.alias("y"))), min(most, n), starts)
    got = cut(s.withColumn("component", mixture.component(x, y, model)))
    medians = stats.percentiles(got.where("split = 'train'"), ["component"], {"d": F.col("s12_distance"), "g": F.col("s13_margin")}, [0.5]).orderBy("component").collect()
    far, undecided = max(medians, key=lambda r: r["d_p50"])["component"], min(medians, key=lambda r: r["g_p50"])["component"]
    strong = min(medians, key=lambda r: r["d_p50"] - r["g_p50"])["component"]
    status = F.when(F.col("component").isin(far, undecided), "far_or_ambiguous").when(F.col("component") == strong, "strongly_associated").otherwise("transition")
    return got.select("tile_id", "split", status.alias("s14_status"))


def shards(spark: SparkSession, sf: str) -> DataFrame:
    """Tiles dealt into 8 shards of nearly equal numbers of points, by contiguous ranges of ids."""
    p = table(spark, sf, "tile_points").where("tile_id is not null").groupBy("tile_id").agg(F.count("*").alias("n"))
    upto, total = stats.running(p, ["tile_id"], "n", "upto")
    return upto.select("tile_id", F.floor((F.col("upto") - F.col("n")) * 8 / F.lit(total)).cast("int").alias("shard"))


def rolling_mean(spark: SparkSession, sf: str) -> DataFrame:
    """Mean of each user's last five event values."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-4, 0)
    return table(spark, sf, "events").select("event_id", F.round(F.avg("value").over(w), 6).alias("mean5"))


def event_windows(spark: SparkSession, sf: str) -> DataFrame:
    w = windowed(table(spark, sf, "events"), "6 hours")
    return w.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


QUERIES = {
    f.__name__: f
    for f in (
        class_counts_by_split, crosstab_split_class, class_shares, describe_profile, moments, correlations, train_thresholds, calibrated_classes, strict_join_audit, key_difference,
        repeated_keys, manifest_scan, manifest_points, token_validation, labels_wide, labels_long, label_stats, s3_gap, question_rows, question_counts, rendered_answers,
        eval_numeric_metrics, eval_missing_accuracy, eval_report_pivot, eval_balanced_accuracy, eval_family_macro, extract_answers, eval_value_accuracy, sample_points, sample_weighted,
        sample_balanced, question_sample_capped, epoch_batches, s14_status, shards, rolling_mean, event_windows,
    )
}

T = tile_tasks.ORACLE
_B3 = f"b AS (SELECT DISTINCT tile_id, nullif(lower(trim(split)), '') split, CASE WHEN isnan({B33}) THEN NULL ELSE {B33} END v, B36_european_velocity_typicality kind, run_day FROM b3_final_table)"
_WIDE = " JOIN ".join(
    [f"({T['b3_tails']}) b3"] + [f"({T[n]}) {a} USING (tile_id, split)" for n, a in (("b4_acceleration", "b4"), ("b5_seasonality", "b5"), ("a4_noise", "a4"), ("c1_moving_extent", "c1"), ("c2_concentration", "c2"))]
)
_NUMBERS = ("b31_p10", "b32_p90", "b33_abs_p90", "b41_abs_p90", "b51_p90", "a41_median", "c11_fraction", "c21_gini")
_LABELS = ("b34_direction", "b35_significance", "b36_typicality", "b42_typicality", "a42_class", "c12_class", "c22_class")
_LONG = f"w AS (SELECT * FROM {_WIDE} WHERE split IS NOT NULL), l AS (" + " UNION ALL ".join(
    [f"SELECT tile_id, split, '{c}' AS target, {c} AS number, CAST(NULL AS VARCHAR) AS label FROM w" for c in _NUMBERS] + [f"SELECT tile_id, split, '{c}', NULL, {c} FROM w" for c in _LABELS]
) + ")"
_RECORDS = """r AS (SELECT record_id, task, model, answer_type, rendered_target_value, llm_output FROM eval_records WHERE record_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY evaluated_at DESC NULLS LAST, task DESC NULLS LAST, model DESC NULLS LAST, answer_type DESC NULLS LAST, rendered_target_value DESC NULLS LAST, llm_output DESC NULLS LAST) = 1)"""
_NUM = _RECORDS + r""", x AS (SELECT task, model, TRY_CAST(rendered_target_value AS DOUBLE) gold, regexp_replace(coalesce(llm_output, ''), '(\d),(\d)', '\1.\2', 'g') s FROM r WHERE answer_type = 'numeric'),
p AS (SELECT task, model, gold, TRY_CAST(coalesce(nullif(regexp_extract(s, '(-?\d+(?:\.\d+)?) ?(?:mm|days)', 1), ''), nullif(regexp_extract(s, '(-?\d+(?:\.\d+)?)', 1), '')) AS DOUBLE) pred FROM x WHERE gold IS NOT NULL)"""
_SCORE = """count(*) n, count(pred) n_pred, round(avg(abs(pred - gold)), 6) mae, round(sqrt(avg((pred - gold) * (pred - gold))), 6) rmse,
round(CASE WHEN var_pop(gold) FILTER (WHERE pred IS NOT NULL) * count(pred) > 1e-12 THEN 1 - sum((pred - gold) * (pred - gold)) / (var_pop(gold) FILTER (WHERE pred IS NOT NULL) * count(pred)) END, 5) r2,
round(avg(CASE WHEN abs(pred - gold) <= 1e-9 THEN 1.0::DOUBLE ELSE 0 END), 6) exact"""
_RECORDS_VALUE = f"WITH {_RECORDS}" + r""", x AS (SELECT task, rendered_target_value t, TRY_CAST(rendered_target_value AS DOUBLE) gold, regexp_replace(coalesce(llm_output, ''), '(\d),(\d)', '\1.\2', 'g') s FROM r WHERE answer_type = 'numeric'),
p AS (SELECT task, gold, 0.5 * power(10.0, -length(regexp_extract(t, '\.(\d+)$', 1))) tol, TRY_CAST(coalesce(nullif(regexp_extract(s, '(-?\d+(?:\.\d+)?) ?(?:mm|days)', 1), ''), nullif(regexp_extract(s, '(-?\d+(?:\.\d+)?)', 1), '')) AS DOUBLE) pred FROM x WHERE gold IS NOT NULL)
SELECT task, count(*) n, round(avg(CASE WHEN coalesce(abs(pred - gold) <= tol + 1e-9, FALSE) THEN 1.0::DOUBLE ELSE 0 END), 6) value_accuracy, round(avg(CASE WHEN pred IS NULL THEN 0.0::DOUBLE ELSE 1 END), 6) coverage FROM p GROUP BY 1"""
_CAT = _RECORDS + """, c AS (SELECT record_id, task, rendered_target_value gold, ' ' || regexp_replace(lower(coalesce(llm_output, '')), '[^a-z]+', ' ', 'g') || ' ' s FROM r WHERE answer_type = 'categorical' AND rendered_target_value IS NOT NULL),
m AS (SELECT c.record_id, n.name FROM c JOIN (SELECT DISTINCT task, gold AS name FROM c) n USING (task) WHERE instr(s, ' ' || replace(n.name, '_', ' ') || ' ') > 0 QUALIFY row_number() OVER (PARTITION BY c.record_id ORDER BY length(n.name) DESC, n.name DESC) = 1),
k AS (SELECT c.task, c.gold, avg(CASE WHEN m.name = c.gold THEN 1.0::DOUBLE ELSE 0 END) recall, sum(CASE WHEN m.name = c.gold THEN 1 ELSE 0 END) ok, count(*) k FROM c LEFT JOIN m USING (record_id) GROUP BY 1, 2)"""
_FNV = "list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(string_split(t.tile_id || '|' || c.task_id, ''), lambda z: CAST(ord(z) AS BIGINT))), lambda h, z: (xor(h, z) * 16777619) % 4294967296)"
_PHRASE_SQL = "[" + ", ".join(f"'{p}'" for p in PHRASES) + "]"


def _gap_sql() -> str:
    cols = {"a4": ("a4_noise", "a41_median"), "b33": ("b3_tails", "b33_abs_p90"), "b41": ("b4_acceleration", "b41_abs_p90"), "b51": ("b5_seasonality", "b51_p90"), "c11": ("c1_moving_extent", "c11_fraction"),
            "c21": ("c2_concentration", "c21_gini"), "c31": ("c3_front", "c31_strength"), "c41": ("c4_fast_tail", "c41_fraction"), "d31": ("d3_intensification", "d31_median")}
    joins = " ".join(f"LEFT JOIN (SELECT tile_id, {c} AS {a} FROM ({T[q]}) q_{a}) j_{a} USING (tile_id)" for a, (q, c) in cols.items())
    names = ["s21", *cols]
    rank = "least(((2 * sum(count(*) FILTER (WHERE split = 'train')) OVER (PARTITION BY name ORDER BY v) - count(*) FILTER (WHERE split = 'train')) / 2 + 0.5) / sum(count(*) FILTER (WHERE split = 'train')) OVER (PARTITION BY name), 1.0)"
    axis = {a: f"greatest({', '.join(c)})" if len(c) > 1 else c[0] for a, c in AXES.items()}
    ax = list(AXES)
    return f"""WITH w AS (SELECT s.tile_id, s.split, s21_isolation AS s21, {", ".join(cols)} FROM ({T["s2_isolation"]}) s {joins}),
l AS ({" UNION ALL ".join(f"SELECT tile_id, split, '{n}' AS name, {n} AS v FROM w WHERE {n} IS NOT NULL" for n in names)}),
r AS (SELECT name, v, {rank} AS rank FROM l GROUP BY name, v),
g AS (SELECT tile_id, split, {", ".join(f"max(CASE WHEN name = '{n}' THEN 99 * rank END) AS {n}" for n in names)} FROM l JOIN r USING (name, v) GROUP BY 1, 2),
a AS (SELECT *, {", ".join(f"{e} AS {a}" for a, e in axis.items())} FROM g),
n AS (SELECT *, ({" + ".join(f"coalesce({a}, 0)" for a in ax)}) / nullif({" + ".join(f"CASE WHEN {a} IS NULL THEN 0 ELSE 1 END" for a in ax)}, 0) AS mean FROM a),
m0 AS (SELECT tile_id, split, 'mean' AS name, round(mean, 9) AS v FROM n WHERE mean IS NOT NULL), m AS (SELECT v, {rank} AS m FROM m0 GROUP BY name, v),
q AS (SELECT n.*, round(s21 - 99 * m.m, 9) AS gap FROM n JOIN m0 USING (tile_id) JOIN m ON m0.v = m.v), b AS (SELECT avg(gap) mu, stddev_samp(gap) sd FROM q WHERE split = 'train'),
t AS (SELECT *, greatest({", ".join(f"coalesce(round({a}, 9), -1)" for a in ax)}) top FROM q)
SELECT tile_id, split, round(gap, 6) s31_gap, CASE WHEN gap <= mu - 1.96 * sd THEN 'strong_monitoring_excess' WHEN gap <= mu - sd THEN 'moderate_monitoring_excess' WHEN gap >= mu + 1.96 * sd THEN 'strong_encoder_excess'
WHEN gap >= mu + sd THEN 'moderate_encoder_excess' ELSE 'aligned' END s32_relation, CASE {" ".join(f"WHEN round({a}, 9) = top THEN '{a}'" for a in ax)} END s33_axis FROM t, b"""


ORACLE = {
    "class_counts_by_split": f"WITH {_B3} SELECT s.split, k.kind, count(b.tile_id) n FROM (SELECT DISTINCT split FROM b WHERE split IS NOT NULL) s CROSS JOIN (SELECT unnest({list(CLASSES)}) kind) k LEFT JOIN b ON b.split = s.split AND b.kind = k.kind GROUP BY 1, 2",
    "crosstab_split_class": f"WITH {_B3} SELECT split, {', '.join(f'''count(*) FILTER (WHERE kind = '{c}') AS {c}''' for c in CLASSES)} FROM b WHERE split IS NOT NULL GROUP BY 1",
    "class_shares": f"WITH {_B3} SELECT kind, count(*) n, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM b WHERE kind IS NOT NULL GROUP BY 1",
    "describe_profile": f"WITH {_B3} SELECT split, count(*) n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(min(v), 6) AS least, round(max(v), 6) AS most, {', '.join(f'round(quantile_cont(v, {p}), 6) AS v_{stats.tag(p)}' for p in PROFILE)} FROM b WHERE split IS NOT NULL AND v IS NOT NULL GROUP BY 1",
    "moments": f"""WITH {_B3}, l AS (SELECT split, ln(1 + v) l FROM b WHERE split IS NOT NULL AND v IS NOT NULL), m AS (SELECT split, avg(l) mu, stddev_pop(l) sd, stddev_samp(l) ss FROM l GROUP BY 1)
SELECT l.split, round(any_value(mu), 6) AS mean, round(any_value(ss), 6) AS std, round(avg(power((l - mu) / sd, 3)), 5) AS skew, round(avg(power((l - mu) / sd, 4)) - 3, 5) AS kurtosis FROM l JOIN m USING (split) GROUP BY 1""",
    "correlations": f"""WITH {_B3}, w AS (SELECT DISTINCT tile_id, run_day, {B51} w FROM b5_final_table WHERE {B51} IS NOT NULL AND NOT isnan({B51})), j AS (SELECT v, w FROM b JOIN w USING (tile_id, run_day) WHERE v IS NOT NULL),
r AS (SELECT v, w, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 rv, rank() OVER (ORDER BY w) + (count(*) OVER (PARTITION BY w) - 1) / 2.0 rw FROM j) SELECT count(*) n, round(corr(v, w), 6) pearson, round(corr(rv, rw), 6) spearman FROM r""",
    "train_thresholds": f"WITH {_B3} SELECT {', '.join(f'round(quantile_cont(v, {q}), 6) AS v_{stats.tag(q)}' for q in (0.1, 0.5, 0.75, 0.9, 0.95, 0.99))} FROM b WHERE split = 'train' AND v IS NOT NULL",
    "calibrated_classes": f"WITH {_B3}, q AS (SELECT quantile_cont(v, 0.75) a, quantile_cont(v, 0.95) z, quantile_cont(v, 0.99) y FROM b WHERE split = 'train' AND v IS NOT NULL) SELECT split, CASE WHEN v <= a THEN 'stable' WHEN v <= z THEN 'mild' WHEN v <= y THEN 'high' ELSE 'extreme' END AS band, count(*) n FROM b, q WHERE v IS NOT NULL GROUP BY 1, 2",
    "strict_join_audit": """WITH a AS (SELECT tile_id, run_day, count(*) c FROM b3_final_table GROUP BY 1, 2), b AS (SELECT tile_id, run_day, count(*) c FROM b5_final_table GROUP BY 1, 2)
SELECT (SELECT CAST(coalesce(sum(c) FILTER (WHERE tile_id IS NULL OR run_day IS NULL), 0) AS BIGINT) FROM a) left_null, (SELECT count(*) FROM a WHERE c > 1) left_repeated, (SELECT CAST(coalesce(sum(c) FILTER (WHERE tile_id IS NULL OR run_day IS NULL), 0) AS BIGINT) FROM b) right_null,
(SELECT count(*) FROM b WHERE c > 1) right_repeated, (SELECT count(*) FROM (SELECT tile_id, run_day FROM a EXCEPT SELECT tile_id, run_day FROM b)) left_only, (SELECT count(*) FROM (SELECT tile_id, run_day FROM b EXCEPT SELECT tile_id, run_day FROM a)) right_only""",
    "key_difference": "SELECT tile_id, 'left' AS side FROM (SELECT tile_id FROM split_manifest EXCEPT SELECT tile_id FROM tile_points) UNION ALL SELECT tile_id, 'right' FROM (SELECT tile_id FROM tile_points EXCEPT SELECT tile_id FROM split_manifest)",
    "repeated_keys": "SELECT tile_id, split, count(*) AS n FROM s1_final_table GROUP BY 1, 2 HAVING count(*) > 1",
    "manifest_scan": r"""WITH m AS (SELECT *, nullif(lower(trim(split)), '') sp FROM split_manifest), l AS (SELECT *, count(*) OVER (PARTITION BY tile_id, sp) k FROM m
  QUALIFY row_number() OVER (PARTITION BY tile_id, sp ORDER BY ingested_at DESC NULLS LAST, path DESC NULLS LAST, grid_id DESC NULLS LAST, n_points DESC NULLS LAST, centroid_x DESC NULLS LAST, centroid_y DESC NULLS LAST) = 1),
f AS (SELECT *, nullif(regexp_extract(path, '([A-Z]\d+[A-Z]\d+_x\d+_y\d+)', 1), '') found FROM l)
SELECT tile_id, sp AS split, k AS n_rows, 'data/tiles/' || coalesce(found, tile_id) || '.npz' AS path, coalesce(grid_id, regexp_extract(tile_id, '^([A-Z]\d+[A-Z]\d+)_', 1)) AS grid_id,
NOT coalesce(isfinite(centroid_x) AND isfinite(centroid_y) AND NOT (centroid_x = 0 AND centroid_y = 0), FALSE) AS no_centre, coalesce(found <> tile_id, FALSE) AS other_path, sp IN ('train', 'val', 'test') AS legal_split FROM f""",
    "manifest_points": f"WITH {tile_tasks.P} SELECT tile_id, count(*) n_points, round(avg(x), 3) centroid_x, round(avg(y), 3) centroid_y FROM g GROUP BY 1",
    "token_validation": """SELECT CASE WHEN token_idx = 0 THEN 'summary' ELSE 'cell' END AS token, CASE WHEN NOT valid THEN CASE WHEN vec IS NULL THEN 'invalid' ELSE 'invalid_with_vector' END WHEN vec IS NULL THEN 'no_vector' WHEN len(vec) <> 256 THEN 'wrong_size'
WHEN len(list_filter(vec, lambda z: z IS NULL OR NOT isfinite(z))) > 0 THEN 'not_finite' WHEN len(list_filter(vec, lambda z: z <> 0)) = 0 THEN 'all_zero' ELSE 'usable' END AS state, count(*) AS n FROM egms_tokens GROUP BY 1, 2""",
    "labels_wide": f"SELECT * FROM {_WIDE} WHERE split IS NOT NULL",
    "labels_long": f"WITH {_LONG} SELECT * FROM l",
    "label_stats": f"""WITH {_LONG}, c AS (SELECT target, label, count(*) k FROM l WHERE label IS NOT NULL GROUP BY 1, 2)
SELECT target, count(*) n, round(avg(number), 6) AS mean, round(stddev_pop(number), 6) AS std, CAST(NULL AS DOUBLE) AS classes, CAST(NULL AS DOUBLE) AS majority, CAST(NULL AS DOUBLE) AS minority FROM l WHERE number IS NOT NULL GROUP BY 1
UNION ALL SELECT target, CAST(sum(k) AS BIGINT), NULL, NULL, CAST(count(*) AS DOUBLE), round(max(k) / sum(k), 6), round(min(k) / sum(k), 6) FROM c GROUP BY 1""",
    "s3_gap": _gap_sql(),
    "question_rows": f"""WITH t AS (SELECT DISTINCT tile_id FROM split_manifest WHERE tile_id IS NOT NULL), q AS (SELECT t.tile_id, c.task_id, c.task_name, {_FNV} % 5 AS phrase_id FROM t, task_catalog c)
SELECT tile_id, task_id, phrase_id, replace({_PHRASE_SQL}[phrase_id + 1], '{{t}}', task_name) AS question FROM q""",
    "question_counts": f"WITH t AS (SELECT DISTINCT tile_id FROM split_manifest WHERE tile_id IS NOT NULL), q AS (SELECT c.task_id, ({_FNV} + 3) % 5 AS phrase_id FROM t, task_catalog c) SELECT task_id, phrase_id, count(*) AS n FROM q GROUP BY 1, 2",
    "rendered_answers": f"""WITH b AS (SELECT tile_id, split, round(b33_abs_p90, 2) v FROM ({T['b3_tails']}) q) SELECT tile_id, split, CASE WHEN v IS NULL THEN 'No valid value exists for this tile.' ELSE 'The absolute tail velocity is ' || CAST(v AS VARCHAR) || ' mm/yr.' END AS answer,
CASE WHEN v IS NULL THEN 'missing' ELSE 'numeric' END AS answer_type FROM b""",
    "eval_numeric_metrics": f"WITH {_NUM} SELECT task, {_SCORE} FROM p GROUP BY 1",
    "eval_balanced_accuracy": f"WITH {_CAT} SELECT task, round(avg(recall), 6) balanced_accuracy, round(sum(ok) / sum(k), 6) accuracy, CAST(sum(k) AS BIGINT) n, count(*) classes FROM k GROUP BY 1",
    "eval_family_macro": f"""WITH s AS (SELECT task, greatest(-1.0, least(1.0, r2)) score FROM (WITH {_NUM} SELECT task, {_SCORE} FROM p GROUP BY 1) a WHERE r2 IS NOT NULL UNION ALL SELECT task, b FROM (WITH {_CAT} SELECT task, round(avg(recall), 6) b FROM k GROUP BY 1) c)
SELECT substr(task, 1, 1) AS family, count(*) AS tasks, round(avg(score), 5) AS mean_score FROM s GROUP BY 1 UNION ALL SELECT 'all', count(*), round(avg(score), 5) FROM s""",
    "eval_value_accuracy": _RECORDS_VALUE,
    "question_sample_capped": f"""WITH t AS (SELECT DISTINCT tile_id FROM split_manifest WHERE tile_id IS NOT NULL), q AS (SELECT t.tile_id, c.task_id, c.task_name, {_FNV} % 5 AS phrase_id FROM t, task_catalog c WHERE c.task_id LIKE 'X%')
SELECT task_id, tile_id, replace({_PHRASE_SQL}[phrase_id + 1], '{{t}}', task_name) AS question FROM q QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY md5(task_id || '|' || tile_id || '|5'), tile_id) <= 30""",
    "epoch_batches": "WITH t AS (SELECT tile_id, max(split) split FROM tile_points WHERE tile_id IS NOT NULL GROUP BY 1) SELECT split, tile_id, CAST((row_number() OVER (PARTITION BY split ORDER BY md5(split || '|' || tile_id || '|2'), tile_id) - 1) // 8 AS INTEGER) AS batch FROM t WHERE split IS NOT NULL",
    "sample_points": "WITH k AS (SELECT DISTINCT tile_id, point_idx FROM tile_points WHERE tile_id IS NOT NULL AND point_idx IS NOT NULL) SELECT tile_id, point_idx FROM k QUALIFY row_number() OVER (PARTITION BY tile_id ORDER BY md5(tile_id || '|' || point_idx || '|7'), point_idx) <= 5",
    "sample_weighted": """WITH k AS (SELECT tile_id, point_idx, max(rmse) w FROM tile_points WHERE tile_id IS NOT NULL AND point_idx IS NOT NULL GROUP BY 1, 2),
u AS (SELECT tile_id, point_idx, -ln((CAST('0x' || substr(md5(tile_id || '|' || point_idx || '|3'), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE) / (1 / (CAST(w AS DOUBLE) + 0.1::DOUBLE)) clock FROM k WHERE w IS NOT NULL AND NOT isnan(w))
SELECT tile_id, point_idx FROM u QUALIFY row_number() OVER (PARTITION BY tile_id ORDER BY clock, point_idx) <= 5""",
    "sample_balanced": f"""WITH {_RECORDS}, t AS (SELECT task, rendered_target_value, record_id, row_number() OVER (PARTITION BY task, rendered_target_value ORDER BY md5(task || '|' || rendered_target_value || '|' || record_id || '|1'), record_id) turn FROM r WHERE answer_type = 'categorical' AND rendered_target_value IS NOT NULL)
SELECT task, rendered_target_value, record_id FROM t WHERE turn <= 40 QUALIFY row_number() OVER (PARTITION BY task ORDER BY turn, rendered_target_value) <= 40""",
    "shards": "WITH p AS (SELECT tile_id, count(*) n FROM tile_points WHERE tile_id IS NOT NULL GROUP BY 1) SELECT tile_id, CAST(floor((sum(n) OVER (ORDER BY tile_id) - n) * 8 / (SELECT sum(n) FROM p)) AS INTEGER) AS shard FROM p",
    "rolling_mean": "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS mean5 FROM events",
    "event_windows": "SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE ts IS NOT NULL GROUP BY 1, 2",
}
ORACLE["eval_missing_accuracy"] = f"""WITH {_RECORDS} SELECT task, count(*) AS n, round(avg(CAST(regexp_matches(lower(coalesce(llm_output, '')), '{"|".join(answers.ABSENT)}') AS INTEGER)), 6) AS missing_accuracy
FROM r WHERE answer_type = 'missing' AND task IS NOT NULL GROUP BY 1"""
