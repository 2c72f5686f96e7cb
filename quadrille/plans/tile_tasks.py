"""Targets of a tile from its points, cells, histories and vectors, each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadrille.functions import classify, stats
from quadrille.operators import grid, sampling, vectorops
from quadrille.session import cut
from quadrille.sources.tables import finite, nan_to_null, table

STATICS = ("height", "rmse", "mean_velocity", "mean_velocity_std", "acceleration", "acceleration_std", "seasonality", "seasonality_std")
#: Class borders and names of the targets (fixed values).
MEAN_BANDS = ((-1.47, -1.215, -0.971, -0.657), ("high", "high_mid", "mid", "low_mid", "low"))
SIGNIFICANCE = ((1.5, 1.9, 2.24, 2.9), ("very_low", "low", "moderate", "high", "very_high"))
TYPICAL_VELOCITY = ((1.367, 2.075, 3.149, 4.781), ("low", "typ_low", "typ_high", "high", "extreme"))
TYPICAL_ACCELERATION = ((0.491, 0.697, 0.989, 1.404), ("low", "typ_low", "typ_high", "high", "extreme"))
NOISE = ((1.0, 1.5, 2.0), ("low_noise", "moderate_noise", "high_noise", "very_high_noise"))
EXTENT = ("limited", "partial", "broad", "widespread")
CONCENTRATION = ("diffuse", "mildly_concentrated", "concentrated", "highly_concentrated")
FRONT = ("weak", "moderate", "strong", "very_sharp")
ISOLATION = ("common", "unusual", "rare", "extreme")
COHERENCE = ("spatially_coherent", "weak_local_structure", "clear_local_structure", "strong_local_structure")
FAST = 4.8


def points(spark: SparkSession, sf: str, *columns: str, p: DataFrame | None = None) -> DataFrame:
    """The latest delivery of each point with the named values, NaN as null. Only those columns are read and moved; p: what was made of the table before."""
    if p is not None:
        return p.select("tile_id", "point_idx", "split", *columns)
    raw = table(spark, sf, "tile_points").where("tile_id is not null and point_idx is not null")
    last = raw.groupBy("tile_id", "point_idx").agg(F.max(F.struct("ingested_at", *columns, "split")).alias("r"))
    return last.select("tile_id", "point_idx", F.col("r.split").alias("split"), *[nan_to_null(F.col(f"r.{c}")).alias(c) for c in columns])


def placed(spark: SparkSession, sf: str, *columns: str, p: DataFrame | None = None) -> DataFrame:
    return points(spark, sf, "x", "y", *columns, p=p).where(finite(F.col("x")) & finite(F.col("y")))


def tiles(df: DataFrame) -> DataFrame:
    return df.groupBy("tile_id").agg(F.max("split").alias("split"))


def six(*names: str) -> list[Column]:
    return [F.round(n, 6).alias(n) for n in names]


def b1_snr(spark: SparkSession, sf: str) -> DataFrame:
    p = points(spark, sf, "mean_velocity", "rmse")
    mean = p.groupBy("tile_id").agg(F.max("split").alias("split"), F.avg("mean_velocity").alias("v"))
    out = mean.join(stats.percentiles(p, ["tile_id"], {"rmse": F.col("rmse")}, [0.5]), "tile_id", "left")
    snr = -F.col("v") / (F.col("rmse_p50") + 1e-12)
    out = out.select("tile_id", "split", snr.alias("b11_snr"), F.when(snr >= 1, "clear_subsidence").otherwise("no_clear_subsidence").alias("b12_class"))
    return out.select("tile_id", "split", *six("b11_snr"), "b12_class")


def _tails(spark: SparkSession, sf: str, p: DataFrame | None = None) -> DataFrame:
    p = points(spark, sf, "mean_velocity", p=p)
    v = {"v": F.col("mean_velocity"), "a": F.abs("mean_velocity")}
    return tiles(p).join(stats.percentiles(p, ["tile_id"], v, [0.1, 0.9]), "tile_id", "left")


def b2_mean_band(spark: SparkSession, sf: str) -> DataFrame:
    mean = points(spark, sf, "mean_velocity").groupBy("tile_id").agg(F.avg("mean_velocity").alias("b21_mean_velocity"))
    out = _tails(spark, sf).join(mean, "tile_id")
    band = F.when(F.col("v_p90") > F.abs("v_p10"), "uplift").otherwise(classify.at_most(F.round("b21_mean_velocity", 9), *MEAN_BANDS))
    return out.select("tile_id", "split", *six("b21_mean_velocity"), band.alias("b22_band"))


def b3_tails(spark: SparkSession, sf: str, p: DataFrame | None = None) -> DataFrame:
    t = _tails(spark, sf, p)
    a = F.col("a_p90").cast("float")
    steps = [F.lit(q).cast("float") for q in SIGNIFICANCE[0]]
    out = t.select(
        "tile_id",
        "split",
        F.col("v_p10").alias("b31_p10"),
        F.col("v_p90").alias("b32_p90"),
        F.col("a_p90").alias("b33_abs_p90"),
        F.when(F.col("v_p90") > F.abs("v_p10"), "uplift").otherwise("non_uplift").alias("b34_direction"),
        F.when(a.isNotNull(), F.when(a < steps[0], SIGNIFICANCE[1][0]).when(a < steps[1], SIGNIFICANCE[1][1]).when(a < steps[2], SIGNIFICANCE[1][2]).when(a < steps[3], SIGNIFICANCE[1][3]).otherwise(SIGNIFICANCE[1][4])).alias("b35_significance"),
        classify.at_most(F.round("a_p90", 9), *TYPICAL_VELOCITY).alias("b36_typicality"),
    )
    return out.select("tile_id", "split", *six("b31_p10", "b32_p90", "b33_abs_p90"), "b34_direction", "b35_significance", "b36_typicality")


def b4_acceleration(spark: SparkSession, sf: str, p: DataFrame | None = None) -> DataFrame:
    p = points(spark, sf, "acceleration", p=p)
    out = tiles(p).join(stats.percentiles(p, ["tile_id"], {"a": F.abs("acceleration")}, [0.9]), "tile_id", "left")
    return out.select("tile_id", "split", F.round("a_p90", 6).alias("b41_abs_p90"), classify.at_most(F.round("a_p90", 9), *TYPICAL_ACCELERATION).alias("b42_typicality"))


def b5_seasonality(spark: SparkSession, sf: str, p: DataFrame | None = None) -> DataFrame:
    p = points(spark, sf, "seasonality", p=p)
    out = tiles(p).join(stats.percentiles(p, ["tile_id"], {"s": F.col("seasonality")}, [0.9]), "tile_id", "left")
    return out.select("tile_id", "split", F.round("s_p90", 6).alias("b51_p90"))


def a3_coverage(spark: SparkSession, sf: str) -> DataFrame:
    b = grid.binned(placed(spark, sf))
    out = b.groupBy("tile_id", "bin").agg(F.max("split").alias("split")).groupBy("tile_id").agg(F.max("split").alias("split"), (F.count("*") / 64).alias("a31_fraction"))
    kind = F.when(F.col("a31_fraction") >= 0.75, "well_spread").when(F.col("a31_fraction") >= 0.5, "moderate_gaps").when(F.col("a31_fraction") >= 0.25, "sparse").otherwise("highly_fragmented")
    return out.select("tile_id", "split", *six("a31_fraction"), kind.alias("a32_class"))


def a4_noise(spark: SparkSession, sf: str, p: DataFrame | None = None) -> DataFrame:
    p = points(spark, sf, "rmse", p=p)
    out = tiles(p).join(stats.percentiles(p, ["tile_id"], {"r": F.col("rmse")}, [0.5]), "tile_id", "left")
    return out.select("tile_id", "split", F.round("r_p50", 6).alias("a41_median"), F.coalesce(classify.below(F.round("r_p50", 9), *NOISE), F.lit("unknown")).alias("a42_class"))


def _calibrated(out: DataFrame, value: str, qs: tuple[float, ...], ladder) -> DataFrame:
    """With a class column `kind` from the training rows' quantiles of value: one row of borders, broadcast."""
    borders = stats.train_quantiles(out, {value: qs})
    return out.join(F.broadcast(borders)).withColumn("kind", ladder([F.col(f"{value}_{stats.tag(q)}") for q in qs]))


def c1_moving_extent(spark: SparkSession, sf: str, p: DataFrame | None = None) -> DataFrame:
    snr = F.abs("mean_velocity") / (F.col("rmse") + 1e-12)
    out = points(spark, sf, "mean_velocity", "rmse", p=p).groupBy("tile_id").agg(F.max("split").alias("split"), F.avg(F.when(snr >= 1, 1.0).otherwise(0.0)).alias("c11"))
    out = _calibrated(out.withColumn("c11", F.round("c11", 9)), "c11", (0.1, 0.5, 0.9), lambda q: classify.at_most(F.col("c11"), q, EXTENT))
    return out.select("tile_id", "split", F.round("c11", 6).alias("c11_fraction"), F.col("kind").alias("c12_class"))


def c1_dominant_cell(spark: SparkSession, sf: str) -> DataFrame:
    b = grid.binned(placed(spark, sf, "mean_velocity"), F.col("mean_velocity").isNotNull())
    cells = b.groupBy("tile_id", "bin").agg(F.count("*").alias("n"), F.round(F.avg(F.abs("mean_velocity")), 9).alias("v")).where(F.col("n") >= grid.SUPPORT)
    best = tiles(placed(spark, sf, "mean_velocity")).join(grid.top_cell(cells, "v"), "tile_id", "left")
    return best.select("tile_id", "split", F.coalesce(grid.cell_name(F.col("bin")), F.lit("none")).alias("c13_cell"))


def _cells(spark: SparkSession, sf: str, value: Column, p: DataFrame | None = None) -> DataFrame:
    """Cells with enough points, centred on all points; a missing value leaves out its cell."""
    b = grid.binned(placed(spark, sf, "mean_velocity", p=p))
    cells = b.groupBy("tile_id", "bin").agg(F.count("*").alias("n"), F.count(value).alias("known"), F.avg(value).alias("v"))
    return cells.where((F.col("n") >= grid.SUPPORT) & (F.col("known") == F.col("n")))


def c2_concentration(spark: SparkSession, sf: str, p: DataFrame | None = None) -> DataFrame:
    g = stats.gini(_cells(spark, sf, F.abs("mean_velocity"), p), ["tile_id"], "v")
    out = tiles(placed(spark, sf, "mean_velocity", p=p)).join(g, "tile_id", "left").select("tile_id", "split", F.round(F.coalesce("gini", F.lit(0.0)), 9).alias("c21"))
    out = _calibrated(out, "c21", (0.1, 0.5, 0.9), lambda q: classify.at_most(F.col("c21"), q, CONCENTRATION))
    return out.select("tile_id", "split", F.round("c21", 6).alias("c21_gini"), F.col("kind").alias("c22_class"))


def c3_front(spark: SparkSession, sf: str) -> DataFrame:
    steps = grid.neighbour_steps(_cells(spark, sf, F.col("mean_velocity")), "v").withColumn("step", F.round("step", 9))
    tail = stats.percentiles(steps, ["tile_id"], {"s": F.col("step")}, [0.9])
    sharp = steps.groupBy("tile_id").agg(F.max(F.struct("step", (-F.col("place")).alias("o"), "bin", "other")).alias("m"))
    where = F.concat(grid.cell_name(F.col("m.bin")), F.lit("-"), grid.cell_name(F.col("m.other")))
    out = tiles(placed(spark, sf, "mean_velocity")).join(tail, "tile_id", "left").join(sharp, "tile_id", "left")
    out = out.select("tile_id", "split", F.round(F.coalesce("s_p90", F.lit(0.0)), 9).alias("c31"), F.coalesce(where, F.lit("none")).alias("c32_location"))
    out = _calibrated(out, "c31", (0.1, 0.5, 0.9), lambda q: classify.at_most(F.col("c31"), q, FRONT))
    return out.select("tile_id", "split", F.round("c31", 6).alias("c31_strength"), "c32_location", F.col("kind").alias("c33_class"))


def _fast_cells(spark: SparkSession, sf: str) -> DataFrame:
    b = grid.binned(placed(spark, sf, "mean_velocity"), F.col("mean_velocity").isNotNull())
    enough = b.groupBy("tile_id", "bin").agg(F.count("*").alias("n")).where(F.col("n") >= grid.SUPPORT)
    p90 = stats.percentiles(b, ["tile_id", "bin"], {"a": F.abs("mean_velocity")}, [0.9])
    return enough.join(p90, ["tile_id", "bin"]).select("tile_id", "bin", "n", F.col("a_p90").cast("float").alias("p90"))


def c4_fast_tail(spark: SparkSession, sf: str) -> DataFrame:
    cells = _fast_cells(spark, sf)
    per = cells.groupBy("tile_id").agg(F.count("*").alias("valid"), F.count_if(F.col("p90") >= F.lit(FAST).cast("float")).alias("fast"))
    out = tiles(placed(spark, sf, "mean_velocity")).join(per, "tile_id", "left").select("tile_id", "split", F.coalesce("valid", F.lit(0)).alias("valid"), F.coalesce("fast", F.lit(0)).alias("fast"))
    share = F.when(F.col("valid") > 0, F.col("fast") / F.col("valid")).otherwise(0.0)
    kind = F.when(F.col("fast") == 0, "none").when(F.col("fast") <= 2, "sparse").when(share < 0.25, "localized").otherwise("extensive")
    return out.select("tile_id", "split", F.round(share, 6).alias("c41_fraction"), kind.alias("c42_class"))


def c4_reference(spark: SparkSession, sf: str) -> DataFrame:
    """Quantiles of the cells' fast tails over the whole pool, and those of a log-normal bulk."""
    cells = cut(_fast_cells(spark, sf).select(F.col("p90").cast("double").alias("v")))
    pooled = stats.whole_percentiles(cells, "v", [0.5, 0.75, 0.9, 0.95, 0.99])
    logs = cells.where("v > 0").select(F.log("v").alias("l"))
    ends = stats.whole_percentiles(logs, "l", [0.01, 0.99])
    bulk = logs.join(F.broadcast(ends)).where("l between l_p1 - 1e-12 and l_p99 + 1e-12").agg(F.avg("l").alias("mu"), F.stddev_pop("l").alias("sigma"))
    out = pooled.join(F.broadcast(bulk))
    return out.select(*[F.round(f"v_{stats.tag(q)}", 5).alias(f"pool_{stats.tag(q)}") for q in (0.5, 0.75, 0.9, 0.95, 0.99)], *[F.round(F.exp(F.col("mu") + z * F.col("sigma")), 5).alias(f"bulk_z{i}") for i, z in enumerate((0.0, 1.0, 1.645, 1.96))])


def _intensity(spark: SparkSession, sf: str) -> DataFrame:
    """binned points with `strong` (motion that counts) and `i`, acceleration along the motion."""
    b = grid.binned(placed(spark, sf, "mean_velocity", "rmse", "acceleration"))
    v, a = F.col("mean_velocity"), F.col("acceleration")
    strong = v.isNotNull() & a.isNotNull() & F.col("rmse").isNotNull() & (v != 0) & (F.abs(v) / (F.col("rmse") + 1e-9) >= 1)
    return b.withColumn("strong", F.coalesce(strong, F.lit(False))).withColumn("i", F.when(F.col("strong"), F.signum(v) * a))


def d3_intensification(spark: SparkSession, sf: str, fewest: int = 100) -> DataFrame:
    b = _intensity(spark, sf)
    gate = b.groupBy("tile_id").agg(F.max("split").alias("split"), F.count("*").alias("n"), F.count_if("strong").alias("k"))
    gate = gate.withColumn("ok", (F.col("k") >= fewest) & (F.col("k") * 10 >= F.col("n")))
    q = stats.percentiles(b.where("strong"), ["tile_id"], {"i": F.col("i")}, [0.1, 0.5, 0.9])
    sign = b.where("strong").join(q.select("tile_id", "i_p50"), "tile_id").groupBy("tile_id").agg(F.avg(F.when(F.signum("i") == F.signum("i_p50"), 1.0).otherwise(0.0)).alias("same"))
    cells = b.where("strong").groupBy("tile_id", "bin").agg(F.count("*").alias("n"), F.round(F.avg(F.abs("i")), 9).alias("hot")).where(F.col("n") >= grid.SUPPORT)
    out = gate.join(q, "tile_id", "left").join(sign, "tile_id", "left").join(grid.top_cell(cells, "hot"), "tile_id", "left")
    ok = lambda c: F.when(F.col("ok"), c)
    return out.select(
        "tile_id",
        "split",
        F.round(ok(F.col("i_p50")), 6).alias("d31_median"),
        F.round(F.when(F.col("ok") & (F.col("i_p50") != 0), F.col("same")), 6).alias("d32_agreement"),
        F.round(ok(F.col("i_p90") - F.col("i_p10")), 6).alias("d33_spread"),
        F.round(ok(F.col("hot")), 6).alias("d34_hotspot"),
        F.coalesce(ok(grid.cell_name(F.col("bin"))), F.lit("none")).alias("d35_cell"),
    )


def d3_intensification_min30(spark: SparkSession, sf: str) -> DataFrame:
    """The same for tiles of 30 points that move or more."""
    return d3_intensification(spark, sf, 30)


def d4_dominance(spark: SparkSession, sf: str) -> DataFrame:
    """Which process stands highest among the training tiles: trend, season or acceleration."""
    p = points(spark, sf, "mean_velocity", "seasonality", "acceleration")
    q = stats.percentiles(p, ["tile_id"], {"trend": F.abs("mean_velocity"), "seasonal": F.col("seasonality"), "acceleration": F.abs("acceleration")}, [0.9])
    out, ranks = tiles(p).join(q, "tile_id", "left"), []
    for name in ("trend", "seasonal", "acceleration"):
        r = stats.percentile_ranks(out.withColumn("v", F.round(f"{name}_p90", 9)), "tile_id", "v", F.coalesce(F.col("split") == "train", F.lit(False)))
        ranks.append(r.withColumnRenamed("rank", name))
    for r in ranks:
        out = out.join(r, "tile_id", "left")
    order = F.array_sort(F.array(*[F.struct((-F.coalesce(F.round(n, 9), F.lit(-1.0))).alias("r"), F.lit(k).alias("k"), F.lit(n).alias("n")) for k, n in enumerate(("trend", "seasonal", "acceleration"))]))
    top = out.withColumn("o", order)
    first, second = -F.col("o")[0]["r"], -F.col("o")[1]["r"]
    kind = F.when(first < 0.3, "low_activity").when(first - second >= 0.15, F.concat(F.col("o")[0]["n"], F.lit("_dominant"))).otherwise("mixed")
    return top.select("tile_id", "split", *six("trend", "seasonal", "acceleration"), kind.alias("d41_process"))


DRIFT = ("stable", "mildly_sensitive", "highly_sensitive", "extreme")
DRIFT_FIELDS = ("mean_velocity", "acceleration", "seasonality", "rmse")


def a1_drift(spark: SparkSession, sf: str) -> DataFrame:
    """Angle between a tile's mean vector and that of a fifth of its points (at least 8, by hash), as a part of half a turn."""
    p = points(spark, sf, *DRIFT_FIELDS)
    w = Window.partitionBy("tile_id").orderBy(sampling.order("tile_id", F.col("point_idx").cast("string"), seed=11), "point_idx")
    n = p.groupBy("tile_id").agg(F.count("*").alias("n"))
    chosen = p.join(n, "tile_id").withColumn("place", F.row_number().over(w)).withColumn("drawn", F.col("place") <= F.greatest(F.lit(8), F.round(F.col("n") * 0.2)))
    means = [F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in DRIFT_FIELDS] + [F.coalesce(F.avg(F.when(F.col("drawn"), F.col(c))), F.lit(0.0)).alias(f"s_{c}") for c in DRIFT_FIELDS]
    m = chosen.groupBy("tile_id").agg(F.max("split").alias("split"), *means)
    total = lambda pairs: sum((F.col(a) * F.col(b) for a, b in pairs), F.lit(0.0))
    size = F.sqrt(total((c, c) for c in DRIFT_FIELDS)) * F.sqrt(total((f"s_{c}", f"s_{c}") for c in DRIFT_FIELDS))
    cos = F.when(size > 0, total((c, f"s_{c}") for c in DRIFT_FIELDS) / size)
    out = m.select("tile_id", "split", F.round(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos))) / F.pi(), 9).alias("a11"))
    out = _calibrated(out, "a11", (0.75, 0.95, 0.99), lambda q: classify.at_most(F.col("a11"), q, DRIFT))
    return out.select("tile_id", "split", F.round("a11", 6).alias("a11_drift"), F.col("kind").alias("a12_class"))


def a1_drift_mean(spark: SparkSession, sf: str, seeds: int = 5) -> DataFrame:
    """A11 whole: the mean of that angle over the subsamples of seeds 0 to 4."""
    p = points(spark, sf, *DRIFT_FIELDS)
    n = p.groupBy("tile_id").agg(F.count("*").alias("n"), *[F.coalesce(F.avg(c), F.lit(0.0)).alias(f"f_{c}") for c in DRIFT_FIELDS])
    draws = p.withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))))
    hashed = F.md5(F.concat_ws("|", "tile_id", F.col("point_idx").cast("string"), F.col("seed").cast("string")))
    w = Window.partitionBy("tile_id", "seed").orderBy(hashed, "point_idx")
    drawn = draws.withColumn("place", F.row_number().over(w)).join(n, "tile_id").where(F.col("place") <= F.greatest(F.lit(8), F.round(F.col("n") * 0.2)))
    m = drawn.groupBy("tile_id", "seed").agg(F.max("split").alias("split"), *[F.coalesce(F.avg(c), F.lit(0.0)).alias(f"s_{c}") for c in DRIFT_FIELDS]).join(n, "tile_id")
    total = lambda a, b: sum((F.col(a + c) * F.col(b + c) for c in DRIFT_FIELDS), F.lit(0.0))
    size = F.sqrt(total("f_", "f_")) * F.sqrt(total("s_", "s_"))
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.when(size > 0, total("f_", "s_") / size)))) / F.pi()
    out = m.groupBy("tile_id").agg(F.max("split").alias("split"), F.round(F.avg(angle), 9).alias("a11"))
    out = _calibrated(out, "a11", (0.75, 0.95, 0.99), lambda q: classify.at_most(F.col("a11"), q, DRIFT))
    return out.select("tile_id", "split", F.round("a11", 6).alias("a11_drift"), F.col("kind").alias("a12_class"))


STEP_DAYS, FIRST_INDEX, EPOCHS, T_YEAR = 6.0, 8, 294, 365.25


def time_axis(spark: SparkSession, sf: str) -> DataFrame:
    """step, year, month: the calendar of the stored histories; sf is not read."""
    year = 2019.0 + (F.col("step") + FIRST_INDEX) * STEP_DAYS / 365.25
    days = ((year - F.floor(year)) * 365.25).cast("int")
    month = F.date_format(F.date_add(F.make_date(F.floor(year).cast("int"), F.lit(1), F.lit(1)), days), "yyyy-MM")
    return spark.range(EPOCHS).select(F.col("id").cast("int").alias("step")).select("step", F.round(year, 6).alias("year"), month.alias("month"))


def _steps(spark: SparkSession, sf: str) -> DataFrame:
    """tile_id, split, point_idx, t (years from the middle), step, y: the known steps of each history."""
    s = table(spark, sf, "tile_series").where("tile_id is not null").dropDuplicates(["tile_id", "point_idx"])
    long = s.select("tile_id", "split", "point_idx", F.posexplode("ts").alias("step", "y")).withColumn("y", nan_to_null(F.col("y"))).where("y is not null")
    return long.withColumn("t", (F.col("step") - (EPOCHS - 1) / 2) * STEP_DAYS / 365.25)


def _latest_vectors(spark: SparkSession, sf: str, which: str) -> DataFrame:
    t = table(spark, sf, "egms_tokens").where(which).where("valid and tile_id is not null and vec is not null and size(vec) = 256").where(vectorops.usable(F.col("vec")))
    return t.groupBy("tile_id", "token_idx").agg(F.max(F.struct("ingested_at", "vec", "split")).alias("r")).select("tile_id", "token_idx", F.col("r.split").alias("split"), F.col("r.vec").alias("vec"))


def s1_anchor(spark: SparkSession, sf: str) -> DataFrame:
    v = _latest_vectors(spark, sf, "token_idx = 0")
    anchors = table(spark, sf, "anchor_profiles").select(F.col("reference_anchor_id").alias("anchor"), "vec", "anchor_profile")
    near = vectorops.anchor_distances(v, anchors, "tile_id").join(F.broadcast(anchors.select("anchor", "anchor_profile")), "anchor")
    return near.select("tile_id", F.col("anchor").alias("s11_anchor"), F.col("anchor_profile").alias("s11_profile"), F.round("distance", 6).alias("s12_distance"), F.round("margin", 6).alias("s13_margin"))


def s2_isolation(spark: SparkSession, sf: str, k: int = 20) -> DataFrame:
    v = _latest_vectors(spark, sf, "token_idx = 0").select("tile_id", "split", "vec")
    iso = vectorops.isolation(v.select("tile_id", "vec"), v.where("split = 'train'").select("tile_id", "vec"), "tile_id", k)
    out = v.select("tile_id", "split").join(iso, "tile_id").select("tile_id", "split", F.round("isolation", 9).alias("s21"))
    out = _calibrated(out, "s21", (0.75, 0.95, 0.99), lambda q: classify.above(F.col("s21"), q, ISOLATION))
    return out.select("tile_id", "split", F.round("s21", 6).alias("s21_isolation"), F.col("kind").alias("s22_class"))


def s4_dispersion(spark: SparkSession, sf: str) -> DataFrame:
    v = _latest_vectors(spark, sf, "token_idx >= 1")
    d = vectorops.dispersion(v, "tile_id").join(tiles(v), "tile_id").select("tile_id", "split", F.round("dispersion", 9).alias("s41"), "gini")
    out = _calibrated(d, "s41", (0.5, 0.9, 0.95), lambda q: classify.above(F.col("s41"), q, COHERENCE))
    return out.select("tile_id", "split", F.round("s41", 6).alias("s41_dispersion"), F.round("gini", 6).alias("s43_gini"), F.col("kind").alias("s42_class"))


def pool_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of a tile from its points' values: token 0 the mean over all, 1 to 64 over each cell, with counts; empty cells are not valid."""
    b = grid.binned(placed(spark, sf, "mean_velocity", "rmse")).select("tile_id", (F.col("bin") + 1).alias("token_idx"), "mean_velocity", "rmse")
    both = b.unionByName(b.withColumn("token_idx", F.lit(0)))
    got = both.groupBy("tile_id", "token_idx").agg(F.count("*").alias("point_count"), F.avg("mean_velocity").alias("velocity"), F.avg("rmse").alias("rmse"))
    frame = b.select("tile_id").distinct().withColumn("token_idx", F.explode(F.sequence(F.lit(0), F.lit(64))))
    out = frame.join(got, ["tile_id", "token_idx"], "left")
    return out.select("tile_id", "token_idx", F.col("point_count").isNotNull().alias("valid"), F.coalesce("point_count", F.lit(0)).alias("point_count"), *six("velocity", "rmse"))


QUERIES = {
    f.__name__: f
    for f in (
        a1_drift, a1_drift_mean, b1_snr, b2_mean_band, b3_tails, b4_acceleration, b5_seasonality, a3_coverage, a4_noise, c1_moving_extent, c1_dominant_cell, c2_concentration,
        c3_front, c4_fast_tail, c4_reference, d3_intensification, d3_intensification_min30, d4_dominance, time_axis, s1_anchor, s2_isolation,
        s4_dispersion, pool_cells,
    )
}


def _nums(*names: str) -> str:
    return ", ".join(f"CASE WHEN isnan({n}) THEN NULL ELSE CAST({n} AS DOUBLE) END AS {n}" for n in names)


_ORDER = ", ".join(f"{c} DESC NULLS LAST" for c in ("ingested_at", "x", "y", "split", *STATICS))
P = f"""p AS (SELECT tile_id, point_idx, split, {_nums("x", "y", *STATICS)} FROM tile_points WHERE tile_id IS NOT NULL AND point_idx IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY tile_id, point_idx ORDER BY {_ORDER}) = 1),
g AS (SELECT * FROM p WHERE isfinite(x) AND isfinite(y)), t AS (SELECT tile_id, max(split) split FROM p GROUP BY 1), tg AS (SELECT tile_id, max(split) split FROM g GROUP BY 1)"""


def _binned(name: str, rows: str) -> str:
    place = lambda c: f"CAST(least(greatest(floor(({c} - m{c} + 3500.0) / 7000.0 * 8), 0), 7) AS INTEGER)"
    return f"""{name}c AS (SELECT tile_id, avg(x) mx, avg(y) my FROM g WHERE {rows} GROUP BY 1),
{name} AS (SELECT g.*, {place("y")} * 8 + {place("x")} AS bin FROM g JOIN {name}c USING (tile_id) WHERE {rows})"""


def _case(value: str, op: str, cuts, labels) -> str:
    return f"CASE WHEN {value} IS NULL THEN NULL " + " ".join(f"WHEN {value} {op} {q} THEN '{n}'" for q, n in zip(cuts, labels)) + f" ELSE '{labels[-1]}' END"


def _ladder(value: str, cuts, labels) -> str:
    return "CASE " + " ".join(f"WHEN {value} > {q} THEN '{n}'" for q, n in zip(reversed(list(cuts)), reversed(labels[1:]))) + f" ELSE '{labels[0]}' END"


def _borders(value: str, qs) -> str:
    return "th AS (SELECT " + ", ".join(f"quantile_cont({value}, {q}) FILTER (WHERE split = 'train') q{i}" for i, q in enumerate(qs)) + " FROM o)"


_Q3 = ("q0", "q1", "q2")
_CELL = "'r' || CAST({0} // 8 AS VARCHAR) || 'c' || CAST({0} % 8 AS VARCHAR)"
_AXIS = f"""s AS (SELECT DISTINCT ON (tile_id, point_idx) tile_id, split, point_idx, ts FROM tile_series WHERE tile_id IS NOT NULL),
e AS (SELECT tile_id, split, point_idx, unnest(range(0, len(ts))) step, unnest(ts) y0 FROM s),
st AS (SELECT tile_id, split, point_idx, step, CAST(y0 AS DOUBLE) y, (step - 146.5) * 6.0 / 365.25 t FROM e WHERE y0 IS NOT NULL AND NOT isnan(y0))"""


def _vectors_sql(where: str) -> str:
    return f"""v0 AS (SELECT tile_id, token_idx, split, CAST(vec AS DOUBLE[]) vec, ingested_at FROM egms_tokens WHERE {where} AND valid AND tile_id IS NOT NULL AND len(vec) = 256
  AND len(list_filter(vec, lambda z: z IS NULL OR NOT isfinite(z))) = 0 AND len(list_filter(vec, lambda z: z <> 0)) > 0),
v AS (SELECT * FROM v0 QUALIFY row_number() OVER (PARTITION BY tile_id, token_idx ORDER BY ingested_at DESC NULLS LAST, vec DESC) = 1)"""


_INTENSE = f"""{_binned("b", "TRUE")}, i AS (SELECT *, coalesce(mean_velocity IS NOT NULL AND acceleration IS NOT NULL AND rmse IS NOT NULL AND mean_velocity <> 0
  AND abs(mean_velocity) / (rmse + 1e-9) >= 1, FALSE) strong, sign(mean_velocity) * acceleration i FROM b)"""
_SQL_TAILS = "q AS (SELECT tile_id, max(split) split, avg(mean_velocity) m, quantile_cont(mean_velocity, 0.1) p10, quantile_cont(mean_velocity, 0.9) p90, quantile_cont(abs(mean_velocity), 0.9) a90, median(rmse) r FROM p GROUP BY 1)"

_DOT = lambda a, b: " + ".join(f"{a}{c} * {b}{c}" for c in DRIFT_FIELDS)
ORACLE = {
    "a1_drift": f"""WITH {P}, n AS (SELECT tile_id, count(*) n FROM p GROUP BY 1), c AS (SELECT p.*, row_number() OVER (PARTITION BY tile_id ORDER BY md5(tile_id || '|' || point_idx || '|11'), point_idx) <= greatest(8, round(n * 0.2)) d FROM p JOIN n USING (tile_id)),
m AS (SELECT tile_id, max(split) split, {", ".join(f"coalesce(avg({c}), 0) f_{c}, coalesce(avg({c}) FILTER (WHERE d), 0) s_{c}" for c in DRIFT_FIELDS)} FROM c GROUP BY 1),
k AS (SELECT tile_id, split, sqrt({_DOT("f_", "f_")}) * sqrt({_DOT("s_", "s_")}) z, {_DOT("f_", "s_")} y FROM m), o AS (SELECT tile_id, split, round(acos(greatest(-1, least(1, CASE WHEN z > 0 THEN y / z END))) / pi(), 9) v FROM k), {_borders('v', (0.75, 0.95, 0.99))}
SELECT tile_id, split, round(v, 6) a11_drift, {_case('v', '<=', _Q3, DRIFT)} a12_class FROM o, th""",
    "a1_drift_mean": f"""WITH {P}, n AS (SELECT tile_id, count(*) n FROM p GROUP BY 1), c AS (SELECT p.*, seed, row_number() OVER (PARTITION BY tile_id, seed ORDER BY md5(tile_id || '|' || point_idx || '|' || seed), point_idx) <= greatest(8, round(n * 0.2)) d FROM p JOIN n USING (tile_id), range(5) r(seed)),
m AS (SELECT tile_id, seed, max(split) split, {", ".join(f"coalesce(avg({c}), 0) f_{c}, coalesce(avg({c}) FILTER (WHERE d), 0) s_{c}" for c in DRIFT_FIELDS)} FROM c GROUP BY 1, 2),
k AS (SELECT tile_id, split, sqrt({_DOT("f_", "f_")}) * sqrt({_DOT("s_", "s_")}) z, {_DOT("f_", "s_")} y FROM m), a AS (SELECT tile_id, split, acos(greatest(-1, least(1, CASE WHEN z > 0 THEN y / z END))) / pi() v FROM k),
o AS (SELECT tile_id, max(split) split, round(avg(v), 9) v FROM a GROUP BY 1), {_borders('v', (0.75, 0.95, 0.99))}
SELECT tile_id, split, round(v, 6) a11_drift, {_case('v', '<=', _Q3, DRIFT)} a12_class FROM o, th""",
    "b1_snr": f"WITH {P}, {_SQL_TAILS} SELECT tile_id, split, round(-m / (r + 1e-12), 6) b11_snr, CASE WHEN -m / (r + 1e-12) >= 1 THEN 'clear_subsidence' ELSE 'no_clear_subsidence' END b12_class FROM q",
    "b2_mean_band": f"WITH {P}, {_SQL_TAILS} SELECT tile_id, split, round(m, 6) b21_mean_velocity, CASE WHEN p90 > abs(p10) THEN 'uplift' ELSE {_case('round(m, 9)', '<=', *MEAN_BANDS)} END b22_band FROM q",
    "b3_tails": f"""WITH {P}, {_SQL_TAILS} SELECT tile_id, split, round(p10, 6) b31_p10, round(p90, 6) b32_p90, round(a90, 6) b33_abs_p90, CASE WHEN p90 > abs(p10) THEN 'uplift' ELSE 'non_uplift' END b34_direction,
{_case('CAST(a90 AS FLOAT)', '<', [f'CAST({x} AS FLOAT)' for x in SIGNIFICANCE[0]], SIGNIFICANCE[1])} b35_significance, {_case('round(a90, 9)', '<=', *TYPICAL_VELOCITY)} b36_typicality FROM q""",
    "b4_acceleration": f"WITH {P}, q AS (SELECT tile_id, max(split) split, quantile_cont(abs(acceleration), 0.9) a FROM p GROUP BY 1) SELECT tile_id, split, round(a, 6) b41_abs_p90, {_case('round(a, 9)', '<=', *TYPICAL_ACCELERATION)} b42_typicality FROM q",
    "b5_seasonality": f"WITH {P} SELECT tile_id, max(split) split, round(quantile_cont(seasonality, 0.9), 6) b51_p90 FROM p GROUP BY 1",
    "a3_coverage": f"""WITH {P}, {_binned("b", "TRUE")}, o AS (SELECT tile_id, max(split) split, count(DISTINCT bin) / 64.0 f FROM b GROUP BY 1)
SELECT tile_id, split, round(CAST(f AS DOUBLE), 6) a31_fraction, CASE WHEN f >= 0.75 THEN 'well_spread' WHEN f >= 0.5 THEN 'moderate_gaps' WHEN f >= 0.25 THEN 'sparse' ELSE 'highly_fragmented' END a32_class FROM o""",
    "a4_noise": f"WITH {P}, o AS (SELECT tile_id, max(split) split, median(rmse) r FROM p GROUP BY 1) SELECT tile_id, split, round(r, 6) a41_median, coalesce({_case('round(r, 9)', '<', *NOISE)}, 'unknown') a42_class FROM o",
    "c1_moving_extent": f"""WITH {P}, o AS (SELECT tile_id, max(split) split, round(avg(CASE WHEN abs(mean_velocity) / (rmse + 1e-12) >= 1 THEN 1.0::DOUBLE ELSE 0 END), 9) v FROM p GROUP BY 1), {_borders('v', (0.1, 0.5, 0.9))}
SELECT tile_id, split, round(v, 6) c11_fraction, {_case('v', '<=', _Q3, EXTENT)} c12_class FROM o, th""",
    "c1_dominant_cell": f"""WITH {P}, {_binned("b", "mean_velocity IS NOT NULL")}, k AS (SELECT tile_id, bin, count(*) n, round(avg(abs(mean_velocity)), 9) v FROM b GROUP BY 1, 2 HAVING count(*) >= 5),
f AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY tile_id ORDER BY v DESC, n DESC, bin) = 1)
SELECT tg.tile_id, tg.split, coalesce({_CELL.format('bin')}, 'none') c13_cell FROM tg LEFT JOIN f USING (tile_id)""",
    "c2_concentration": f"""WITH {P}, {_binned("b", "TRUE")}, k AS (SELECT tile_id, bin, avg(abs(mean_velocity)) v FROM b GROUP BY 1, 2 HAVING count(*) >= 5 AND count(mean_velocity) = count(*)),
r AS (SELECT *, row_number() OVER (PARTITION BY tile_id ORDER BY v) i FROM k), s AS (SELECT tile_id, count(*) n, sum(v) s, sum(v * i) si FROM r GROUP BY 1),
o AS (SELECT tg.tile_id, tg.split, round(coalesce(CASE WHEN n >= 2 AND s > 0 THEN 2 * si / (n * s) - (n + 1) / n ELSE 0 END, 0), 9) v FROM tg LEFT JOIN s USING (tile_id)), {_borders('v', (0.1, 0.5, 0.9))}
SELECT tile_id, split, round(v, 6) c21_gini, {_case('v', '<=', _Q3, CONCENTRATION)} c22_class FROM o, th""",
    "c3_front": f"""WITH {P}, {_binned("b", "TRUE")}, k AS (SELECT tile_id, bin, avg(mean_velocity) v FROM b GROUP BY 1, 2 HAVING count(*) >= 5 AND count(mean_velocity) = count(*)),
n AS (SELECT a.tile_id, a.bin, c.bin other, a.bin * 2 + CASE WHEN c.bin = a.bin + 8 THEN 1 ELSE 0 END place, round(abs(a.v - c.v), 9) step FROM k a JOIN k c ON a.tile_id = c.tile_id AND (c.bin = a.bin + 8 OR c.bin = a.bin + 1 AND a.bin % 8 < 7)),
q AS (SELECT tile_id, quantile_cont(step, 0.9) f FROM n GROUP BY 1), f AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY tile_id ORDER BY step DESC, place) = 1),
o AS (SELECT tg.tile_id, tg.split, round(coalesce(f, 0), 9) v, coalesce({_CELL.format('f.bin')} || '-' || {_CELL.format('f.other')}, 'none') loc FROM tg LEFT JOIN q USING (tile_id) LEFT JOIN f USING (tile_id)), {_borders('v', (0.1, 0.5, 0.9))}
SELECT tile_id, split, round(v, 6) c31_strength, loc c32_location, {_case('v', '<=', _Q3, FRONT)} c33_class FROM o, th""",
    "c4_fast_tail": f"""WITH {P}, {_binned("b", "mean_velocity IS NOT NULL")}, k AS (SELECT tile_id, bin, CAST(quantile_cont(abs(mean_velocity), 0.9) AS FLOAT) p90 FROM b GROUP BY 1, 2 HAVING count(*) >= 5),
s AS (SELECT tile_id, count(*) n, count(*) FILTER (WHERE p90 >= CAST(4.8 AS FLOAT)) f FROM k GROUP BY 1), o AS (SELECT tg.tile_id, tg.split, coalesce(n, 0) n, coalesce(f, 0) f FROM tg LEFT JOIN s USING (tile_id))
SELECT tile_id, split, round(CASE WHEN n > 0 THEN f / n ELSE 0.0::DOUBLE END, 6) c41_fraction, CASE WHEN f = 0 THEN 'none' WHEN f <= 2 THEN 'sparse' WHEN f / n < 0.25 THEN 'localized' ELSE 'extensive' END c42_class FROM o""",
    "c4_reference": f"""WITH {P}, {_binned("b", "mean_velocity IS NOT NULL")}, k AS (SELECT CAST(CAST(quantile_cont(abs(mean_velocity), 0.9) AS FLOAT) AS DOUBLE) v FROM b GROUP BY tile_id, bin HAVING count(*) >= 5),
l AS (SELECT ln(v) l FROM k WHERE v > 0), e AS (SELECT quantile_cont(l, 0.01) a, quantile_cont(l, 0.99) z FROM l), m AS (SELECT avg(l) mu, stddev_pop(l) sigma FROM l, e WHERE l BETWEEN a - 1e-12 AND z + 1e-12)
SELECT {", ".join(f"(SELECT round(quantile_cont(v, {q}), 5) FROM k) pool_{stats.tag(q)}" for q in (0.5, 0.75, 0.9, 0.95, 0.99))}, {", ".join(f"round(exp(mu + {z} * sigma), 5) bulk_z{i}" for i, z in enumerate((0.0, 1.0, 1.645, 1.96)))} FROM m""",
    "d3_intensification": f"""WITH {P}, {_INTENSE}, q AS (SELECT tile_id, max(split) split, count(*) n, count(*) FILTER (WHERE strong) k, quantile_cont(i, 0.1) FILTER (WHERE strong) p10, quantile_cont(i, 0.5) FILTER (WHERE strong) p50, quantile_cont(i, 0.9) FILTER (WHERE strong) p90 FROM i GROUP BY 1),
a AS (SELECT i.tile_id, avg(CASE WHEN sign(i) = sign(p50) THEN 1.0::DOUBLE ELSE 0 END) same FROM i JOIN q USING (tile_id) WHERE strong GROUP BY 1),
c AS (SELECT tile_id, bin, count(*) n, round(avg(abs(i)), 9) hot FROM i WHERE strong GROUP BY 1, 2 HAVING count(*) >= 5), h AS (SELECT tile_id, bin, hot FROM c QUALIFY row_number() OVER (PARTITION BY tile_id ORDER BY hot DESC, n DESC, bin) = 1),
o AS (SELECT *, q.k >= 100 AND q.k * 10 >= q.n ok FROM q LEFT JOIN a USING (tile_id) LEFT JOIN h USING (tile_id))
SELECT tile_id, split, CASE WHEN ok THEN round(p50, 6) END d31_median, CASE WHEN ok AND p50 <> 0 THEN round(same, 6) END d32_agreement, CASE WHEN ok THEN round(p90 - p10, 6) END d33_spread, CASE WHEN ok THEN round(hot, 6) END d34_hotspot, coalesce(CASE WHEN ok THEN {_CELL.format('bin')} END, 'none') d35_cell FROM o""",
    "d4_dominance": f"""WITH {P}, o AS (SELECT tile_id, max(split) split, round(quantile_cont(abs(mean_velocity), 0.9), 9) a, round(quantile_cont(seasonality, 0.9), 9) b, round(quantile_cont(abs(acceleration), 0.9), 9) c FROM p GROUP BY 1),
{", ".join(f"r{c} AS (SELECT o.tile_id, count(*) FILTER (WHERE x.{c} < o.{c}) l, count(*) FILTER (WHERE x.{c} <= o.{c}) r, count(x.{c}) n FROM o, (SELECT {c} FROM o WHERE split = 'train' AND {c} IS NOT NULL) x WHERE o.{c} IS NOT NULL GROUP BY 1)" for c in "abc")},
k AS (SELECT o.tile_id, o.split, {", ".join(f"CASE WHEN r{c}.r > r{c}.l THEN (r{c}.l + 1 + r{c}.r) / (2 * r{c}.n) ELSE r{c}.r / r{c}.n END {n}" for c, n in zip("abc", ("trend", "seasonal", "acceleration")))} FROM o LEFT JOIN ra USING (tile_id) LEFT JOIN rb USING (tile_id) LEFT JOIN rc USING (tile_id)),
m AS (SELECT *, list_sort([{", ".join(f"{{'r': -coalesce(round({n}, 9), -1), 'k': {i}, 'n': '{n}'}}" for i, n in enumerate(("trend", "seasonal", "acceleration")))}]) z FROM k)
SELECT tile_id, split, round(trend, 6) trend, round(seasonal, 6) seasonal, round(acceleration, 6) acceleration,
CASE WHEN -z[1].r < 0.3 THEN 'low_activity' WHEN -z[1].r + z[2].r >= 0.15 THEN z[1].n || '_dominant' ELSE 'mixed' END d41_process FROM m""",
    "time_axis": """WITH a AS (SELECT CAST(i AS INTEGER) step, 2019.0::DOUBLE + (i + 8) * 6.0::DOUBLE / 365.25::DOUBLE y FROM range(294) r(i))
SELECT step, round(y, 6) AS year, strftime(make_date(CAST(floor(y) AS BIGINT), 1, 1) + CAST(floor((y - floor(y)) * 365.25) AS INTEGER), '%Y-%m') AS month FROM a""",
    "s1_anchor": f"""WITH {_vectors_sql("token_idx = 0")}, d AS (SELECT v.tile_id, a.reference_anchor_id k, a.anchor_profile f, 1 - list_cosine_similarity(v.vec, CAST(a.vec AS DOUBLE[])) d FROM v, anchor_profiles a),
o AS (SELECT *, row_number() OVER (PARTITION BY tile_id ORDER BY d, k) i, lead(d) OVER (PARTITION BY tile_id ORDER BY d, k) e FROM d)
SELECT tile_id, k s11_anchor, f s11_profile, round(d, 6) s12_distance, round(e - d, 6) s13_margin FROM o WHERE i = 1""",
    "s2_isolation": f"""WITH {_vectors_sql("token_idx = 0")}, d AS (SELECT a.tile_id, a.split, 1 - list_cosine_similarity(a.vec, b.vec) d FROM v a JOIN v b ON b.split = 'train' AND a.tile_id <> b.tile_id),
k AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY tile_id ORDER BY d) <= 20), o AS (SELECT tile_id, max(split) split, round(avg(d), 9) v FROM k GROUP BY 1), {_borders('v', (0.75, 0.95, 0.99))}
SELECT tile_id, split, round(v, 6) s21_isolation, {_ladder('v', _Q3, ISOLATION)} s22_class FROM o, th""",
    "s4_dispersion": f"""WITH {_vectors_sql("token_idx >= 1")}, e AS (SELECT tile_id, token_idx, unnest(range(0, 256)) j, unnest(vec) x FROM v), m AS (SELECT tile_id, j, avg(x) m FROM e GROUP BY 1, 2),
r AS (SELECT tile_id, token_idx, sum((x - m) * (x - m)) d2, sum(x * x) s2 FROM e JOIN m USING (tile_id, j) GROUP BY 1, 2), w AS (SELECT *, row_number() OVER (PARTITION BY tile_id ORDER BY d2) i FROM r),
s AS (SELECT tile_id, sqrt(avg(d2)) / greatest(sqrt(avg(s2)), 1e-12) v, CASE WHEN sum(sqrt(d2)) > 0 THEN 2 * sum(sqrt(d2) * i) / (count(*) * sum(sqrt(d2))) - (count(*) + 1) / count(*) END g FROM w GROUP BY 1 HAVING count(*) >= 2),
o AS (SELECT s.tile_id, x.split, round(v, 9) v, g FROM s JOIN (SELECT tile_id, max(split) split FROM v GROUP BY 1) x USING (tile_id)), {_borders('v', (0.5, 0.9, 0.95))}
SELECT tile_id, split, round(v, 6) s41_dispersion, round(g, 6) s43_gini, {_ladder('v', _Q3, COHERENCE)} s42_class FROM o, th""",
    "pool_cells": f"""WITH {P}, {_binned("b", "TRUE")}, a AS (SELECT tile_id, bin + 1 token_idx, mean_velocity v, rmse r FROM b UNION ALL SELECT tile_id, 0, mean_velocity, rmse FROM b),
k AS (SELECT tile_id, token_idx, count(*) n, avg(v) v, avg(r) r FROM a GROUP BY 1, 2), f AS (SELECT DISTINCT tile_id, CAST(j AS INTEGER) token_idx FROM b, range(65) w(j))
SELECT f.tile_id, f.token_idx, n IS NOT NULL AS valid, coalesce(n, 0) point_count, round(v, 6) velocity, round(r, 6) rmse FROM f LEFT JOIN k USING (tile_id, token_idx)""",
}
ORACLE["d3_intensification_min30"] = ORACLE["d3_intensification"].replace("q.k >= 100", "q.k >= 30")
