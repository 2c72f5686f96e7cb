"""Season of a tile from its histories, and the classes of its trend, with the limits as parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.functions import stats
from quadrille.operators import trend
from quadrille.plans import tile_tasks
from quadrille.plans.tile_tasks import EPOCHS, FIRST_INDEX, STEP_DAYS, T_YEAR
from quadrille.session import cut

#: Epochs of a history or half of one, histories of a tile, histories that must remain of the amplitude trim, least B51, and what counts as zero (fixed values).
EPOCHS_NEEDED, HISTORIES, TRIMMED, LEAST_B51, ZERO = 50, 30, 10, 1.0, 1e-9


def _years(spark: SparkSession, sf: str) -> DataFrame:
    return tile_tasks._steps(spark, sf).withColumn("t", F.lit(2019.0) + (F.col("step") + FIRST_INDEX) * STEP_DAYS / T_YEAR)


def _rests(steps: DataFrame) -> DataFrame:
    """The steps of each history with enough epochs, with r, what a straight line leaves, and the annual cosine c and sine s."""
    by = ["tile_id", "point_idx"]
    line = steps.groupBy(*by).agg(F.count("*").alias("n"), F.regr_slope("y", "t").alias("slope"), F.regr_intercept("y", "t").alias("level")).where(F.col("n") >= EPOCHS_NEEDED)
    w = 2 * F.pi() * F.col("t")
    return steps.join(line, by).select(*by, "split", "n", (F.col("y") - F.col("slope") * F.col("t") - F.col("level")).alias("r"), F.cos(w).alias("c"), F.sin(w).alias("s"))


def phasors(steps: DataFrame) -> DataFrame:
    """tile_id, point_idx, split, a, b, amp: the annual phasor of each history by projection."""
    z = _rests(steps).groupBy("tile_id", "point_idx").agg(F.max("split").alias("split"), F.avg(F.col("r") * F.col("c")).alias("a"), F.avg(F.col("r") * F.col("s")).alias("b"))
    return z.withColumn("amp", F.round(F.sqrt(F.col("a") * F.col("a") + F.col("b") * F.col("b")), 12))


def amplitudes(steps: DataFrame, name: str) -> DataFrame:
    """tile_id, point_idx, name: the annual amplitude of each history by least squares on cosine and sine."""
    r, c, s = F.col("r"), F.col("c"), F.col("s")
    m = _rests(steps).groupBy("tile_id", "point_idx").agg(F.sum(c * c).alias("cc"), F.sum(s * s).alias("ss"), F.sum(c * s).alias("cs"), F.sum(r * c).alias("rc"), F.sum(r * s).alias("rs"))
    det = F.col("cc") * F.col("ss") - F.col("cs") * F.col("cs")
    u, v = (F.col("rc") * F.col("ss") - F.col("rs") * F.col("cs")) / det, (F.col("rs") * F.col("cc") - F.col("rc") * F.col("cs")) / det
    return m.where(det > ZERO).select("tile_id", "point_idx", F.sqrt(u * u + v * v).alias(name))


def _length(a: str, b: str) -> Column:
    return F.sqrt(F.col(a) * F.col(a) + F.col(b) * F.col(b))


def season(steps: DataFrame, b51: DataFrame, fewest: int = HISTORIES) -> DataFrame:
    """Season, coherence and dispersion of the annual phase, and the change of the annual amplitude, of every tile.

    steps: tile_id, split, point_idx, step, t (calendar years), y; b51: tile_id, b51.
    The dispersion leaves out the tenth of the histories of least amplitude,
    unless fewer than TRIMMED would be left; a tile without a B51 of at least
    LEAST_B51 has no clear peak.
    """
    steps = cut(steps)
    z = cut(phasors(steps))
    low = stats.percentiles(z, ["tile_id"], {"amp": F.col("amp")}, [0.1])
    strong = F.col("amp") >= F.round("amp_p10", 12)
    kept = z.join(low, "tile_id")
    kept = kept.join(kept.groupBy("tile_id").agg(F.count_if(strong).alias("strong")), "tile_id").where(strong | (F.col("strong") < TRIMMED))
    turn = F.col("amp") / (F.col("amp") + ZERO)
    d = kept.groupBy("tile_id").agg(F.sum(F.col("a") * turn).alias("da"), F.sum(F.col("b") * turn).alias("db"), F.sum("amp").alias("dm"))
    g = z.groupBy("tile_id").agg(F.max("split").alias("split"), F.count("*").alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("amp").alias("m"))
    half = EPOCHS // 2
    change = amplitudes(steps.where(F.col("step") < half), "early").join(amplitudes(steps.where(F.col("step") >= half), "late"), ["tile_id", "point_idx"])
    change = change.select("tile_id", F.round(F.col("late") - F.col("early"), 9).alias("d"))
    q = stats.percentiles(change, ["tile_id"], {"d": F.col("d")}, [0.1, 0.5, 0.9]).join(change.groupBy("tile_id").agg(F.count("*").alias("pairs")), "tile_id")
    out = tile_tasks.tiles(steps).join(g.drop("split"), "tile_id", "left").join(d, "tile_id", "left").join(q, "tile_id", "left").join(b51.select("tile_id", "b51"), "tile_id", "left")
    some = (F.col("n") >= fewest) & (F.col("m") > ZERO)
    r, rd = _length("a", "b") / (F.col("m") + ZERO), _length("da", "db") / (F.col("dm") + ZERO)
    days = F.sqrt(-2 * F.log(F.least(F.greatest(rd, F.lit(ZERO)), F.lit(1.0)))) / (2 * F.pi()) * T_YEAR
    day = F.pmod(F.atan2("b", "a") / (2 * F.pi()), F.lit(1.0)) * T_YEAR
    peak = F.when((day < 59) | (day >= 334), "winter_peak").when(day < 151, "spring_peak").when(day < 243, "summer_peak").otherwise("autumn_peak")
    changed = lambda c: F.round(F.when(F.col("pairs") >= fewest, F.col(c)), 6)
    return out.select(
        "tile_id", "split", F.when(some & (F.col("b51") >= LEAST_B51), peak).otherwise("no_clear_seasonal_peak").alias("d21_season"),
        F.round(F.when(some, r), 6).alias("d22_coherence"), F.round(F.when(some, days), 4).alias("d23_dispersion_days"),
        changed("d_p50").alias("d24_change"), changed("d_p10").alias("d24_p10"), changed("d_p90").alias("d24_p90"),
    )


def _season(spark: SparkSession, sf: str, fewest: int) -> DataFrame:
    b51 = tile_tasks.b5_seasonality(spark, sf).select("tile_id", F.col("b51_p90").alias("b51"))
    return season(_years(spark, sf), b51, fewest)


def d2_season(spark: SparkSession, sf: str) -> DataFrame:
    return _season(spark, sf, HISTORIES)


def d2_season_min3(spark: SparkSession, sf: str) -> DataFrame:
    """The same for tiles of three histories or more: tile_series holds twelve of a tile at most."""
    return _season(spark, sf, 3)


def d1_trend(spark: SparkSession, sf: str) -> DataFrame:
    """Curvature, break and model of each tile's median history."""
    steps = tile_tasks._steps(spark, sf)
    med = stats.percentiles(steps, ["tile_id", "step"], {"y": F.col("y")}, [0.5]).withColumnRenamed("y_p50", "y")
    med = med.join(tile_tasks.tiles(steps), "tile_id")
    return trend.trends(med, [2019.0 + (i + FIRST_INDEX) * STEP_DAYS / T_YEAR for i in range(EPOCHS)])


def d1_classes_min1(spark: SparkSession, sf: str) -> DataFrame:
    """Shapes, months and bins of the breaks, with the borders of whatever training tiles there are: tile_series holds every fifth tile, too few for the 100 that the rule asks for."""
    return trend.classified(cut(d1_trend(spark, sf)), fewest=1)


QUERIES = {f.__name__: f for f in (d2_season, d2_season_min3, d1_trend, d1_classes_min1)}


def _half_sql(name: str, where: str) -> str:
    return f"""{name}l AS (SELECT tile_id, point_idx, regr_slope(y, t) sl, regr_intercept(y, t) ic FROM sy WHERE {where} GROUP BY 1, 2 HAVING count(*) >= 50),
{name}r AS (SELECT sy.tile_id, sy.point_idx, y - sl * t - ic r, cos(2 * pi() * t) c, sin(2 * pi() * t) s FROM sy JOIN {name}l l ON l.tile_id = sy.tile_id AND l.point_idx = sy.point_idx WHERE {where}),
{name}m AS (SELECT tile_id, point_idx, sum(c * c) cc, sum(s * s) ss, sum(c * s) cs, sum(r * c) rc, sum(r * s) rs, avg(r * c) a, avg(r * s) b FROM {name}r GROUP BY 1, 2),
{name} AS (SELECT *, round(sqrt(a * a + b * b), 12) amp, sqrt(power((rc * ss - rs * cs) / (cc * ss - cs * cs), 2) + power((rs * cc - rc * cs) / (cc * ss - cs * cs), 2)) fitted FROM {name}m WHERE cc * ss - cs * cs > 1e-9)"""


def _season_sql(fewest: int) -> str:
    return f"""WITH {tile_tasks._AXIS}, sy AS (SELECT tile_id, split, point_idx, step, y, 2019.0 + (step + 8) * 6.0 / 365.25 t FROM st), {_half_sql("wh", "TRUE")}, {_half_sql("ea", "step < 147")}, {_half_sql("la", "step >= 147")},
k AS (SELECT wh.*, count(*) FILTER (WHERE amp >= p) OVER (PARTITION BY wh.tile_id) strong, p FROM wh JOIN (SELECT tile_id, round(quantile_cont(amp, 0.1), 12) p FROM wh GROUP BY 1) q USING (tile_id)),
d AS (SELECT tile_id, sqrt(power(sum(a * amp / (amp + 1e-9)), 2) + power(sum(b * amp / (amp + 1e-9)), 2)) / (sum(amp) + 1e-9) rd FROM k WHERE amp >= p OR strong < 10 GROUP BY 1),
g AS (SELECT tile_id, count(*) n, sum(a) a, sum(b) b, sum(amp) m FROM wh GROUP BY 1),
c AS (SELECT ea.tile_id, count(*) pairs, quantile_cont(round(la.fitted - ea.fitted, 9), 0.1) p10, quantile_cont(round(la.fitted - ea.fitted, 9), 0.5) p50, quantile_cont(round(la.fitted - ea.fitted, 9), 0.9) p90 FROM ea JOIN la ON ea.tile_id = la.tile_id AND ea.point_idx = la.point_idx GROUP BY 1),
o AS (SELECT *, coalesce(n >= {fewest} AND m > 1e-9, FALSE) ok, ((atan2(b, a) / (2 * pi()) + 1) % 1) * 365.25 dy FROM (SELECT tile_id, max(split) split FROM sy GROUP BY 1) t LEFT JOIN g USING (tile_id) LEFT JOIN d USING (tile_id) LEFT JOIN c USING (tile_id) LEFT JOIN (SELECT tile_id, b51_p90 FROM ({tile_tasks.ORACLE["b5_seasonality"]})) b5 USING (tile_id))
SELECT tile_id, split, CASE WHEN ok AND b51_p90 >= 1 THEN CASE WHEN dy < 59 OR dy >= 334 THEN 'winter_peak' WHEN dy < 151 THEN 'spring_peak' WHEN dy < 243 THEN 'summer_peak' ELSE 'autumn_peak' END ELSE 'no_clear_seasonal_peak' END AS d21_season,
CASE WHEN ok THEN round(sqrt(a * a + b * b) / (m + 1e-9), 6) END AS d22_coherence, CASE WHEN ok THEN round(sqrt(-2 * ln(least(greatest(rd, 1e-9), 1.0))) / (2 * pi()) * 365.25, 4) END AS d23_dispersion_days,
CASE WHEN pairs >= {fewest} THEN round(p50, 6) END AS d24_change, CASE WHEN pairs >= {fewest} THEN round(p10, 6) END AS d24_p10, CASE WHEN pairs >= {fewest} THEN round(p90, 6) END AS d24_p90 FROM o"""


ORACLE: dict[str, str] = {"d2_season": _season_sql(HISTORIES), "d2_season_min3": _season_sql(3)}
