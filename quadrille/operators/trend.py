"""Shape of a tile's history: straight, curved or with a break, by robust fits.

All fits of a tile share the history's seasonal terms and are iterated together:
the candidate breaks form one stack of designs that numpy solves at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.functions import stats
from quadrille.session import parallelism

#: Rounds of reweighting, Huber's constant, the MAD's scale, candidates for a break, epochs kept free at either end (fixed values).
ROUNDS, HUBER, MAD, KNOTS, MARGIN, TINY = 4, 1.345, 1.4826, 52, 36, 1e-10
#: Bins that the years of breaks are put in (a fixed value).
BINS = 8


def robust(y: np.ndarray, designs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(coefficients, sums of squares) of Huber fits of y on each of a stack of designs (k x n x p)."""
    k, n, p = designs.shape
    w, turned = np.ones((k, n)), designs.transpose(0, 2, 1)
    for _ in range(ROUNDS):
        weighted = turned * w[:, None, :]
        # The columns are of order one and far from collinear, so the normal equations are safe.
        beta = np.linalg.solve(weighted @ designs + 1e-12 * np.eye(p), (weighted @ y)[:, :, None])[:, :, 0]
        rest = y - (designs @ beta[:, :, None])[:, :, 0]
        middle = np.median(rest, axis=1, keepdims=True)
        scale = MAD * np.median(np.abs(rest - middle), axis=1, keepdims=True) + TINY
        w = np.minimum(1.0, HUBER * scale / (np.abs(rest) + TINY))
    return beta, (rest * rest).sum(axis=1)


def shape(y: np.ndarray, years: np.ndarray) -> dict[str, float | str | None]:
    """Curvature and break strength of one history (NaN where an epoch is missing), the break's year, and the model of least BIC."""
    known = np.isfinite(y)
    n = int(known.sum())
    middle, half = (years[0] + years[-1]) / 2, (years[-1] - years[0]) / 2
    x, angle = (years - middle) / half, 2 * np.pi * years
    line = np.stack([np.ones_like(x), x, np.sin(angle), np.cos(angle), np.sin(2 * angle), np.cos(2 * angle)], axis=1)
    at = np.unique(np.linspace(MARGIN, len(years) - MARGIN - 1, KNOTS).round().astype(int))
    hinges = np.maximum(0.0, x[None] - x[at][:, None])
    curve = np.concatenate([line, (x * x)[:, None]], axis=1)

    def stacked(base: np.ndarray) -> np.ndarray:
        return np.concatenate([np.broadcast_to(base, (len(at), *base.shape)), hinges[:, :, None]], axis=2)[:, known]

    v = y[known]
    _, straight = robust(v, line[None, known])
    beta_q, square = robust(v, curve[None, known])
    beta_h, broken = robust(v, stacked(line))
    _, both = robust(v, stacked(curve))
    s0, s2, b, c = float(straight[0]), float(square[0]), int(broken.argmin()), int(both.argmin())
    noise = float(np.sqrt(s0 / max(n - line.shape[1], 1)))

    def strength(sse: float, effect: float) -> float:
        if not s0 > TINY:
            return 0.0
        return float(np.clip(1 - sse / s0, 0, 1) * np.log1p(effect / noise if noise > TINY else 0.0))

    def bic(sse: float, p: int) -> float:
        return float(n * np.log(sse / n) + p * np.log(n)) if n > p and sse > TINY else np.inf

    models = {"linear": bic(s0, 6), "quadratic": bic(s2, 7), "piecewise": bic(float(broken[b]), 8), "complex": bic(float(both[c]), 9)}
    best = min(models, key=models.get)
    return {
        "curvature": strength(s2, abs(float(beta_q[0, -1])) * float(np.std((x * x)[known]))),
        "break_strength": strength(float(broken[b]), abs(float(beta_h[b, -1])) * float(np.std(hinges[b][known]))),
        "break_year": float(years[at[b]]),
        "best_model": best if np.isfinite(models[best]) else None,
        "selected_year": float(years[at[c if best == "complex" else b]]),
        **{f"bic_gain_{m}": models["linear"] - models[m] if np.isfinite(models[m]) and np.isfinite(models["linear"]) else None for m in ("quadratic", "piecewise", "complex")},
    }


def trends(medians: DataFrame, years: list[float], fewest: int = 200) -> DataFrame:
    """tile_id, split, epochs and shape() of each tile; histories of fewer known epochs have only their count.

    medians: tile_id, split, step, y; at most one row for each step of the axis.
    """
    axis = np.asarray(years)
    names = ["curvature", "break_strength", "break_year", "best_model", "selected_year", "bic_gain_quadratic", "bic_gain_piecewise", "bic_gain_complex"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for tile, split, s in zip(b["tile_id"], b["split"], b["s"]):
                y = np.full(len(axis), np.nan)
                for r in s:
                    y[r["step"]] = r["y"]
                n = int(np.isfinite(y).sum())
                got = shape(y, axis) if n >= fewest else dict.fromkeys(names)
                rows.append((tile, split, n, *(got[c] for c in names)))
            yield pd.DataFrame(rows, columns=["tile_id", "split", "epochs", *names])

    g = medians.groupBy("tile_id").agg(F.max("split").alias("split"), F.collect_list(F.struct("step", "y")).alias("s"))
    # A tile costs far more than its bytes tell, so the tasks are not left to their size.
    return g.repartition(parallelism(g.sparkSession), "tile_id").mapInPandas(run, "tile_id string, split string, epochs int, curvature double, break_strength double, break_year double, best_model string, selected_year double, bic_gain_quadratic double, bic_gain_piecewise double, bic_gain_complex double")


def month_of(year: Column) -> tuple[Column, Column]:
    """(yyyy-MM, months since year 0) of a calendar year with a fraction."""
    day = F.date_add(F.make_date(F.floor(year).cast("int"), F.lit(1), F.lit(1)), F.floor((year - F.floor(year)) * 365.25).cast("int"))
    return F.date_format(day, "yyyy-MM"), (F.year(day) * 12 + F.month(day) - 1)


def year_bins(t: DataFrame, fit: DataFrame, year: str, bins: int = BINS) -> Column:
    """The bin of each year between the quantiles of the fit's; between equal steps where quantiles repeat, null where the fit has fewer than five years a bin."""
    qs = [i / bins for i in range(bins + 1)]
    known = fit.where(F.col(year).isNotNull())
    n = known.count()
    if n < 5 * bins:
        return F.lit(None).cast("string")
    edges = [round(e, 9) for e in stats.whole_percentiles(known, year, qs).first()]
    if len(set(edges)) < len(edges):
        edges = np.linspace(edges[0], edges[-1], bins + 1).tolist()
    at = sum((F.when(F.col(year) >= e, 1).otherwise(0) for e in edges[1:-1]), F.lit(0))
    return F.when(F.col(year).isNotNull(), F.format_string("cp_bin_%02d", at))


def classified(t: DataFrame, q: float = 0.85, fewest: int = 100, reference: DataFrame | None = None) -> DataFrame:
    """t with shape_class, and year, month and bin of the breaks: strengths at or above the training tiles' q-quantile make a curve, a break, or both; null where a strength is missing.

    The training tiles are those of the frozen reference where there is one.
    """
    fit = (t if reference is None else reference).where("split = 'train' and curvature is not null and break_strength is not null")
    if fit.limit(fewest).count() < fewest:
        raise ValueError(f"fewer than {fewest} training tiles have both strengths")
    border_c, border_b = stats.train_quantiles(fit, {"curvature": [q], "break_strength": [q]}).first()
    c, b = F.col("curvature") >= border_c, F.col("break_strength") >= border_b
    kind = F.when(b & c, "complex_trend").when(b, "stage_change").when(c, "curved_trend").otherwise("linear_trend")
    out = t.withColumn("shape_class", F.when(c.isNotNull() & b.isNotNull(), kind)).withColumn("change_year", F.when(b, F.col("break_year")))
    month, index = month_of(F.col("change_year"))
    return out.withColumns({"change_month": month, "change_month_index": index, "change_bin": year_bins(out, fit.where(b).withColumn("change_year", F.col("break_year")), "change_year")})
