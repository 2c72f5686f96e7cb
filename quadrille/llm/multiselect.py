"""Percentiles of very many numbers, per group, by distributed multi-select.

For every group and every rank that is sought there is an open range of values.
In each round the tasks propose the median of what they hold in the range, the
weighted median of the proposals, taken on the executors, becomes the pivot, the
tasks count less, equal and greater, and the part of the range that cannot hold
the rank is ruled out: the result is exact. A range with at most FEW rows left is
closed: its values are read off in order. Once half of what is stored has been
ruled out, the sorted runs are written anew without it, so later rounds read
less. Only counts and proposals travel, at most one row per task, group and rank.

Groups of at most FEW rows need no round; they are closed from the start, by a
join and a window, whatever their number. The driver holds the open ranges of
at most TOGETHER larger groups at a time.

Separate partitions or days are summarised (`summaries`) by at most POINTS
weighted values; summaries of any parts join into one of the whole, and
percentiles of summaries are selected by the same rounds. A rank in a joined
summary is off by at most 2 / POINTS of all rows.

Defined cases: null, NaN and infinite values and null groups do not count; ties
are counted, not compared; groups without a value are absent; a percentile
between two ranks is interpolated between their values; an empty table gives an
empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrille.session import cut, forget
from quadrille.sources.tables import finite

#: Values that a task sorts at once; points of a summary; large groups whose ranks are sought in the same rounds (the driver holds their ranges).
RUN, POINTS, TOGETHER = 500_000, 2048, 20_000
#: Rows of a range that is read off instead of being halved further; summaries that one task joins.
FEW, FAN = 4096, 64
PERCENTS = (10, 25, 50, 75, 90, 99)
SEP = "\x1f"


def _runs(rows: DataFrame, by: list[str], value: str, weight: str | None) -> DataFrame:
    """(g, vs, ws): sorted runs of each group, with weights of equal values added up. The group's columns are joined into one string."""
    good = rows.where(finite(F.col(value)))
    for c in by:
        good = good.where(F.col(c).isNotNull())
    w = F.col(weight).cast("bigint") if weight else F.lit(1).cast("bigint")
    good = good.select(F.concat_ws(SEP, *by).alias("g"), F.col(value).cast("double").alias("v"), w.alias("w"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0

        def sort() -> pd.DataFrame:
            b = pd.concat(held, ignore_index=True)
            one = b.groupby(["g", "v"], sort=True)["w"].sum().reset_index()
            return one.groupby("g", sort=False).agg(vs=("v", list), ws=("w", list)).reset_index()[["g", "vs", "ws"]].astype({"g": object})

        for b in batches:
            held.append(b)
            size += len(b)
            if size >= RUN:
                yield sort()
                held, size = [], 0
        if size:
            yield sort()

    return good.mapInPandas(run, "g string, vs array<double>, ws array<bigint>")


Ranges = dict[str, list[tuple[float, float]]]


def _within(runs: DataFrame, ranges: Ranges, schema: str, emit) -> DataFrame:
    """What emit(g, lo, hi, values, weights) makes of each run's part in each of its group's ranges, whose bounds lie outside."""
    sent = runs.sparkSession.sparkContext.broadcast(ranges)
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for g, vs, ws in zip(b["g"], b["vs"], b["ws"]):
                for lo, hi in sent.value.get(g, ()):
                    v = np.asarray(vs)
                    i, j = int(np.searchsorted(v, lo, "right")), int(np.searchsorted(v, hi, "left"))
                    if i < j:
                        rows.append(emit(g, lo, hi, vs[i:j], ws[i:j]))
            yield pd.DataFrame(rows, columns=names)

    return runs.mapInPandas(run, schema)


def _joined(ranges: Ranges) -> Ranges:
    """The ranges of each group with those that overlap made one, so that no value lies in two."""
    out: Ranges = {}
    for g, all_ in ranges.items():
        merged: list[list[float]] = []
        for lo, hi in sorted(all_):
            if merged and lo < merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], hi)
            else:
                merged.append([lo, hi])
        out[g] = [(a, b) for a, b in merged]
    return out


_TOLD = "g string, r bigint, side int, v double, w bigint, less bigint, same bigint"


def _round(runs: DataFrame, groups: dict[str, list[tuple[int, float, float, float]]]) -> DataFrame:
    """(g, r, side, v, less, same): for side -1, 0, 1 the weighted median of the tasks' medians below the pivot, of the whole range, above; for side 9 the counts."""
    sent = runs.sparkSession.sparkContext.broadcast(groups)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        less, same, medians = {}, {}, {}

        def propose(side: tuple, v: np.ndarray, c: np.ndarray, i: int, j: int) -> None:
            total = c[j] - c[i]
            if total > 0:
                at = int(np.searchsorted(c, c[i] + (total + 1) // 2, "left")) - 1
                medians.setdefault(side, []).append((float(v[at]), int(total)))

        for b in batches:
            for g, vs, ws in zip(b["g"], b["vs"], b["ws"]):
                if g not in sent.value:
                    continue
                v, c = np.asarray(vs), np.concatenate([[0], np.cumsum(np.asarray(ws))])
                for r, lo, hi, pivot in sent.value[g]:
                    i, j = int(np.searchsorted(v, lo, "right")), int(np.searchsorted(v, hi, "left"))
                    if i >= j:
                        continue
                    if math.isnan(pivot):
                        propose((g, r, 0), v, c, i, j)
                        continue
                    p, q = max(i, int(np.searchsorted(v, pivot, "left"))), max(i, int(np.searchsorted(v, pivot, "right")))
                    less[g, r] = less.get((g, r), 0) + int(c[p] - c[i])
                    same[g, r] = same.get((g, r), 0) + int(c[q] - c[p])
                    propose((g, r, -1), v, c, i, p)
                    propose((g, r, 1), v, c, q, j)
        rows = [(g, r, 9, 0.0, 0, n, same[g, r]) for (g, r), n in less.items()]
        for (g, r, side), proposals in medians.items():
            # A task speaks once for each range: the weighted median of its runs' medians.
            proposals.sort()
            whole = sum(w for _, w in proposals)
            total = 0
            for value, w in proposals:
                total += w
                if 2 * total >= whole:
                    break
            rows.append((g, r, side, value, whole, 0, 0))
        yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in _TOLD.split(", ")])

    told = runs.mapInPandas(count, _TOLD)
    one = Window.partitionBy("g", "r", "side")
    by_value = one.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    told = told.withColumns({"upto": F.sum("w").over(by_value), "whole": F.sum("w").over(one), "less": F.sum("less").over(one), "same": F.sum("same").over(one), "place": F.row_number().over(one.orderBy("v"))})
    half = F.when(F.col("side") == 9, F.col("place") == 1).otherwise((2 * F.col("upto") >= F.col("whole")) & (2 * (F.col("upto") - F.col("w")) < F.col("whole")))
    return told.where(half).select("g", "r", "side", "v", "less", "same")


def _select(runs: DataFrame, sizes: dict[str, int], ranks: dict[str, set[int]]) -> DataFrame:
    """(g, r, value): the value at each rank, from 0, of groups of more than FEW rows. runs: a table of sorted runs."""
    spark = runs.sparkSession
    found: list[tuple[str, int, float]] = []
    # Per target: bounds that are ruled out themselves, the weight at or below the lower one, the weight between them, the pivot.
    state = {(g, r): (-math.inf, math.inf, 0, sizes[g], math.nan) for g, wanted in ranks.items() for r in wanted}
    closed: list[tuple[str, int, float, float, int]] = []
    stored, mine = sum(sizes.values()), False
    while state:
        groups: dict[str, list[tuple[int, float, float, float]]] = {}
        for (g, r), (lo, hi, _, _, pivot) in state.items():
            groups.setdefault(g, []).append((r, lo, hi, pivot))
        seen: dict[tuple, tuple] = {}
        for row in _round(runs, groups).collect():
            seen[row["g"], row["r"], row["side"]] = (row["less"], row["same"]) if row["side"] == 9 else row["v"]
        after = {}
        for (g, r), (lo, hi, below, left, pivot) in state.items():
            if math.isnan(pivot):
                after[g, r] = (lo, hi, below, left, seen[g, r, 0])
                continue
            less, same = seen[g, r, 9]
            if r < below + less:
                kept, side = (lo, pivot, below, less), -1
            elif r < below + less + same:
                found.append((g, r, float(pivot)))
                continue
            else:
                kept, side = (pivot, hi, below + less + same, left - less - same), 1
            if kept[3] <= FEW:
                closed.append((g, r, float(kept[0]), float(kept[1]), int(kept[2])))
            else:
                after[g, r] = (*kept, seen[g, r, side])
        state = after
        spans: dict[tuple[str, float, float], int] = {(g, lo, hi): left for (g, _), (lo, hi, _, left, _) in state.items()}
        spans |= {(g, lo, hi): FEW for g, _, lo, hi, _ in closed}
        if state and 2 * sum(spans.values()) < stored:
            ranges: Ranges = {}
            for g, lo, hi in spans:
                ranges.setdefault(g, []).append((lo, hi))
            fewer = cut(_within(runs, _joined(ranges), "g string, vs array<double>, ws array<bigint>", lambda g, lo, hi, v, w: (g, v, w)))
            if mine:
                forget(runs)
            runs, mine, stored = fewer, True, sum(spans.values())
    out = spark.createDataFrame(found, "g string, r bigint, value double")
    if closed:
        ends: Ranges = {}
        for g, lo, hi in {c[:1] + c[2:4] for c in closed}:
            ends.setdefault(g, []).append((lo, hi))
        held = _within(runs, ends, "g string, lo double, hi double, vs array<double>, ws array<bigint>", lambda *row: row)
        sought = spark.createDataFrame(closed, "g string, r bigint, lo double, hi double, below bigint")
        out = out.unionByName(_read_off(held, sought, ["g", "lo", "hi"]))
    return out


def _read_off(held: DataFrame, sought: DataFrame, by: list[str]) -> DataFrame:
    """(g, r, value): the ranks sought (with the weight `below` the range), from all values of their ranges in order. held: by, vs, ws."""
    values = held.select(*by, F.inline(F.arrays_zip("vs", "ws"))).groupBy(*by, "vs").agg(F.sum("ws").alias("w"))
    upto = values.withColumn("upto", F.sum("w").over(Window.partitionBy(*by).orderBy("vs")))
    hit = upto.join(sought, by).where((F.col("r") >= F.col("below") + F.col("upto") - F.col("w")) & (F.col("r") < F.col("below") + F.col("upto")))
    return hit.select("g", "r", F.col("vs").alias("value"))


def percentiles(rows: DataFrame, by: list[str], value: str, percents: tuple[float, ...] = PERCENTS, weight: str | None = None) -> DataFrame:
    """The columns of by, percent, value, n: percentiles of every group, interpolated between ranks. rows counts as given: repeated rows are the caller's."""
    kinds = {c: rows.schema[c].dataType.simpleString() for c in by}
    runs = cut(_runs(rows, by, value, weight))
    sizes = cut(runs.groupBy("g").agg(F.sum(F.aggregate("ws", F.lit(0).cast("bigint"), lambda a, b: a + b)).alias("n")))
    at = (F.col("n") - 1) * F.col("percent") / 100
    wanted = sizes.withColumn("percent", F.explode(F.array(*[F.lit(float(p)) for p in percents])))
    wanted = wanted.withColumns({"at": at, "lower": F.floor(at), "upper": F.ceil(at)})
    ranks = wanted.select("g", "n", F.explode(F.array("lower", "upper")).alias("r")).distinct()

    small = ranks.where(F.col("n") <= FEW).select("g", "r", F.lit(0).cast("bigint").alias("below"))
    parts = [_read_off(runs.join(sizes.where(F.col("n") <= FEW).select("g"), "g", "left_semi"), small, ["g"])]
    large = sizes.where(F.col("n") > FEW)
    slices = -(-large.count() // TOGETHER)
    for s in range(slices):
        one = F.pmod(F.xxhash64("g"), F.lit(slices)) == s
        those = {r["g"]: r["n"] for r in large.where(one).collect()}
        # The rounds' own rule for the ranks, over the groups that the driver holds.
        spots = {g: {f((n - 1) * p / 100) for p in percents for f in (math.floor, math.ceil)} for g, n in those.items()}
        if those:
            part = runs.where(one) if slices > 1 else runs
            parts.append(_select(cut(part.join(large.select("g"), "g", "left_semi")), those, spots))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    lower, upper = found.toDF("g", "lower", "a"), found.toDF("g", "upper", "b")
    out = wanted.join(lower, ["g", "lower"]).join(upper, ["g", "upper"]).withColumn("value", F.col("a") + (F.col("b") - F.col("a")) * (F.col("at") - F.col("lower")))
    names = F.split("g", SEP)
    return out.select(*[names[i].cast(kinds[c]).alias(c) for i, c in enumerate(by)], "percent", "value", "n")


def _thin(v: np.ndarray, w: np.ndarray, points: int) -> tuple[list[float], list[int]]:
    """At most points of the sorted values, each standing for the weight around it; the first and the last value stay."""
    if len(v) <= points:
        return list(v), list(w)
    c = np.cumsum(w)
    # Middles of equal shares of the weight.
    at = np.searchsorted(c, (np.arange(points) + 0.5) * c[-1] / points)
    at[0], at[-1] = 0, len(v) - 1
    at = np.unique(at)
    edges = np.floor((np.concatenate([[0], c])[at[1:]] + c[at[:-1]]) / 2).astype(np.int64)
    return list(v[at]), list(np.diff(np.concatenate([[0], edges, [c[-1]]])))


def summaries(rows: DataFrame, by: list[str], value: str, points: int = POINTS, weight: str | None = None) -> DataFrame:
    """The columns of by, v, w: at most points weighted values for each group; their weights add up to the group's rows.

    Runs are thinned where they lie, and the thinned ones are joined in a tree,
    at most about FAN of them by one task, so a group of any size never meets in
    one place. All but the last step keep eight times the points, which leaves
    the bound on a rank's error to the last one.
    """
    kinds = {c: rows.schema[c].dataType.simpleString() for c in by}
    wide = 8 * points

    def thin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [_thin(np.asarray(v), np.asarray(w), wide) for v, w in zip(b["vs"], b["ws"])]
            yield pd.DataFrame({"g": list(b["g"]), "vs": [o[0] for o in out], "ws": [o[1] for o in out]}, dtype=object)

    def joined(pdf: pd.DataFrame, most: int) -> tuple[list[float], list[int]]:
        v, w = np.concatenate(list(pdf["vs"])), np.concatenate(list(pdf["ws"]))
        order = np.argsort(v, kind="stable")
        return _thin(v[order], w[order], most)

    def part(pdf: pd.DataFrame) -> pd.DataFrame:
        v, w = joined(pdf, wide)
        return pd.DataFrame({"g": [pdf["g"].iloc[0]], "vs": [v], "ws": [w]}, dtype=object)

    def last(pdf: pd.DataFrame) -> pd.DataFrame:
        v, w = joined(pdf, points)
        return pd.DataFrame({"g": [pdf["g"].iloc[0]] * len(v), "v": v, "w": w})

    runs = cut(_runs(rows, by, value, weight).mapInPandas(thin, "g string, vs array<double>, ws array<bigint>"))
    while (most := runs.groupBy("g").count().agg(F.max("count")).first()[0] or 0) > FAN:
        dealt = runs.withColumn("part", F.pmod(F.monotonically_increasing_id(), F.lit(-(-most // FAN))))
        runs = cut(dealt.groupBy("g", "part").applyInPandas(part, "g string, vs array<double>, ws array<bigint>"))
    out = runs.groupBy("g").applyInPandas(last, "g string, v double, w bigint")
    names = F.split("g", SEP)
    return out.select(*[names[i].cast(kinds[c]).alias(c) for i, c in enumerate(by)], "v", "w")
