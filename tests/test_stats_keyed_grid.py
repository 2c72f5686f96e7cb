import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille.functions import classify, hashing, stats
from quadrille.operators import grid, keyed, sampling, trend, vectorops


def test_percentiles_equal_numpy(spark):
    rng = np.random.default_rng(1)
    data = {"a": np.round(rng.normal(size=333), 1), "b": np.array([2.0]), "c": rng.normal(size=10)}
    rows = [(g, float(v)) for g, vs in data.items() for v in vs] + [("a", None), ("a", math.nan), ("d", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r for r in stats.percentiles(df, ["g"], {"v": F.col("v"), "w": F.abs("v")}, [0.1, 0.5, 0.995]).collect()}
    assert set(got) == {"a", "b", "c"}
    for g, vs in data.items():
        for q, t in ((0.1, "p10"), (0.5, "p50"), (0.995, "p99_5")):
            assert got[g][f"v_{t}"] == pytest.approx(np.quantile(vs, q))
            assert got[g][f"w_{t}"] == pytest.approx(np.quantile(np.abs(vs), q))


def test_gini_and_ranks(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0), ("c", 0.0), ("c", 0.0), ("d", None)], "g string, v double")
    assert {r.g: r.gini for r in stats.gini(df, ["g"], "v").collect()} == {"a": 0.25, "b": 0.0, "c": 0.0}
    rows = spark.createDataFrame([("t1", 1.0, True), ("t2", 2.0, True), ("t3", 2.0, True), ("x", 2.0, False), ("y", 1.5, False), ("z", None, False), ("n", math.nan, False)], "k string, v double, t boolean")
    got = {r.k: r.rank for r in stats.percentile_ranks(rows, "k", "v", F.col("t")).collect()}
    assert got == pytest.approx({"t1": 1 / 3, "t2": 5 / 6, "t3": 5 / 6, "x": 5 / 6, "y": 1 / 3})
    mid = {r.k: r.rank for r in stats.percentile_ranks(rows, "k", "v", F.col("t"), midrank=True).collect()}
    assert mid == pytest.approx({"t1": 1 / 3, "t2": 2.5 / 3, "t3": 2.5 / 3, "x": 2.5 / 3, "y": 1.5 / 3})


def test_ladders_and_their_borders(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (math.nan,), (None,)], "v double")
    names = ("a", "b", "c")
    got = df.select(classify.at_most(F.col("v"), (1, 2), names), classify.below(F.col("v"), (1, 2), names), classify.above(F.col("v"), (1, 2), names)).collect()
    assert [tuple(r) for r in got] == [("a", "b", "a"), ("b", "c", "b"), ("c", "c", "c"), (None, None, "a"), (None, None, "a")]


def test_fnv_matches_the_definition(spark):
    words = ["", "a", "tile|A41", "Grüße €"]
    df = spark.createDataFrame([(w,) for w in words], "s string")

    def fnv(s):
        h = 2166136261
        for b in s.encode():
            h = (h ^ b) * 16777619 & 0xFFFFFFFF
        return h

    assert [r[0] for r in df.select(hashing.fnv1a(F.col("s"))).collect()] == [fnv(w) for w in words]


def test_strict_join(spark):
    base = spark.createDataFrame([("b", "test", 2), ("a", "train", 1)], "tile_id string, split string, x int")
    other = spark.createDataFrame([("a", "train", 10), ("b", "test", 20), ("c", "val", 30)], "tile_id string, split string, y int")
    with pytest.raises(ValueError, match="right_only"):
        keyed.strict_join(base, other)
    got = {r.tile_id: (r.x, r.y) for r in keyed.strict_join(base, other, allow_extra=True).collect()}
    assert got == {"a": (1, 10), "b": (2, 20)}
    for bad in (other.where("tile_id <> 'a'"), other.unionByName(other), other.withColumn("split", F.lit(None).cast("string"))):
        with pytest.raises(ValueError):
            keyed.strict_join(base, bad, allow_extra=True)
    same = other.where("tile_id <> 'c'")
    assert {r.tile_id: (r.x, r.y) for r in keyed.checked_join(base, same).collect()} == {"a": (1, 10), "b": (2, 20)}
    for bad in (other, same.where("tile_id = 'a'"), same.unionByName(same), same.withColumn("split", F.lit(None).cast("string"))):
        with pytest.raises(Exception, match="do not share their keys"):
            keyed.checked_join(base, bad).collect()
    assert {(r.tile_id, r.side) for r in keyed.key_difference(base, other).collect()} == {("c", "right")}


def test_cells_and_neighbours(spark):
    pts = [("t", float(x), float(y)) for x in (-3400, 3400) for y in (-3400, 3400)]
    b = grid.binned(spark.createDataFrame(pts, "tile_id string, x double, y double"))
    assert sorted(r.bin for r in b.collect()) == [0, 7, 56, 63]
    cells = spark.createDataFrame([("t", 0, 5, 1.0), ("t", 1, 6, 4.0), ("t", 8, 5, 2.0), ("t", 7, 5, 4.0)], "tile_id string, bin int, n long, v double")
    top = grid.top_cell(cells, "v").first()
    assert (top.bin, top.v) == (1, 4.0)
    steps = {(r.bin, r.other): (r.place, r.step) for r in grid.neighbour_steps(cells, "v").collect()}
    assert steps == {(0, 1): (0, 3.0), (0, 8): (1, 1.0)}


def test_samples(spark):
    df = spark.range(300).selectExpr("id", "id % 3 AS g", "CASE WHEN id % 10 = 0 THEN 'rare' ELSE 'often' END AS c", "1.0D + id % 5 AS w")
    one = sampling.per_group(df, ["g"], ["id"], 7, 1)
    assert one.groupBy("g").count().collect() and {r["count"] for r in one.groupBy("g").count().collect()} == {7}
    assert sorted(r.id for r in one.collect()) == sorted(r.id for r in sampling.per_group(df.repartition(5), ["g"], ["id"], 7, 1).collect())
    even = sampling.balanced(df, ["g"], "c", ["id"], 12).groupBy("g", "c").count().collect()
    assert {r["count"] for r in even} == {6}
    drawn = sampling.weighted(df, ["g"], ["id"], F.col("w"), 30)
    assert drawn.count() == 90 and drawn.select("id").distinct().count() == 90
    assert drawn.agg(F.avg("w")).first()[0] > df.agg(F.avg("w")).first()[0]


def test_trend_shapes():
    years = 2019 + np.arange(294) * 6 / 365.25
    x = np.linspace(-1, 1, 294)
    curved = trend.shape(5 * x**2 + 0.01 * np.sin(17 * x), years)
    straight = trend.shape(3 * x + 0.2 * np.sin(40 * x), years)
    broken = trend.shape(np.maximum(0, x - 0.2) * 8 + 0.05 * np.sin(37 * x), years)
    assert curved["curvature"] > 0.6 and straight["curvature"] < 0.2
    assert broken["break_strength"] > 1 and abs(broken["break_year"] - years[176]) < 0.15
    assert broken["best_model"] in ("piecewise", "complex")
    y = curved_with_gaps = 5 * x**2
    curved_with_gaps[::7] = np.nan
    assert trend.shape(y, years)["curvature"] > 0.6


def test_robust_fit_resists_outliers():
    x = np.linspace(0, 1, 100)
    y = 2 * x + 1
    y[5] = 50
    beta, _ = trend.robust(y, np.stack([np.ones(100), x], axis=1)[None])
    assert beta[0] == pytest.approx([1, 2], abs=0.15)


def test_vectors_against_anchors_and_library(spark):
    rng = np.random.default_rng(2)
    v = {f"v{i:02d}": rng.normal(size=8) for i in range(40)}
    df = spark.createDataFrame([(k, [float(z) for z in x]) for k, x in v.items()], "tile_id string, vec array<float>")
    anchors = spark.createDataFrame([(i, [float(z) for z in rng.normal(size=8)]) for i in range(3)], "anchor int, vec array<float>")
    a = np.array([r.vec for r in anchors.orderBy("anchor").collect()])
    unit = lambda z: z / np.linalg.norm(z)
    got = {r.tile_id: r for r in vectorops.anchor_distances(df, anchors, "tile_id").collect()}
    for k, x in v.items():
        d = sorted((1 - unit(x) @ unit(b), i) for i, b in enumerate(a))
        assert got[k].anchor == d[0][1] and got[k].distance == pytest.approx(d[0][0], abs=1e-6) and got[k].margin == pytest.approx(d[1][0] - d[0][0], abs=1e-6)
    iso = {r.tile_id: r.isolation for r in vectorops.isolation(df, df, "tile_id", 5).collect()}
    for k, x in v.items():
        assert iso[k] == pytest.approx(np.mean(sorted(1 - unit(x) @ unit(y) for m, y in v.items() if m != k)[:5]), abs=1e-6)


def test_report_of_too_many_models_is_an_error(spark, monkeypatch):
    from quadrille.plans import corpus_tasks

    monkeypatch.setattr(corpus_tasks, "table", lambda *_: spark.range(65).selectExpr("concat('m', id) AS model"))
    with pytest.raises(ValueError, match="64 models"):
        corpus_tasks.eval_report_pivot(spark, "")


def test_assembly_of_many_tables_in_any_order(spark):
    keys = [(f"t{i}", "train" if i % 2 else "val") for i in range(50)]
    tables = {f"g{k}": spark.createDataFrame([(*key, float(i), f"class-{i}") for i, key in (list(enumerate(keys))[::-1] if k else list(enumerate(keys)))], f"tile_id string, split string, n{k} double, c{k} string") for k in range(24)}
    out = keyed.assemble(tables)
    assert len(out.columns) == 50 and out.count() == 50
    assert all(r.n0 == r.n23 == float(r.tile_id[1:]) and r.c5 == f"class-{r.tile_id[1:]}" for r in out.collect())
    for bad in (tables["g1"].limit(49), tables["g1"].union(tables["g1"].limit(1)), tables["g1"].withColumn("split", F.lit("test")), tables["g1"].withColumn("tile_id", F.when(F.col("tile_id") != "t3", F.col("tile_id")))):
        with pytest.raises(Exception, match="do not share the key"):
            keyed.assemble({"g0": tables["g0"], "g1": bad}).collect()
    with pytest.raises(ValueError, match="several tables"):
        keyed.assemble({"a": tables["g1"], "b": tables["g1"]})
