import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille.functions import answers, stats, texts
from quadrille.operators import trend
from quadrille.sources import contracts, npz

CONFIG = {"stored_steps": 294, "t_start": 0, "t_end": 294, "input_length": 294, "end_is_exclusive": True, "original_index_offset": 8, "original_epoch_year": 2019.0, "cadence_days": 6.0, "original_t_start": 8, "original_t_end": 302}


def test_time_window():
    w = contracts.TimeWindow.of({"time_window": CONFIG})
    assert len(w.years()) == 294 and w.years()[0] == pytest.approx(2019 + 48 / 365.25)
    for change in ({"stored_steps": 200}, {"original_index_offset": 0}, {"cadence_days": 0}, {"end_is_exclusive": False}, {"input_length": 293}):
        with pytest.raises(ValueError):
            contracts.TimeWindow.of({"time_window": CONFIG | change})
    with pytest.raises(ValueError, match="lacks"):
        contracts.TimeWindow.of({})


def test_manifest_and_keys(spark, tmp_path):
    good = spark.createDataFrame([("a", "train", "p"), ("b", "test", "q")], "tile_id string, split string, path string")
    assert contracts.manifest(good).count() == 2
    for bad in ([("a", "train", "p"), ("a", "val", "p")], [(None, "train", "p")], [("a", "other", "p")], [("a", None, "p")]):
        with pytest.raises(ValueError):
            contracts.manifest(spark.createDataFrame(bad, good.schema))
    with pytest.raises(ValueError, match="path"):
        contracts.manifest(good.drop("path"))
    assert [r.tile_id for r in contracts.not_done(good, good.limit(0), ["tile_id"]).orderBy("tile_id").collect()] == ["a", "b"]
    assert [r.tile_id for r in contracts.not_done(good, good.where("tile_id = 'a'"), ["tile_id"]).collect()] == ["b"]
    with pytest.raises(ValueError):
        contracts.not_done(good, good.union(good), ["tile_id"])
    assert contracts.fingerprint(good) == contracts.fingerprint(good.orderBy(F.desc("tile_id"))) != contracts.fingerprint(good.limit(1))
    contracts.exclusive(good, str(tmp_path / "t"), {"rows": 2})
    assert spark.read.parquet(str(tmp_path / "t/rows")).count() == 2
    with pytest.raises(Exception, match="(?i)exist"):
        contracts.exclusive(good, str(tmp_path / "t"), {})
    contracts.save_state(str(tmp_path / "s.json"), {"a": 1})
    assert (tmp_path / "s.json").read_text() == '{"a": 1}' and not (tmp_path / "s.json.part").exists()


def test_order_of_steps():
    assert contracts.in_order({"d": ["b", "c"], "b": ["a"], "c": ["a"]}) == ["a", "b", "c", "d"]
    with pytest.raises(Exception):
        contracts.in_order({"a": ["b"], "b": ["a"]})


def test_npz_reads_only_the_columns_asked_for(spark, tmp_path):
    spark.dataSource.register(npz.NpzTiles)
    np.savez(tmp_path / "E00N00_x0000000_y0000000.npz", coords=np.array([[1, 2], [3, 4]], np.float32), rmse=np.array([5, 6], np.float32))
    df = spark.read.format("npz_tiles").option("columns", "tile_id, rmse, x").load(str(tmp_path))
    assert df.columns == ["tile_id", "rmse", "x"] and sorted((r.rmse, r.x) for r in df.collect()) == [(5.0, 1.0), (6.0, 3.0)]
    with pytest.raises(Exception, match="speed"):
        spark.read.format("npz_tiles").option("columns", "speed").load(str(tmp_path)).collect()


def test_spoken_numbers():
    say = lambda t, *a: answers.number(t, *a)
    assert say("minus one point four millimetres per year, based on 64 observations", "mm/yr") == ("parsed", -1.4)
    assert say("it is twenty three point zero five mm", "mm") == ("parsed", 23.05)
    assert say("one hundred and five days", "days") == ("parsed", 105.0)
    assert say("at least three observations")[0] == "unparsed" and say("one of the tiles")[0] == "unparsed"
    assert say("forty three percent", None, 0, 1) == ("parsed", 0.43)


def test_texts(spark):
    r = spark.createDataFrame([("very_high|encoder", "r2c3", "a | b||c", "1, 2,x,3")], "l string, g string, p string, n string")
    got = r.select(texts.humanised(F.col("l")), texts.grid_place(F.col("g")), texts.piped(F.col("p")), texts.whole_numbers(F.col("n")), texts.capitalised(F.col("l")), texts.decapitalised(F.lit("ABc")), texts.grid_place(F.col("l"))).first()
    assert tuple(got) == ("very high / representation", "row 2, column 3", ["a", "b", "c"], [1, 2, 3], "Very_high|encoder", "aBc", None)


def test_running_totals_and_whole_percentiles(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"), (F.col("id") % 5).cast("bigint").alias("v")).repartition(7)
    got, total = stats.running(df, ["k"], "v", "upto")
    rows = sorted((r.k, r.v, r.upto) for r in got.collect())
    assert total == sum(v for _, v, _ in rows) and [u for _, _, u in rows] == np.cumsum([v for _, v, _ in rows]).tolist()
    values = np.random.default_rng(2).normal(size=777).round(2)
    one = stats.whole_percentiles(spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "x double"), "x", [0.1, 0.5, 0.99]).first()
    assert list(one) == pytest.approx(np.quantile(values, [0.1, 0.5, 0.99]).tolist())
    assert list(stats.whole_percentiles(spark.createDataFrame([], "x double"), "x", [0.5]).first()) == [None]


def test_trend_classes_from_a_hundred_training_tiles(spark):
    schema = "tile_id string, split string, curvature double, break_strength double, break_year double"
    rows = [(f"t{i:03d}", "train", float(i), float(i), 2020 + i / 100) for i in range(100)] + [("v", "val", 1e9, 1e9, 2021.25), ("w", "test", 1e9, 1e9, 2021.25)]
    got = {r.tile_id: r for r in trend.classified(spark.createDataFrame(rows, schema)).collect()}
    assert got["t000"].shape_class == "linear_trend" and got["t085"].shape_class == "complex_trend" and got["t084"].shape_class == "linear_trend"
    assert (got["w"].shape_class, got["w"].change_year, got["w"].change_month, got["w"].change_month_index) == ("complex_trend", 2021.25, "2021-04", 2021 * 12 + 3)
    # Fifteen breaks are too few for eight bins.
    assert got["w"].change_bin is None
    with pytest.raises(ValueError):
        trend.classified(spark.createDataFrame(rows[1:], schema))
    frozen = trend.classified(spark.createDataFrame(rows[-1:], schema), reference=spark.createDataFrame(rows[:100], schema)).first()
    assert frozen.shape_class == "complex_trend"


def test_bins_of_years(spark):
    t = spark.createDataFrame([(f"t{i}", 2019 + i / 80) for i in range(80)] + [("null", None)], "tile_id string, year double")
    got = {r.tile_id: r.bin for r in t.withColumn("bin", trend.year_bins(t, t, "year")).collect()}
    assert got["t0"] == "cp_bin_00" and got["t79"] == "cp_bin_07" and got["null"] is None and len(set(got.values()) - {None}) == 8
    same = spark.createDataFrame([("a", 2020.0)] * 39 + [("b", 2024.0)], "tile_id string, year double")
    assert {r.bin for r in same.withColumn("bin", trend.year_bins(same, same, "year")).collect()} == {"cp_bin_00", "cp_bin_07"}
