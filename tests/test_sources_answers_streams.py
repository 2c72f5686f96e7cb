import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille.functions import answers
from quadrille.sources import npz, sinks
from quadrille.streaming.windows import windowed

STATICS = {s: np.array([1.0, 2.0], np.float32) for s in npz.STATICS}


def tile(path, **change):
    data = {"coords": np.array([[100, 200], [102, 204]], np.float32), "time_series": np.arange(2 * 294, dtype=np.float32).reshape(2, 294), **STATICS}
    np.savez(path, **{k: v for k, v in (data | change).items() if v is not None})


def test_npz_tiles(spark, tmp_path):
    spark.dataSource.register(npz.NpzTiles)
    tile(tmp_path / "E00N00_x0000000_y0000000.npz")
    tile(tmp_path / "E00N00_x0007000_y0000000.npz")
    df = spark.read.format("npz_tiles").load(str(tmp_path))
    assert df.count() == 4
    r = df.where("point_idx = 1").orderBy("tile_id").first()
    assert (r.tile_id, r.x, r.y, r.rmse, len(r.ts), r.ts[0]) == ("E00N00_x0000000_y0000000", 102.0, 204.0, 2.0, 294, 294.0)
    c = df.groupBy("tile_id").agg(F.count("*").alias("n"), F.avg("x").alias("x"), F.avg("y").alias("y")).first()
    assert (c.n, c.x, c.y) == (2, 101.0, 202.0)


@pytest.mark.parametrize("change", [{"time_series": np.zeros((2, 304), np.float32)}, {"rmse": None}, {"coords": np.array([[np.nan, 1], [2, 3]], np.float32)}])
def test_bad_tiles_raise_or_are_skipped(tmp_path, change):
    path = tmp_path / "bad.npz"
    tile(path, **change)
    with pytest.raises(ValueError):
        npz.read_tile(str(path), 294)
    reader = npz.NpzReader({"path": str(tmp_path), "bad": "skip"})
    assert [list(reader.read(p)) for p in reader.partitions()] == [[]]


def test_text_tables_keep_their_decimals(spark, tmp_path):
    df = spark.createDataFrame([("a", 2.675, 0.25), ("b", None, float("nan"))], "k string, v double, w double")
    sinks.write_csv(df, str(tmp_path / "t"), {"v": 2, "w": 1})
    back = {r.k: (r.v, r.w) for r in sinks.read_csv(spark, str(tmp_path / "t"), "k string, v double, w double").collect()}
    assert back == {"a": (2.67, 0.2), "b": (None, None)}
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.write_csv(df, str(tmp_path / "t"))


def test_json_lines_and_inventory(spark, tmp_path):
    df = spark.createDataFrame([("é", None)], "k string, v double")
    sinks.write_jsonl(df.coalesce(1), str(tmp_path / "j"))
    assert next(iter((tmp_path / "j").glob("part-*"))).read_text() == '{"k":"é","v":null}\n'
    (tmp_path / "d").mkdir()
    (tmp_path / "d/x").write_text("one")
    (tmp_path / "d/y").write_text("two")
    found = sinks.inventory(spark, str(tmp_path / "d"))
    known = spark.createDataFrame(found.collect(), found.schema)
    assert {r.path for r in known.collect()} == {"x", "y"}
    (tmp_path / "d/x").write_text("other")
    (tmp_path / "d/z").write_text("new")
    (tmp_path / "d/y").unlink()
    assert {(r.path, r.problem) for r in sinks.differences(known, sinks.inventory(spark, str(tmp_path / "d"))).collect()} == {("x", "changed"), ("y", "missing"), ("z", "new")}


BANDS = ["low", "low_mid", "mid", "high_mid", "high", "very_high", "uplift"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("the band is very high", ("parsed", "very_high")),
        ("not high", ("unparsed", None)),
        ("low in places but very high elsewhere", ("ambiguous", None)),
        ("It is low_mid here.", ("parsed", "low_mid")),
        ("nothing at all", ("unparsed", None)),
    ],
)
def test_labels_in_answers(text, want):
    assert answers.label(text, BANDS) == want


@pytest.mark.parametrize(
    ("text", "spec", "want"),
    [
        ("acceleration signal is 0.622", (None, None, None), ("parsed", 0.622)),
        ("About 43 percent", (None, 0, 1), ("parsed", 0.43)),
        ("either 0.4 or 0.5", (None, 0, 1), ("ambiguous", None)),
        ("29 spatial bins", (None, 0, 1), ("unparsed", None)),
        ("77.7 days", ("mm", None, None), ("unparsed", None)),
        ("it comes to 3.22 mm, based on 700 points", ("mm", 0, None), ("parsed", 3.22)),
        ("-1.4 mm/yr", ("mm/yr", None, None), ("parsed", -1.4)),
        ("at least three observations", (None, None, None), ("unparsed", None)),
    ],
)
def test_numbers_in_answers(text, spec, want):
    assert answers.number(text, *spec) == want


def test_extraction_frame(spark):
    rows = [(1, "B22", "It is high."), (2, "B51", "3.2 mm"), (3, "B51", "I must decline to answer."), (4, "B51", "The value is not available."), (5, "B51", None), (6, None, "3 mm")]
    df = spark.createDataFrame(rows, "record_id long, task string, text string")
    got = {r.record_id: (r.status, r.label, r.value) for r in answers.extract(df, {"B22": BANDS}, {"B51": ("mm", 0, None)}).collect()}
    assert got == {1: ("parsed", "high", None), 2: ("parsed", None, 3.2), 3: ("refusal", None, None), 4: ("missing", None, None), 5: ("unparsed", None, None), 6: ("unparsed", None, None)}


def test_stream_equals_table(spark, tmp_path):
    src = tmp_path / "in"
    df = spark.range(500).selectExpr("timestamp_seconds(1700000000 + id * 97) AS ts", "CASE WHEN id % 2 = 0 THEN 'a' ELSE 'b' END AS event_type", "id * 1.0D AS value")
    df.write.parquet(str(src))
    stream = windowed(spark.readStream.schema(df.schema).parquet(str(src)))
    q = stream.writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(map(tuple, spark.table("w").collect())) == sorted(map(tuple, windowed(df).collect()))
