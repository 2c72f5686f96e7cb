from quadrille.operators import packing

A = "E10N26_x1000000_y2600000"
SCHEMA = "file_id long, path string, tile_id string, content string, container_id int"


def files(spark):
    rows = [
        (1, f"data/{A}.part0.csv", A, "point_idx,x,y\n1,2.0,3.50\n2,4,5\n", 0),
        (2, f"data\\{A}.part0.txt", None, "2; 4.0; 5.0\r\n1; 2; 3.5\r\n", 0),
        (3, f"{A}.json", A, '{"point_idx":1,"x":2.0,"y":3.5}\n{"y":5.0,"x":4e0,"point_idx":2}', 0),
        (4, f"{A}.p4", A, "1,2.0,3.5\n", 0),
        (5, f"{A}.p5", A, "", 0),
        (6, f"{A}.p6", A, None, 0),
        (7, f"{A}.p7", A, "point_idx,x,y\n", 0),
        (8, "other", "B", "1,2.0,3.5\n2,4,5", 0),
        (9, None, None, "ä é\n9,1,1", 0),
        (4, f"{A}.p4", A, "1,2.0,3.5\n", 0),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_every_file_reads_back_byte_by_byte(spark):
    src = files(spark)
    blocks = packing.pack(src, container=40, block=24).cache()
    back = {r.file_id: r for r in packing.read_back(blocks).collect()}
    want = {r.file_id: r.content for r in src.collect()}
    assert {k: r.content for k, r in back.items()} == want
    assert all(r.checksum_ok for r in back.values())
    ids = [(r.container_id, r.block_no) for r in blocks.collect()]
    assert len(ids) == len(set(ids))
    assert packing.pack(src).select("container_id").distinct().count() == 1


def test_same_records_and_consolidation(spark):
    blocks = packing.pack(files(spark)).cache()
    assert {tuple(r) for r in packing.same_records(blocks, group=1).collect()} == {(1, 2), (1, 3), (2, 3)}
    got = sorted((r.tile_id or "", r.point_idx, r.x, r.y) for r in packing.consolidated(blocks).collect())
    assert got == [("", 9, 1.0, 1.0), ("B", 1, 2.0, 3.5), ("B", 2, 4.0, 5.0), (A, 1, 2.0, 3.5), (A, 2, 4.0, 5.0)]


def test_empty_table(spark):
    assert packing.index(packing.pack(files(spark).limit(0))).count() == 0


def test_very_many_empty_files_and_ids_of_another_type(spark, monkeypatch):
    src = spark.range(100_000).selectExpr("concat('f', id) AS file_id", "concat('p', id) AS path", "CAST(NULL AS STRING) AS tile_id", "CASE WHEN id % 2 = 0 THEN '' END AS content")
    blocks = packing.pack(src).cache()
    assert blocks.selectExpr("max(size(entries))").first()[0] <= packing.ENTRIES
    assert packing.index(blocks).selectExpr("count(*)", "count(DISTINCT file_id)", "count_if(length = -1)").first()[:] == (100_000, 100_000, 50_000)


def test_a_lookup_reads_one_block_of_a_kept_archive(spark, tmp_path):
    rows = [(i, f"dir/{i:04d}", "T", f"{i},1,2\nä" * 3) for i in range(200)] + [(900, "dir/null", "T", None)]
    folder = str(tmp_path / "archive")
    blocks = packing.write_archive(spark.createDataFrame(rows, "file_id long, path string, tile_id string, content string"), folder, container=1000, block=100)
    assert blocks.select("container_id").distinct().count() > 3
    for paths in (["dir/0003"], ["dir/0150", "dir/null", "absent"], [f"dir/{i:04d}" for i in range(200)] * 6):
        got = {r.path: r for r in packing.lookup(spark, folder, paths).collect()}
        assert {p: r.content for p, r in got.items()} == {p: c for _, p, _, c in rows if p in paths} and all(r.checksum_ok for r in got.values())
    assert packing.lookup(spark, folder, []).count() == 0
    import pyarrow.parquet as pq

    one = next(p for p in (tmp_path / "archive" / "blocks").glob("*.parquet"))
    file = pq.ParquetFile(one)
    assert file.num_row_groups == file.metadata.num_rows
    try:
        packing.write_archive(spark.createDataFrame(rows, "file_id long, path string, tile_id string, content string"), folder)
        raise AssertionError("written over")
    except Exception as e:
        assert "exist" in str(e).lower()
