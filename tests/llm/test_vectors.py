import itertools

import numpy as np
from pyspark.sql import functions as F

from quadrille.llm import gridcluster, neighbours
from quadrille.llm.components import components

WIDTH = 256
SCHEMA = "tile_id string, token_idx int, vec array<float>, ingested_at timestamp, key string, pivot int, n int"


def groups(seed=0):
    """Tight groups of very uneven size amid unrelated vectors."""
    rng = np.random.default_rng(seed)
    out = {}
    for g, size in enumerate([60, 12, 7, 3, 3, 2, 2]):
        centre = rng.standard_normal(WIDTH)
        for i in range(size):
            out[f"g{g}_{i:03d}"] = centre + 0.22 * rng.standard_normal(WIDTH)
    for i in range(120):
        out[f"z{i:03d}"] = rng.standard_normal(WIDTH)
    return out


def frame(spark, vecs, extra=()):
    rows = [(k, 0, [float(x) for x in v], None, "x", 1, 2) for k, v in vecs.items()]
    return spark.createDataFrame([*rows, *extra], SCHEMA)


DIRTY = [
    ("bad1", 0, None, None, "x", 1, 2), ("bad2", 0, [1.0] * 255, None, "x", 1, 2), ("bad3", 0, [0.0] * WIDTH, None, "x", 1, 2),
    ("bad4", 0, [float("nan")] + [1.0] * 255, None, "x", 1, 2), (None, 0, [1.0] * WIDTH, None, "x", 1, 2), ("bad5", 0, [None] + [1.0] * 255, None, "x", 1, 2),
]


def unit(vecs):
    keys = sorted(vecs)
    x = np.stack([np.asarray(vecs[k], np.float32).astype(float) for k in keys])
    return keys, x / np.linalg.norm(x, axis=1)[:, None]


def brute_clusters(vecs, least):
    keys, x = unit(vecs)
    alike, label = x @ x.T >= least, {k: k for k in keys}
    changed = True
    while changed:
        changed = False
        for i, j in zip(*np.nonzero(alike)):
            low = min(label[keys[i]], label[keys[j]])
            for k in (keys[i], keys[j]):
                if label[k] != low:
                    label[k], changed = low, True
    sizes = {v: list(label.values()).count(v) for v in label.values()}
    return {k: v for k, v in label.items() if sizes[v] >= 3}


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(200, 260)] + [(5, 5), (None, 1)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 100 for i in range(100, 141)} | {i: 7 for i in [7, *range(200, 260)]} | {5: 5}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_clusters_match_brute_force(spark, monkeypatch):
    vecs = groups()
    for block in (1024, 16):
        monkeypatch.setattr(gridcluster, "BLOCK", block)
        got, _ = gridcluster.cluster(frame(spark, vecs, DIRTY + [DIRTY[0]]).unionByName(frame(spark, dict(list(vecs.items())[:5]))), 0.90)
        assert {r.tile_id: r.cluster_id for r in got.collect()} == brute_clusters(vecs, 0.90)


def test_very_many_equal_vectors_are_one_row(spark, monkeypatch):
    rng = np.random.default_rng(12)
    a, b = rng.standard_normal(WIDTH), rng.standard_normal(WIDTH)
    vecs = {f"y{i}": rng.standard_normal(WIDTH) for i in range(20)} | {"b1": b, "b2": b} | {"a_near": a + 0.1 * rng.standard_normal(WIDTH)}
    copies = spark.range(100_000).select(F.format_string("a%06d", "id").alias("tile_id"), F.lit(0).alias("token_idx"), F.array(*[F.lit(float(np.float32(v))).cast("float") for v in a]).alias("vec"))
    df = frame(spark, vecs).unionByName(copies, allowMissingColumns=True)
    got, _ = gridcluster.cluster(df, 0.90)
    assert {tuple(r) for r in got.groupBy("cluster_id").count().collect()} == {("a000000", 100_001)}


def test_cluster_report(spark):
    vecs = {k: v for k, v in groups().items() if not k.startswith("z")}
    got, _ = gridcluster.cluster(frame(spark, vecs), 0.90)
    anchors = spark.createDataFrame([("g1_000", 4), ("g1_001", 4), ("g1_002", 2), ("g1_003", 2), ("g2_000", None)], "tile_id string, anchor int")
    rows = {r.cluster_id: r for r in gridcluster.describe(got, anchors).collect()}
    assert rows["g0_000"]["size"] == 60 and len(rows["g0_000"].typical_tiles) == 3
    assert rows["g1_000"].commonest_anchor == 2 and rows["g2_000"].commonest_anchor is None


def test_no_usable_vector(spark):
    got, _ = gridcluster.cluster(spark.createDataFrame(DIRTY, SCHEMA), 0.9)
    assert got.count() == 0
    near = neighbours.nearest(spark.createDataFrame(DIRTY, SCHEMA), F.col("tile_id"), F.col("tile_id"), F.col("vec"), F.col("ingested_at"))
    assert near.count() == 0


def brute_neighbours(vecs, group, k, least):
    keys, x = unit(vecs)
    g = np.round(x @ x.T, 9)
    out = set()
    for i, a in enumerate(keys):
        others = sorted((-g[i, j], b) for j, b in enumerate(keys) if group(a) != group(b) and g[i, j] >= least)
        out |= {(a, b) for _, b in others[:k]}
    return out


def found(df):
    return {(r.key, r.other) for r in df.collect()}


def nearest(spark, vecs, group_of, extra=()):
    df = frame(spark, vecs, extra)
    return neighbours.nearest(df, F.col("tile_id"), group_of, F.col("vec"), F.col("ingested_at"), 3, 0.90)


def test_neighbours_reach_nine_tenths_of_brute_force(spark):
    vecs = groups(3)
    got = found(nearest(spark, vecs, F.col("tile_id"), DIRTY))
    want = brute_neighbours(vecs, lambda k: k, 3, 0.90)
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(want)


def test_overgrown_pivots_descend(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "PLACE", 10)
    vecs = groups(4)
    got = found(nearest(spark, vecs, F.col("tile_id")))
    want = brute_neighbours(vecs, lambda k: k, 3, 0.90)
    assert len(got & want) >= 0.9 * len(want)


def test_groups_are_left_out_and_copies_take_the_smallest_keys(spark):
    rng = np.random.default_rng(8)
    v = rng.standard_normal(WIDTH)
    vecs = {f"c{i:03d}": v for i in range(40)} | {f"d{i}": v + 0.1 * rng.standard_normal(WIDTH) for i in range(4)} | {f"y{i}": rng.standard_normal(WIDTH) for i in range(30)}
    groups_of = lambda k: k[:3] if k[0] == "c" else k
    col = F.when(F.col("tile_id").startswith("c"), F.substring("tile_id", 1, 3)).otherwise(F.col("tile_id"))
    assert found(nearest(spark, vecs, col)) == brute_neighbours(vecs, groups_of, 3, 0.90)


def test_copies_of_a_hot_bucket_meet_across_its_salts(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BUCKET", 8)
    monkeypatch.setattr(neighbours, "PLACE", 20)
    rng = np.random.default_rng(9)
    v = rng.standard_normal(WIDTH)
    vecs = {f"c{i:03d}": v for i in range(300)} | {f"y{i}": rng.standard_normal(WIDTH) for i in range(30)}
    assert found(nearest(spark, vecs, F.col("tile_id"))) == brute_neighbours(vecs, lambda k: k, 3, 0.90)


def test_parted_blocks_of_an_overgrown_bucket_meet(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "PLACE", 100)
    rng = np.random.default_rng(10)
    centre = rng.standard_normal(WIDTH)
    vecs = {f"t{i:03d}": centre + 0.02 * rng.standard_normal(WIDTH) for i in range(250)}
    got = found(nearest(spark, vecs, F.col("tile_id")))
    want = brute_neighbours(vecs, lambda k: k, 3, 0.90)
    print("recall", len(got & want) / len(want))
    assert len(got & want) >= 0.98 * len(want)


def test_greedy_search_reaches_nine_tenths_of_brute_force(spark):
    vecs = groups(5)
    keys, x = unit(vecs)
    nodes = spark.createDataFrame([(k, k, [float(z) for z in v]) for k, v in zip(keys, x)], "key string, grp string, vec array<float>").cache()
    lists = neighbours.nearest(nodes, F.col("key"), F.col("grp"), F.col("vec"), F.lit(None), 6, 0.90)
    got = found(neighbours.search(nodes, nodes, lists, 3, 0.90))
    want = brute_neighbours(vecs, lambda k: k, 3, 0.90)
    assert len(got & want) >= 0.95 * len(want) and len(got - want) <= 0.05 * len(want)
    assert neighbours.search(nodes.limit(0), nodes, lists).count() == 0


def test_long_runs_of_a_bucket_keep_their_links():
    rng = np.random.default_rng(2)
    sketch = np.repeat(rng.integers(-(2**62), 2**62, (1, neighbours.WORDS)), 500, axis=0)
    a, b = neighbours.likely(np.zeros(500, np.int64), np.arange(500), sketch, chunk=100)
    root = {i: i for i in range(500)}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in zip(a.tolist(), b.tolist()):
        root[max(find(i), find(j))] = min(find(i), find(j))
    assert {find(i) for i in range(500)} == {0}
    assert all(i != j for i, j in itertools.islice(zip(a, b), 1000))
