import itertools
import math
import random

import numpy as np

from quadrille.operators import near


def brute(rows, r):
    return {(a, b) for (a, ax, ay), (b, bx, by) in itertools.permutations(rows, 2) if a < b and (ax - bx) ** 2 + (ay - by) ** 2 <= r * r}


def test_pairs_match_brute_force_in_sparse_and_crowded_places(spark, monkeypatch):
    monkeypatch.setattr(near, "SALTED", 8)
    rng = random.Random(4)
    rows = [(f"s{i}", rng.uniform(-200, 200), rng.uniform(-200, 200)) for i in range(250)]
    rows += [(f"c{i}", rng.uniform(10, 14), rng.uniform(10, 14)) for i in range(90)]
    rows += [(f"d{i}", 50.0, -50.0) for i in range(45)]
    rows += [("edge1", 100.0, 0.0), ("edge2", 104.4, 0.0)]
    df = spark.createDataFrame(rows + rows[:20], "key string, x double, y double")
    got = [tuple(r) for r in near.pairs_within(df, 4.4).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(rows, 4.4)


def test_pairs_defined_cases(spark):
    nan = float("nan")
    df = spark.createDataFrame([(None, 0.0, 0.0, 1), ("a", None, 0.0, 1), ("b", nan, 0.0, 1), ("c", 0.0, 0.0, 1), ("d", 0.0, 0.0, 2)], "key string, x double, y double, hx int")
    assert [tuple(r) for r in near.pairs_within(df, 1.0).collect()] == [("c", "d")]
    assert near.pairs_within(df.limit(0), 1.0).count() == 0


def test_points_in_polygons_match_ray_casting(spark):
    rng = random.Random(9)
    star = [(math.cos(t) * (30 if i % 2 else 80) + 7, math.sin(t) * (30 if i % 2 else 80)) for i, t in enumerate(np.linspace(0, 2 * math.pi, 11)[:-1])]
    square = [(0.0, 0.0), (64.0, 0.0), (64.0, 64.0), (0.0, 64.0)]
    shapes = {"star": star, "square": square}
    regions = spark.createDataFrame([(k, [p[0] for p in v], [p[1] for p in v]) for k, v in shapes.items()] + [("line", [0.0, 1.0], [0.0, 1.0]), ("none", None, None)], "region_id string, xs array<double>, ys array<double>")
    rows = [(f"p{i}", rng.uniform(-90, 100), rng.uniform(-90, 100)) for i in range(800)] + [("corner", 0.0, 0.0), ("top", 64.0, 64.0)]
    got = {tuple(r) for r in near.regions_of_points(spark.createDataFrame(rows, "key string, x double, y double"), regions).collect()}
    want = set()
    for k, v in shapes.items():
        xs, ys = np.array([p[0] for p in v]), np.array([p[1] for p in v])
        inside = near.in_polygon(np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), xs, ys)
        want |= {(k, r[0]) for r, i in zip(rows, inside) if i}
    assert got == want
    assert ("square", "corner") in got and ("square", "top") not in got
