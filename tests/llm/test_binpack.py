import collections
import math
import random

import numpy as np

from quadrille.llm import binpack


def greedy(sizes, capacity):
    """The rule itself, tried on every choice."""
    bins, out = [], []

    def cost(gaps):
        return sum(n * n for g, n in collections.Counter(gaps).items() if g)

    for s in sizes:
        gaps = [capacity - b for b in bins]
        options = [(cost(gaps[:i] + [g - s] + gaps[i + 1 :]), 0, g, i) for i, g in enumerate(gaps) if g >= s]
        options.append((cost([*gaps, capacity - s]), 1, capacity, len(bins)))
        c, new, g, i = min(options, key=lambda o: (o[0], o[1], o[2]))
        if new:
            bins.append(s)
        else:
            bins[i] += s
        out.append(c)
    return out


def test_every_step_makes_the_sum_of_squares_smallest():
    rng = random.Random(3)
    for capacity in (7, 20):
        sizes = [rng.randint(1, capacity) for _ in range(60)]
        at = binpack.sum_of_squares(np.array(sizes), capacity)
        want, bins = greedy(sizes, capacity), {}
        for k, (s, b) in enumerate(zip(sizes, at)):
            bins[b] = bins.get(b, 0) + s
            assert bins[b] <= capacity
            assert sum(n * n for g, n in collections.Counter(capacity - v for v in bins.values()).items() if g) == want[k]


def test_pack_is_whole_and_tight(spark):
    rng = random.Random(5)
    rows = [(i, min(4000, int(rng.expovariate(1 / 300)) + 1), 9) for i in range(3000)] + [(9001, 5000, 1), (9002, 2048, 1), (9003, 0, 1), (9004, None, 1), (None, 7, 1)]
    df = spark.createDataFrame(rows + rows[:50], "doc_id long, n_tokens long, part int")
    out = binpack.pack(df, 2048, group=500).collect()
    want = {(i, n) for i, n, _ in rows if i is not None and n}
    total = collections.Counter()
    for r in out:
        total[r.doc_id] += r.n_tokens
    assert {(i, n) for i, n in total.items()} == want
    parts = collections.Counter(r.doc_id for r in out)
    assert all(parts[i] == math.ceil(n / 2048) for i, n in want)
    fill = collections.Counter()
    for r in out:
        fill[r.container_id] += r.n_tokens
    assert max(fill.values()) <= 2048
    assert sum(fill.values()) / 2048 / len(fill) > 0.98


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, n_tokens long")
    assert binpack.pack(df, 10).count() == 0
