import math
import random

import numpy as np
import pytest

from quadrille.llm import multiselect, overlap, pairs


def test_overlaps_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(overlap, "SALTED", 2)
    rng = random.Random(6)
    sets, splits = {}, []
    for i in range(8):
        x0, y0 = rng.uniform(0, 1e6), rng.uniform(0, 1e6)
        base = [(x0 + rng.uniform(0, 3000), y0 + rng.uniform(0, 3000)) for _ in range(rng.choice([1, 5, 40]))]
        sets[f"t{i}"] = base
        splits.append((f"t{i}", "train"))
        for j, share in enumerate((1.0, 0.8, 0.75, 0.3)):
            moved = [(x + rng.uniform(-3, 3), y + rng.uniform(-3, 3)) if k < share * len(base) else (x + 500, y - 500) for k, (x, y) in enumerate(base)]
            sets[f"e{i}{j}"] = moved
            splits.append((f"e{i}{j}", "val" if j % 2 else "test"))
    splits += [("t0", "val"), (None, "val"), ("e00", None), ("nopoints", "test"), ("nopoints", "train")]
    rows = [(k, n, x, y, 1) for k, v in sets.items() for n, (x, y) in enumerate(v)]
    points = spark.createDataFrame(rows, "tile_id string, point_idx int, x double, y double, grid int").drop("grid")
    df = spark.createDataFrame(splits + splits[:3], "tile_id string, split string")
    got = {(r.eval_tile, r.train_tile, r.eval_split) for r in overlap.overlaps(points, df, 4.4, 0.8).collect()}
    want = {("t0", "t0", "val"), ("nopoints", "nopoints", "test")}
    train = {k for k, s in splits if s == "train"}
    for e, s in splits:
        if e in sets and s in ("val", "test"):
            for t in train & sets.keys() - {e}:
                near = sum(any((x - u) ** 2 + (y - v) ** 2 <= 4.4**2 for u, v in sets[t]) for x, y in sets[e])
                if near * 10 >= len(sets[e]) * 8:
                    want.add((e, t, s))
    assert got == want


def test_very_many_evaluation_sets_at_one_place(spark):
    rng = random.Random(8)
    base = [(rng.uniform(0, 40), rng.uniform(0, 40)) for _ in range(6)]
    rows = [("train", n, *p) for n, p in enumerate(base)]
    for i in range(3000):
        # Six points in one or two cells, of which one in three sets holds too few near the training set's.
        moved = [(x + (900 if i % 3 == 0 and n < 2 else 0.5), y) for n, (x, y) in enumerate(base)]
        rows += [(f"e{i:04d}", n, *p) for n, p in enumerate(moved)]
    points = spark.createDataFrame(rows, "tile_id string, point_idx int, x double, y double")
    splits = spark.createDataFrame([("train", "train")] + [(f"e{i:04d}", "val") for i in range(3000)], "tile_id string, split string")
    got = {r.eval_tile for r in overlap.overlaps(points, splits, 4.4, 0.8).collect()}
    assert got == {f"e{i:04d}" for i in range(3000) if i % 3}


def test_percentiles_are_exact(spark, monkeypatch):
    monkeypatch.setattr(multiselect, "RUN", 100)
    monkeypatch.setattr(multiselect, "TOGETHER", 2)
    monkeypatch.setattr(multiselect, "FEW", 16)
    rng = np.random.default_rng(3)
    data = {"a": rng.normal(size=1001), "b": np.round(rng.exponential(2, 700), 1), "c": np.array([5.0]), "d": np.repeat([1.0, 2.0], [10, 3])}
    rows = [(g, float(v), 1) for g, vs in data.items() for v in vs] + [("a", float("nan"), 1), ("a", None, 1), (None, 1.0, 1), ("e", None, 1), ("b", math.inf, 1)]
    df = spark.createDataFrame(rows, "g string, v double, vs int").repartition(5)
    got = {(r.g, r.percent): r.value for r in multiselect.percentiles(df, ["g"], "v").collect()}
    assert got == pytest.approx({(g, float(p)): np.percentile(v, p) for g, v in data.items() for p in multiselect.PERCENTS})
    assert multiselect.percentiles(df.limit(0), ["g"], "v").count() == 0


def test_joined_summaries_keep_their_bound(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(d, float(v)) for d in range(4) for v in rng.lognormal(d / 3, 1, 5000)]
    df = spark.createDataFrame(rows, "day int, v double").repartition(3)
    monkeypatch.setattr(multiselect, "FAN", 3)
    days = multiselect.summaries(df, ["day"], "v", points=256)
    sizes = {r.day: r["sum(w)"] for r in days.groupBy("day").sum("w").collect()}
    assert sizes == {d: 5000 for d in range(4)} and days.groupBy("day").count().agg({"count": "max"}).first()[0] <= 256
    whole = np.sort([v for _, v in rows])
    for r in multiselect.percentiles(days.selectExpr("'all' AS g", "v", "w"), ["g"], "v", weight="w").collect():
        rank = np.searchsorted(whole, r.value) / len(whole)
        assert abs(rank - r.percent / 100) <= 2 / 256 + 1e-9


FULL = [
    "For this tile, the {t} comes to {v}, based on {n} points.",
    "It is {v} here, which is in line with the neighbouring tiles.",
    "Going by the {n} points that remain after cleaning, the best figure for the {t} is {v}, with little disagreement between the cells.",
]
TOPICS = {"A1": "median noise", "B1": "mean velocity", "C1": "front strength", "D1": "phase dispersion"}
QUESTIONS = ["What is the {t} of this tile?", "Please report the {t} for the tile shown.", "How large is the {t} here?"]


def records():
    rng, rows = random.Random(2), []
    for i in range(600):
        task = rng.choice(sorted(TOPICS))
        q, a = (rng.choice(x).format(t=TOPICS[task], v=f"{rng.uniform(0, 9):.2f} mm", n=rng.randint(9, 900)) for x in (QUESTIONS, FULL))
        rows.append([i, task, q, a, a if rng.random() < 0.9 else a[:-1], "numeric", None])
    for k, task in enumerate(sorted(TOPICS) * 3):
        rows[k][4] = f"Unfortunately, I must decline to answer this question about the {TOPICS[task]}."
        rows[k][1], rows[k][2] = task, QUESTIONS[0].format(t=TOPICS[task])
    return rows


def judged(spark, rows):
    df = spark.createDataFrame([(*r, None) for r in rows], "record_id long, task string, question string, correct_answer string, llm_output string, answer_type string, rendered_target_value string, evaluated_at timestamp")
    catalog = spark.createDataFrame(list(TOPICS.items()), "task_id string, task_name string")
    out = pairs.defects(df, catalog).collect()
    got = {(r.record_id, r.field): r.defect for r in out}
    assert len(got) == len(out)
    return got


def test_each_kind_of_defect(spark):
    rows = records()
    q = "What is the mean velocity of this tile?"
    cases = {
        1000: ("N/A", "empty"), 1001: ("​ ", "empty"), 1002: (None, "empty"), 1003: ("<eos>", "empty"), 1004: ('""', "empty"),
        1005: ("For this tile, the mean velocity comes to 3.14 mm, based on 12", "truncated"), 1006: ("It is 3.14 mm here, which is in line with the neigh", "truncated"),
        1007: ("For this tile, the mean velocity comes to 3.14 mm, based on 12 points", None), 1008: ("3.14 mm", None),
        1009: ("Question: what is the mean velocity of this tlie", "copies_question"), 1010: (q + " " + q, "copies_question"),
        1011: ("Für diese Kachel ist der Wert 3,14 mm und die Streuung ist gering.", "other_language"),
        1012: ("I must decline to answer this question about the mean velocity", "refusal"),
        1013: ("It is 9.99 mm here, which is in line with the neighbouring tiles.", None),
    }
    for k, (text, _) in cases.items():
        rows.append([k, "B1", q, "It is 3.14 mm here, which is in line with the neighbouring tiles.", text, "numeric", None])
    rows.append([2000, "B1", q, "I must decline to answer this question about the mean velocity.", "Unfortunately, I must decline to answer this.", "refusal", None])
    rows.append([2001, "B1", None, "It is 3.14 mm here, which is in line with the neighbouring tiles.", "It is 1.00 mm here, which is in line with the neighbouring tiles.", None, None])
    rows.append([None, "B1", q, "", "", "numeric", None])
    got = judged(spark, rows + rows[:9])
    want = {(k, "llm_output"): d for k, (_, d) in cases.items() if d} | {(k, "llm_output"): "refusal" for k in range(12)}
    assert got == want


def test_no_records(spark):
    assert judged(spark, []) == {}


def test_openings_that_are_alike_share_a_template(spark):
    a = "i am sorry but i cannot answer that question today"
    df = spark.createDataFrame([(a,), (a + " now",), ("something else entirely is said here",), ("no",)], "opening string")
    got = {r.opening: r.template for r in pairs.templates(df).collect()}
    assert got[a] == got[a + " now"] == a and got["no"] == "no"


def test_openings_of_alike_sentences_share_a_template(spark):
    tail = "that the question about this tile can be answered here with the few points that are left after the cleaning of the series of the last years"
    texts = [f"i {w} have to tell you {tail}" for w in ("sadly", "really", "gladly")] + [f"the {w} of the cells is not known to us at all" for w in ("state", "age", "kind")]
    got = {}
    for block in (1024, 1):
        df = spark.createDataFrame([o for t in texts for o in pairs.openings(t.split())], "opening string, sentence string")
        got = {r.opening: r.template for r in pairs.templates(df, block).collect()}
        assert len(got) == 6 and len({v for k, v in got.items() if k.startswith("i ")}) == 1
        assert all(got[k] == k for k in got if k.startswith("the "))


def test_long_copies_and_other_scripts():
    question = " ".join(f"word{i} of{i % 7}" for i in range(1000))
    altered = " ".join(w if k % 6 else w + "x" for k, w in enumerate(question.split()))
    assert pairs.copies(question, altered) and not pairs.copies(question, " ".join(question.split()[:500]))
    for n in (10, 55, 70, 390, 410):
        words = [f"term{i}" for i in range(n)]
        assert pairs.copies(" ".join(words), " ".join(w if k % 6 != 5 else "other" for k, w in enumerate(words)))
    tongues, asked = pairs.Tongues(), ("what", "is", "the", "mean", "velocity", "of", "this", "tile")
    for answer in ("السرعة المتوسطة لهذا البلاط صغيرة", "此图块的平均速度很小", "середня швидкість цієї плитки невелика", "die mittlere geschwindigkeit ist hier nicht bekannt"):
        assert tongues.differ(asked, tuple(answer.split()))
    assert not tongues.differ(asked, ("the", "mean", "velocity", "is", "small"))
    assert not tongues.differ((), ("die", "mittlere", "ist"))


def test_in_order_is_the_longest_common_subsequence():
    rng = random.Random(3)
    for _ in range(200):
        a, b = (rng.choices("abcd", k=rng.randint(0, 12)) for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert pairs.in_order(a, b) == table[-1][-1]
