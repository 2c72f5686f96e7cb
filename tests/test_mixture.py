import numpy as np
import pytest

from quadrille.operators import mixture


@pytest.mark.parametrize("k", [1, 5])
def test_size_is_chosen_from_one_to_six(spark, k):
    rng = np.random.default_rng(3)
    centres = np.array([[0, 0], [9, 0], [0, 9], [9, 9], [20, 4]])[:k]
    x = np.concatenate([c + rng.standard_normal((80, 2)) for c in centres])
    df = spark.createDataFrame([(float(a), float(b)) for a, b in x], "x double, y double")
    model = mixture.fit(df, 6, 4)
    assert len(model[0]) == k
    got = [r[0] for r in df.select(mixture.component(df.x, df.y, model)).collect()]
    assert len(set(zip(np.repeat(np.arange(k), 80).tolist(), got))) == k
