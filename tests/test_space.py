import numpy as np

from quadrille.operators import space


def test_space_equals_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(80, 6)) @ rng.normal(size=(6, 6)) + 5
    rows = [(i, "train" if i < 60 else "test", [float(v) for v in r]) for i, r in enumerate(x)] + [(999, "test", None)]
    df = spark.createDataFrame(rows, "id long, split string, vec array<double>")
    model = space.fit(df.where("split = 'train'"), axes=3)
    got = {r.id: r.place for r in space.place(model, df).collect()}
    assert got.pop(999) is None
    train = x[:60]
    s = (x - train.mean(0)) / train.std(0, ddof=1)
    _, axes = np.linalg.eigh(np.cov(s[:60].T))
    want = s @ axes[:, ::-1][:, :3]
    want /= np.linalg.norm(want, axis=1)[:, None]
    mine = np.array([got[i] for i in range(80)])
    # An axis may point either way, which changes no product.
    assert np.allclose(mine @ mine.T, want @ want.T, atol=1e-8)
