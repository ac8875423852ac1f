"""Latent factors against numpy's SVD of the whole log."""

import numpy as np

from tessera.operators import models as md


def test_latent_uses_every_item(spark):
    rng = np.random.default_rng(5)
    x = rng.random((40, 30)) * (rng.random((40, 30)) < 0.3)
    x[0, :5], x[0, 5:] = 0, 1 + np.arange(25)  # a user without a play of the pool
    plays = spark.createDataFrame([(u, i, float(x[u, i])) for u in range(40) for i in range(30) if x[u, i]], "user_id long, item_id long, x double")
    users = spark.createDataFrame([(u,) for u in range(0, 40, 2)], "user_id long")
    pool = spark.createDataFrame([(i,) for i in [*range(5), 999]], "item_id long")
    got = {(r.user_id, r.item_id): r.latent for r in md.latent(plays, 4, users, pool).collect()}
    w = np.log1p(x)
    f = np.linalg.svd(w)[2][:4].T
    f /= np.linalg.norm(f, axis=1, keepdims=True)
    u = w @ f
    want = (u / np.linalg.norm(u, axis=1, keepdims=True)) @ f[:5].T
    assert set(got) == {(u, i) for u in range(0, 40, 2) for i in range(5)}
    assert all(abs(got[k] - want[k]) < 1e-6 for k in got)
