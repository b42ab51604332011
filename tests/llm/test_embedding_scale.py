"""Embedding near-duplicates: extreme components, recall by dimension."""

import numpy as np
import pytest

from inboxlake.llm import embedding_dedup


def test_extreme_components(spark):
    rows = [(0, [1e-200, 2e-200]), (1, [9e-200, 1e-200]), (2, [1e200, 2e200]), (3, [-1e200, 2e200]), (4, [1.0, 2.0]),
            (5, [5e-324, 1e-323]), (6, [1.7e308, 1.7e308]), (7, [3e-310, 3e-310]), (8, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(df).collect()}
    assert {i: r.component_id for i, r in got.items()} == {0: 0, 1: 1, 2: 0, 3: 3, 4: 0, 5: 0, 6: 6, 7: 6, 8: 8}
    assert got[1].n_links == got[3].n_links == got[8].n_links == 0


@pytest.mark.parametrize("dims", [64, 768, 1536])
def test_pairs_at_the_threshold_meet_in_any_dimension(dims):
    rng = np.random.default_rng(dims)
    n, cosine = 1500, 0.9505
    a = rng.standard_normal((n, dims))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b = rng.standard_normal((n, dims))
    b -= (a * b).sum(axis=1)[:, None] * a
    b /= np.linalg.norm(b, axis=1)[:, None]
    b = cosine * a + np.sqrt(1 - cosine ** 2) * b
    tables = embedding_dedup.tables_for(dims)
    x, y = embedding_dedup.codes(a, tables), embedding_dedup.codes(b, tables)
    met = np.zeros(n, bool)
    for t in range(tables):
        met |= embedding_dedup._meets(x[:, t], y[:, t]) | embedding_dedup._meets(y[:, t], x[:, t])
    assert met.mean() >= 0.95
