"""The net is fitted on every pair of unlike labels of a group, however large the group is."""

from itertools import permutations

import numpy as np
import pytest

from bidlens.functions import dicts
from bidlens.operators import neural as N

ROWS = [
    (f"g{g}", i, (i * 7 + g) % 4 if i % 11 else None, *np.random.default_rng([g, i]).random(len(dicts.FEATURES)).tolist())
    for g, size in enumerate((1, 2, 9, 30)) for i in range(size)
]


@pytest.mark.parametrize("block", [512, 8, 1])
def test_gradient_counts_every_preference_once(spark, block):
    schema = "group_id string, item_id long, relevance int, " + ", ".join(f"{f} double" for f in dicts.FEATURES)
    weights = N.first_weights(1)
    rows = N.preferences(spark.createDataFrame(ROWS, schema).repartition(3), block)
    got = next(N.gradient_sums(weights)(rows.toArrow().to_batches())).column(0)[0].as_py()
    want = np.zeros(len(got))
    for a, b in permutations(ROWS, 2):
        if a[0] == b[0] and a[2] is not None and b[2] is not None and a[2] > b[2]:
            up, down = (N.forward(weights, np.array([r[3:]])) for r in (a, b))
            gap = down[-1] - up[-1]
            d = -np.exp(gap) / (1 + np.exp(gap))
            grads = [x + y for x, y in zip(N.backward(weights, up, d), N.backward(weights, down, -d))]
            want += np.concatenate([*[g.ravel() for g in grads], [np.log1p(np.exp(gap)).sum(), 1]])
    assert got[-1] == want[-1] > 0 and np.abs(np.array(got) - want).max() < 1e-9
