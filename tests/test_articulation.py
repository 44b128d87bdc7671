"""Largest pieces after single removals, by one search."""

import time

import numpy as np

from spreadframe.operators.kernels import _largest_rest, _neighbours, _pieces


def test_largest_pieces_equal_plain_removals():
    import pandas as pd

    for seed in range(40):
        r = np.random.default_rng(seed)
        n = int(r.integers(2, 24))
        near = _neighbours(pd.DataFrame(r.integers(0, n, (int(n * r.uniform(0.6, 1.6)) + 1, 2)), columns=["src", "dst"]))
        for big in _pieces(near, set()):
            inside = {u: near[u] for u in big}
            assert _largest_rest(near, big) == {v: max((len(p) for p in _pieces(inside, {v})), default=0) for v in big}


def test_a_long_path_takes_one_search():
    n = 20000
    near = {i: {j for j in (i - 1, i + 1) if 0 <= j < n} for i in range(n)}
    start = time.time()
    left = _largest_rest(near, list(range(n)))
    assert time.time() - start < 5 and min(left, key=lambda v: (left[v], v)) == n // 2 - 1
