"""The nearest rows come from matrix products; few distances are added up one by one."""

import numpy as np
import pandas as pd

from tickerpulse.operators import neighbors


def _tile(x, y, keys):
    asked = pd.DataFrame({"test_key": np.arange(len(x)), "x": list(x), "reach": 1e9})
    known = pd.DataFrame({"train_key": keys, "label": 0, "x": list(y), "place": 0})
    found = neighbors._best(asked, known, 5, np.zeros((1, x.shape[1])), np.array([1e9]))
    return found.sort_values(["test_key", "distance", "train_key"]).groupby("test_key")["train_key"].apply(list).tolist()


def _plain(x, y, keys):
    return [[int(keys[i]) for i in np.lexsort((keys, neighbors._between(np.broadcast_to(one, y.shape), y)))[:5]] for one in x]


def test_few_pairs_are_added_up(monkeypatch):
    random = np.random.default_rng(3)
    x, y, keys = random.normal(size=(300, 16)), random.normal(size=(5000, 16)), random.permutation(5000)
    want, pairs, between = _plain(x, y, keys), [], neighbors._between
    monkeypatch.setattr(neighbors, "_between", lambda a, b: pairs.append(len(a)) or between(a, b))
    assert _tile(x, y, keys) == want and sum(pairs) < 4 * 5 * 300


def test_copies_ties_and_missing_numbers():
    random = np.random.default_rng(4)
    x, keys = random.integers(0, 3, size=(40, 3)).astype(float), random.permutation(3000)
    grid = random.integers(0, 3, size=(3000, 3)).astype(float)
    assert _tile(x, grid, keys) == _plain(x, grid, keys)
    far = grid * 1e8 + 1.0
    assert _tile(far[:20], far, keys) == _plain(far[:20], far, keys)
    grid[7, 1] = np.nan
    assert _tile(x, grid, keys) == _plain(x, grid, keys)
