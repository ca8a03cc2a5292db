"""Sums over the steps of texts: frequent terms by counts, the others row by row."""

import numpy as np
import pytest

from tickerpulse.llm import decontam


@pytest.mark.parametrize("n_often", [0, 3, 40])
def test_step_sums_take_frequent_terms_from_counts(n_often):
    rng = np.random.default_rng(4)
    lengths = np.array([0, 1, 16, 17, 0, 70_000, 5, 0])
    first = np.concatenate([[0], np.cumsum(lengths)])
    terms = np.minimum(rng.zipf(1.3, first[-1]) - 2, 39)  # -1 for words that are no terms
    matrix = rng.standard_normal((40, 7)).astype(np.float32)
    _, start, _ = decontam._windows(first)
    often = decontam._often(-np.bincount(terms[terms >= 0], minlength=40))[:n_often]
    want = np.array([matrix[part[part >= 0]].sum(0, dtype=np.float64) for part in np.split(terms, start[1:])])
    assert decontam._step_sums(terms, start, matrix, often) == pytest.approx(want, abs=1e-4)
    counted, place, step = decontam._often_counts(terms, start, often, len(matrix))
    assert sum(int(c.sum()) for *_, c in counted) + len(place) == (terms >= 0).sum()
    assert not np.isin(terms[place], often).any() and (step == np.searchsorted(start, place, "right") - 1).all()


def test_no_words():
    none = np.zeros(0, np.int64)
    _, start, _ = decontam._windows(np.zeros(3, np.int64))
    assert decontam._step_sums(none, start, np.ones((2, 3), np.float32), np.array([1])).shape == (0, 3)


def test_words_are_looked_up_by_their_first_bits():
    items = decontam.Items([(1, "one two three four five six seven", None)])
    terms = items.terms
    near = np.concatenate([terms, terms + np.uint64(1), terms ^ (np.uint64(1) << decontam.LEAD), np.array([0, 2**64 - 1], np.uint64)])
    # Terms that share their first bits, the last of all among them.
    items.terms = np.unique(np.concatenate([near, terms + np.uint64(9)]))
    items.leads = np.searchsorted(items.terms >> decontam.LEAD, np.arange(1 + (1 << 16), dtype=np.uint64)).astype(np.int32)
    asked = np.concatenate([items.terms, items.terms + np.uint64(3)])
    want = {h: i for i, h in enumerate(items.terms.tolist())}
    assert items.numbers(asked).tolist() == [want.get(h, -1) for h in asked.tolist()]
    assert items.numbers(np.zeros(0, np.uint64)).tolist() == []
