"""Tables of a dish given its customers (op12): against the plain recurrence and the customer-by-customer sampler."""

import numpy as np
import pytest

from flowbook.llm import pitman_yor, tables


def log_numbers(c, d):
    """log S(c, t) for t = 1 .. c, row by row."""
    row = np.array([0.0])
    for n in range(1, c):
        stay = np.append(np.log(n - d * np.arange(1, n + 1)) + row, -np.inf)
        row = np.logaddexp(stay, np.append(-np.inf, row))
    return row


def chances(c, d, new):
    w = log_numbers(c, d) + np.arange(1, c + 1) * np.log(new)
    w = np.exp(w - w.max())
    return w / w.sum()


@pytest.mark.parametrize("d", [0.05, 0.4, 0.7, 0.95])
def test_weights_of_many_customers(d):
    for c in (tables.TABLED, 1700):
        t = np.arange(1, c + 1)
        got = tables.log_weight(np.full(c, c), t, d)
        assert np.allclose(got - got[0], log_numbers(c, d) - log_numbers(c, d)[0], atol=1e-7)
    assert np.allclose(tables.log_stirling(d)[300], log_numbers(300, d), atol=1e-9)


@pytest.mark.parametrize(("c", "d", "new"), [(2, 0.5, 0.3), (4, 0.4, 0.9), (60, 0.7, 5.0), (1000, 0.7, 0.8), (1500, 0.7, 0.8), (1500, 0.9, 40.0), (1500, 0.3, 1e-4), (1500, 0.6, 1e6)])
def test_tables_follow_their_chances(c, d, new):
    n = 4000
    got = tables.seated(np.full(n, c), np.full(n, new), d, np.random.default_rng(7))
    p, t = chances(c, d, new), np.arange(1, c + 1)
    mean = p @ t
    assert abs(got.mean() - mean) < 5 * np.sqrt(p @ (t - mean) ** 2 / n) + 1e-9
    have = np.bincount(got, minlength=c + 1)[1:] / n
    assert np.abs(have - p).sum() < 0.02 + 1.2 * np.sqrt(p * (1 - p) / n).sum()


def test_one_by_one_tends_to_the_same():
    n, c, d, new = 4000, 12, 0.6, 1.5
    s = pitman_yor.Seats(np.full(n, c), np.full(n, new), d, np.random.default_rng(1))
    for _ in range(20):
        s.sweep(np.full(n, new), c)
    got = tables.seated(np.full(n, c), np.full(n, new), d, np.random.default_rng(2))
    assert np.abs(np.bincount(s.tables, minlength=c + 1) - np.bincount(got, minlength=c + 1)).sum() < 0.1 * n


def test_dishes_of_any_count_at_once():
    rng = np.random.default_rng(3)
    customers = rng.permutation(np.concatenate([np.zeros(50), np.ones(50), rng.integers(2, 900, 500), [1024, 1025, 4000, 10 ** 6, 10 ** 8]])).astype(np.int64)
    got = tables.seated(customers, np.full(len(customers), 2.0), 0.7, np.random.default_rng(4))
    assert ((got > 0) == (customers > 0)).all() and (got <= customers).all()
    assert (got == tables.seated(customers, np.full(len(customers), 2.0), 0.7, np.random.default_rng(4))).all()
    assert len(tables.seated(np.zeros(0, np.int64), np.zeros(0), 0.7, rng)) == 0
    few = got[customers > 10 ** 5]  # a Poisson number of tables beside the largest, new / discount on average
    assert (few < 20).all()


def test_a_sweep_seats_all_customers():
    """Words of 300 customers each in one restaurant: their tables follow the chances of 300
    customers, also where the first seating, by other weights, was far off."""
    n, c, d = 2000, 300, 0.7
    known = pitman_yor.Corpus(n * c, n, np.zeros(0, np.uint64), 1)
    at = pitman_yor.Totals(np.array([3 * n, n * c]), np.array([n, 3 * n]))
    none = pitman_yor.Totals(np.zeros(0, np.int64), np.zeros(0, np.int64))
    model = pitman_yor.Model(corpus=known, discount=d, root_discount=0.5, history=(at, at, at), seed=5)
    rounds = list(pitman_yor.replay(model, 0, np.arange(n), np.ones(n, np.int64), np.full(n, c), 2, [none] * 3))
    (_, customers, parents, _), (last, *_) = rounds
    new = (pitman_yor.STRENGTH + d * at.tables[1]) * pitman_yor.root_predictive(model, at, customers, parents)
    want = sum(chances(c, d, x) @ np.arange(1, c + 1) for x in new[::10]) * 10
    assert abs(last.sum() / want - 1) < 0.05
