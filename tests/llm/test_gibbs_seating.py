"""The Gibbs sweeps of op10 against plain samplers and sums that share no code with them."""

import itertools
import math
import random

import numpy as np
import pytest

from casewright.llm import pitman_yor

CUSTOMERS, PARENT = [9, 7, 1, 4], [0.3, 0.02, 0.1, 0.2]
COPIES = 3000


def mean_seats(burn):
    n = len(CUSTOMERS)
    name = np.random.default_rng(1).integers(1, 2**63, n * COPIES, dtype=np.uint64)
    args = np.tile(CUSTOMERS, COPIES), np.log(np.tile(PARENT, COPIES)), np.full(n * COPIES, n - 1.0), name
    alone = pitman_yor.seat(*args, burn=burn)
    assert (alone == pitman_yor.seat(*args, burn=burn, restaurant=np.repeat(np.arange(COPIES), n))).all()
    return alone.reshape(COPIES, n).mean(0)


def exact():
    """Means over all numbers of tables, weighed by the recurrence for seatings and the restaurant's total."""
    s = {(1, 1): 1.0}
    for c in range(1, max(CUSTOMERS)):
        for t in range(1, c + 2):
            s[c + 1, t] = s.get((c, t - 1), 0) + (c - 0.5 * t) * s.get((c, t), 0)
    total, sums = 0.0, np.zeros(len(CUSTOMERS))
    for t in itertools.product(*(range(1, c + 1) for c in CUSTOMERS)):
        own = math.prod(s[c, k] * p**k for c, k, p in zip(CUSTOMERS, t, PARENT)) * 0.5 ** sum(t) * math.gamma(2 + sum(t))
        total, sums = total + own, sums + own * np.array(t)
    return sums / total


def chinese_restaurant(sweeps):
    """Mean tables of a plain sampler that takes up and seats one customer after another."""
    draw = random.Random(3)
    tables = [[1] * c for c in CUSTOMERS]
    sums = np.zeros(len(CUSTOMERS))
    for sweep in range(sweeps):
        for dish, p in enumerate(PARENT):
            for _ in range(CUSTOMERS[dish]):
                own = tables[dish]
                i = draw.choices(range(len(own)), own)[0]
                own[i] -= 1
                if not own[i]:
                    own.pop(i)
                weights = [k - 0.5 for k in own] + [(1 + 0.5 * sum(map(len, tables))) * p]
                i = draw.choices(range(len(weights)), weights)[0]
                own.append(1) if i == len(own) else own.__setitem__(i, own[i] + 1)
        if sweep >= 50:
            sums += [len(x) for x in tables]
    return sums / (sweeps - 50)


def test_sweeps_follow_the_restaurants_current_tables():
    want = exact()
    assert chinese_restaurant(12_000) == pytest.approx(want, rel=0.03)
    assert mean_seats(burn=15) == pytest.approx(want, rel=0.01)
    assert mean_seats(burn=2) == pytest.approx(want, rel=0.03)  # the chain begins near the likeliest tables


def test_tables_of_many_customers_are_drawn_by_their_weight():
    c, x, n = 400.0, 30.0, 20_000
    t = np.arange(1, c + 1)
    log = np.array([math.lgamma(2 * c - k) - math.lgamma(c - k + 1) - math.lgamma(k) + k * math.log(4 * x) for k in t])
    weight = np.exp(log - log.max())
    for u in (1e-9, 0.1, 0.5, 0.9, 1 - 1e-9):
        got = pitman_yor.draw_tables(np.array([3.0, c]), np.array([x, x]), np.array([u, u]))[1]
        assert got == t[np.searchsorted(np.cumsum(weight) / weight.sum(), u)]
    u = (np.arange(n) + 0.5) / n
    assert pitman_yor.draw_tables(np.full(n, c), np.full(n, x), u).mean() == pytest.approx((weight * t).sum() / weight.sum(), rel=1e-3)
