from __future__ import annotations

import random
from collections import Counter
from itertools import combinations

import pytest

from larkspur.llm import cooccurrence


@pytest.mark.parametrize(("large", "collide"), [(2, False), (256, False), (256, True)])
def test_against_brute_force(spark, monkeypatch, large, collide):
    monkeypatch.setattr(cooccurrence, "LARGE_BASKET", large)
    if collide:
        monkeypatch.setattr(cooccurrence, "_hashes_collide", lambda items: True)
    r = random.Random(4)
    rows = [(b, f"i{min(int(r.expovariate(0.25)), 14)}") for b in range(80) for _ in range(r.randint(1, 7))]
    rows += rows[:40] + [(None, "i1"), (3, None)]
    baskets = {}
    for b, i in rows:
        if b is not None and i is not None:
            baskets.setdefault(b, set()).add(i)
    n, ones = len(baskets), Counter(i for v in baskets.values() for i in v)
    twos = Counter(p for v in baskets.values() for p in combinations(sorted(v), 2))
    want = {(a, b, ones[a], ones[b], c, n) for (a, b), c in twos.items() if c >= 3 and c * n >= 1.2 * ones[a] * ones[b]}
    df = spark.createDataFrame([(*x, "clash") for x in rows], "b int, i string, n_ab string")
    got = cooccurrence.pair_counts(df, "b", "i", 3, 1.2).collect()
    assert {(r.item_a, r.item_b, r.n_a, r.n_b, r.n_ab, r.n_baskets) for r in got} == want and len(got) == len(want) > 3
    for r in got:
        assert r.lift == pytest.approx(r.n_ab * n / (r.n_a * r.n_b))
        if r.n_ab < r.n_a:
            assert r.conviction == pytest.approx((1 - r.n_b / n) / (1 - r.n_ab / r.n_a))


def test_no_rows(spark):
    assert cooccurrence.pair_counts(spark.createDataFrame([], "b int, i string"), "b", "i").count() == 0
