from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from talentflow.plans import analytics as A


def brute(rows, n):
    held = {}
    for c, name, tier in rows:
        if tier == "Highly Suitable" and name is not None:
            held.setdefault(c, set()).add(name)
    count = Counter(p for names in held.values() for p in combinations(sorted(names), 2))
    return sorted(((a, b, k) for (a, b), k in count.items()), key=lambda r: (-r[2], r[0], r[1]))[:n]


def table(spark, rows):
    return spark.createDataFrame(rows, "candidate_id long, company_name string, suitability string")


@pytest.mark.parametrize("seed,light,seeds", [(1, 3, 4), (2, 5, 2), (3, 1, 3), (4, 64, 32)])
def test_equals_all_pairs(spark, seed, light, seeds):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(90):
        size = int(rng.choice([0, 1, 2, 4, 9, 20]))
        rows += [(c, f"c{int(x):02d}", "Highly Suitable") for x in np.minimum(rng.zipf(1.6, size), 40)]
    rows += [(500, "c01", "Suitable"), (501, None, "Highly Suitable"), (None, "c01", "Highly Suitable"), (None, "c02", "Highly Suitable")]
    want = brute([r for r in rows if r[0] is not None], 10)
    got = [tuple(r) for r in A.n16_shared_talent(table(spark, rows), light=light, seeds=seeds).collect()]
    assert got == want


def test_one_candidate_of_very_many_companies(spark):
    """Two candidates at 4,000 companies each, few light ones: no pairs of all of them."""
    rows = [(c, f"c{i:05d}", "Highly Suitable") for c in (1, 2) for i in range(c * 1000, c * 1000 + 4000)]
    rows += [(10 + k, f"c{i:05d}", "Highly Suitable") for k in range(30) for i in (k % 3, 2500, 6000 + k % 4)]
    got = [tuple(r) for r in A.n16_shared_talent(table(spark, rows)).collect()]
    assert got == brute(rows, 10)
    assert A.n16_shared_talent(table(spark, rows[:0])).count() == 0
