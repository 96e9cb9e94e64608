from collections import Counter

import numpy as np

from trolley.functions import geocells
from trolley.operators import geo


def test_sums_around_without_sending_the_copies(spark):
    rng, precision = np.random.default_rng(3), 2
    wide, high = (1 << bits for bits in geocells.axis_bits(precision))
    data = [(int(rng.integers(wide)), int(rng.integers(high)), int(rng.integers(3)), int(rng.integers(1, 9))) for _ in range(400)]
    data += [(x, y, 7, 1) for x in (0, 7, 8, wide - 1) for y in (0, 7, 8, high - 1)]
    per_cell = spark.createDataFrame(data, "x bigint, y bigint, product_id bigint, n bigint")
    want = Counter()
    for x, y, item, n in data:
        for to in {((x + i) % wide, y + j) for i in (-1, 0, 1) for j in (-1, 0, 1) if 0 <= y + j < high}:
            want[(*to, item)] += n
    found = geo._sums_around(per_cell, precision)
    assert {(r.x, r.y, r.product_id): r.cnt for r in found.collect()} == dict(want)
    plan = geo._sums_around(per_cell, precision)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
