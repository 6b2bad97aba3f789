import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from testfloor.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every=5, positives=5, negatives=3):
    """All scores of an anchor, sorted: the definition itself."""
    kept = {}
    for vec_id, vector, label in rows:
        if None in (vec_id, label) or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        kept[(vec_id, label, tuple(math.floor(256 * x) for x in vector))] = None
    out = []
    for a in kept:
        if a[0] % every:
            continue
        score = lambda r: sum(x * y for x, y in zip(a[2], r[2]))
        ranked = sorted((-score(r), r[0], r) for r in kept if r != a)
        for minus, positive, _ in [x for x in ranked if x[2][1] == a[1]][:positives]:
            fit = [x for x in ranked if x[2][1] != a[1] and 50 * -minus <= 100 * -x[0] <= 95 * -minus]
            out += [(a[0], positive, i + 1, x[1], -minus, -x[0]) for i, x in enumerate(fit[:negatives])]
    return sorted(out)


def rows_of(n, dims, labels, seed, step=None):
    rng = random.Random(seed)
    value = lambda: rng.gauss(0, 0.3) if step is None else rng.randint(-2, 2) * step
    near = [[value() for _ in range(dims)] for _ in range(labels)]
    rows = []
    for i in range(n):
        base = near[rng.randrange(labels)] if step is None else [0.0] * dims
        rows.append((i, [float(f"{a + value():.4f}") for a in base], rng.randrange(labels)))
    return rows


@pytest.mark.parametrize(
    "n, dims, labels, step, block, chunk",
    [(300, 8, 3, None, 64, 7), (300, 3, 2, 0.25, 64, 70), (300, 3, 2, 0.25, 1000, 1000), (40, 64, 10, None, 1000, 7), (200, 2, 1, None, 64, 70)],
)
def test_equals_the_definition(spark, n, dims, labels, step, block, chunk):
    rows = rows_of(n, dims, labels, n + dims, step)
    mined = hard_negatives.mine(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 5 == 0, block_rows=block, chunk_anchors=chunk)
    assert sorted(map(tuple, mined.collect())) == brute(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = rows_of(60, 4, 3, 1)
    rows += rows[:20]  # whole repeated rows
    rows += [(5, [1.0, 0.5, 0.0, 0.0], 1), (5, [0.5, 1.0, 0.0, 0.0], 2), (6, [1.0, 1.0], 0), (0, [], 1), (10, [0.0] * 4, 0)]
    rows += [(None, [1.0] * 4, 1), (65, None, 1), (70, [1.0, None, 1.0, 1.0], 1), (75, [nan] * 4, 1), (80, [inf] * 4, 0), (85, [1.0] * 4, None)]
    table = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "label as tag", "'x' as is_anchor", "1 as block")
    padded = [(i, v and v + [0.0] * (4 - len(v)) if v is not None else None, y) for i, v, y in rows]
    assert sorted(map(tuple, hard_negatives.mine(table, F.col("vec_id") % 5 == 0, block_rows=16).collect())) == brute(
        [(i, [0.0] * 4 if v == [] else v, y) for i, v, y in padded]
    )
    assert hard_negatives.mine(table.limit(0), F.col("vec_id") % 5 == 0).count() == 0
    assert hard_negatives.mine(table, F.lit(None).cast("boolean")).count() == 0


def test_large_components(spark):
    """Scores beyond what a double holds are exact; beyond 64 bits an error is raised."""
    rows = [(i, [float(3 + i), 1.0 / (1 + i)], i % 2) for i in range(12)]
    large = [(i, [2.0**15 * v[0], v[1]], y) for i, v, y in rows]
    mined = hard_negatives.mine(spark.createDataFrame(large, SCHEMA), F.col("vec_id") % 5 == 0)
    expected = brute([(i, [float(np.float32(x)) for x in v], y) for i, v, y in large])
    assert sorted(map(tuple, mined.collect())) == expected
    huge = spark.createDataFrame([(0, [1e30], 0), (1, [1e30], 0)], SCHEMA)
    with pytest.raises(Exception, match="64 bits"):
        hard_negatives.mine(huge, F.col("vec_id") % 5 == 0).collect()


def test_search_stops_before_the_end():
    """A clear winner ends the search before the lists are read."""
    values = np.zeros((1000, 4), np.float32)
    values[:, 0] = np.arange(1000)
    lists = hard_negatives.Lists(values, np.argsort(values, axis=0, kind="stable").T.copy())
    rows, scores = lists.search(np.array([1, 0, 0, 0], np.float32), lambda s: hard_negatives._kth(s, 3))
    assert set(scores[np.argsort(-scores)][:3]) == {999, 998, 997} and len(rows) < 100
