"""Hard negatives against a plain search in Python integers."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from volquery.llm.negatives import LEAST, MOST, best_in_windows, hard_negatives, planes

NAMES = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def plain(rows, step):
    """``rows``: id, label, vector."""
    good = {(i, int(y), tuple(math.floor(256 * x) for x in v)) for i, y, v in rows if i is not None and y is not None and v and all(x is not None and math.isfinite(x) and abs(256 * x) < 2**31 for x in v)}
    by_size = defaultdict(list)
    for r in good:
        by_size[len(r[2])].append(r)
    out = Counter()
    for a in good:
        if a[0] % step:
            continue
        scored = [(sum(x * y for x, y in zip(a[2], r[2])), r[0], r[1]) for r in by_size[len(a[2])] if r[0] != a[0]]
        scored = sorted((-s, i, y) for s, i, y in scored if -(2**63) <= s < 2**63)
        for p in [r for r in scored if r[2] == a[1]][:5]:
            hard = [r for r in scored if r[2] != a[1] and LEAST * -p[0] <= 100 * -r[0] <= MOST * -p[0]][:3]
            out.update((a[0], p[1], n, r[1], -p[0], -r[0]) for n, r in enumerate(hard, 1))
    return out


def frame(spark, rows):
    data = [(i, y, v, "c", 0) for i, y, v in rows]
    return spark.createDataFrame(data, "vec_id long, label int, embedding array<float>, code string, _row int").repartition(3)


def got(found):
    return Counter(tuple(r[c] for c in NAMES) for r in found.collect())


def table(seed, n, size, spread=0.4):
    rng = np.random.default_rng(seed)
    centre = rng.normal(0, spread, (4, size))
    v = np.float32(centre[rng.integers(0, 4, n)] + rng.normal(0, spread / 3, (n, size)))
    return [(i, int(rng.integers(0, 5)), [float(x) for x in v[i]]) for i in range(n)]


@pytest.mark.parametrize("values", [1 << 19, 640])
def test_equal_to_a_plain_search(spark, values):
    rows = table(1, 700, 16)
    rows += [(1000 + i, i % 3, rows[5][2]) for i in range(60)]  # copies under several labels: ties
    found = hard_negatives(frame(spark, rows), F.col("vec_id") % 20 == 0, values=values)
    assert got(found) == plain(rows, 20) and found.columns == list(NAMES)


def test_nasty_rows(spark):
    rng = random.Random(2)
    rows = table(3, 80, 8)
    nan, big = float("nan"), float("inf")
    rows += [(0, 1, rows[0][2]), rows[10], rows[10], (20, 3, rows[20][2]), (None, 1, rows[1][2]), (100, None, rows[2][2]), (200, 2, None), (300, 2, []), (400, 1, [None] * 8), (500, 1, [nan] + [0.1] * 7), (600, 1, [-big] + [0.1] * 7), (700, 1, [1e30] * 8)]
    rows += [(800 + i, i % 2, [rng.uniform(-1, 1) for _ in range(3)]) for i in range(30)] + [(900 + i, i % 2, [rng.uniform(-8e6, 8e6) for _ in range(8)]) for i in range(30)]
    rows += [(990, 1, [0.0] * 8), (1000, 1, [0.0] * 8), (1010, 2, [0.0] * 8)]
    rows = [(i, y, v and [None if x is None else float(np.float32(x)) for x in v]) for i, y, v in rows]
    assert got(hard_negatives(frame(spark, rows), F.col("vec_id") % 10 == 0)) == plain(rows, 10)
    none = hard_negatives(frame(spark, rows).limit(0), F.col("vec_id") % 10 == 0)
    assert none.count() == 0 and none.columns == list(NAMES)


def test_planes_add_up():
    rows = np.array([[5, -7, 0], [-128, 127, -1]])
    assert (sum(w * b.astype(int) for w, b, _ in planes(rows)) == rows).all()
    assert [r for *_, r in planes(rows)][0] == 127 and [r for *_, r in planes(rows)][-1] == 0
    assert len(list(planes(np.zeros((2, 2), int)))) == 1


@pytest.mark.parametrize("reach", [3, 1 << 10, 1 << 30])
def test_intervals_drop_no_answer(reach):
    rng = np.random.default_rng(reach)
    for _ in range(20):
        a, x = rng.integers(-reach, reach, (3, 5)), rng.integers(-reach, reach, (40, 5))
        allowed = rng.random((3, 40)) < 0.8
        exact = a.astype(object) @ x.T.astype(object)
        edge = sorted(int(v) for v in exact.ravel())
        windows = np.array([[[edge[20], edge[60]], [edge[50], edge[50]], [1, 0]]] * 3, dtype=object)
        windows = windows.astype(np.int64) if abs(edge[0]) < 1 << 62 and edge[-1] < 1 << 62 else np.array([[[-(1 << 62), 1 << 62], [0, 1 << 61], [1, 0]]] * 3)
        ids = rng.permutation(40)
        found = Counter(zip(*(v.tolist() for v in best_in_windows(a, windows, x, ids, allowed.copy(), 3))))
        wanted = Counter()
        for i in range(3):
            for w in range(3):
                inside = sorted((-int(exact[i, j]), int(ids[j]), j) for j in range(40) if allowed[i, j] and windows[i, w, 0] <= exact[i, j] <= windows[i, w, 1])
                wanted.update((i, w, j, -s) for s, _, j in inside[:3])
        assert found == wanted
