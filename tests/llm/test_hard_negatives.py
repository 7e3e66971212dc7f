"""Hard negatives against scoring every pair of rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from offerlake.llm.hard_negatives import ApproximationFile, candidates, mine_hard_negatives, pack, unpack

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows, anchors=lambda i: i % 100 == 0):
    kept = []
    for vec_id, v, label in rows:
        if v is None or label is None or any(x is None or not np.isfinite(np.float32(x)) for x in v):
            continue
        label = (label + 1) % 10 if vec_id is not None and vec_id % 7 == 0 else label
        kept.append((vec_id, label, [max(-(1 << 23), min(1 << 23, int(np.floor(256 * float(np.float32(x)))))) for x in v]))
    out = []
    first = lambda x: (-x[0], x[1] is None, x[1])
    for i, (a, label, v) in enumerate(kept):
        if a is None or not anchors(a):
            continue
        scored = [(sum(x * y for x, y in zip(v, w, strict=False)), b, other == label) for j, (b, other, w) in enumerate(kept) if j != i]
        for k, (p, b, _) in enumerate(sorted([s for s in scored if s[2]], key=first)[:5], 1):
            held = sorted([s for s in scored if not s[2] and 30 * p <= 100 * s[0] <= 90 * p], key=first)[:10]
            out += [(a, b, rank, c, p, n, k) for rank, (n, c, _) in enumerate(held, 1)]
    return out


def by_value(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: [(x is None, x) for x in r])


def vectors(n, dims, rng):
    out = []
    for i in range(n):
        v = [rng.gauss(0.05, 0.3) for _ in range(dims)]
        out.append((i, v, rng.randint(0, 3)))
    return out


@pytest.mark.parametrize("args", [{}, {"least_rows": 20, "most_blocks": 40}, {"most_rows": 50, "least_rows": 1000, "cells": 4}])
def test_equals_all_pairs(spark, args):
    rng = random.Random(1)
    rows = vectors(700, 12, rng)
    rows += [(1000 + i, rows[0][1], i % 2) for i in range(60)]  # many ties
    rows += [(300, rows[3][1], 1), (300, rows[3][1], 1), (None, rows[0][1], 2), (None, rows[200][1], None), (800, None, 1), (900, [0.5, None], 1), (1100, [float("nan")] * 12, 1), (1200, [float("inf")] * 12, 1), (1300, [], 1), (1400, [1.0, 2.0], 2), (1500, [3e38, 1.0], 3), (-100, rows[5][1], 0), (2000, [0.0] * 12, 9)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("row", F.lit("clash")).withColumn("block", F.lit(1)).repartition(4)
    got = mine_hard_negatives(df, **args).collect()
    want = brute(rows)
    assert len(want) > 300 and by_value(got) == by_value(want)


def test_no_rows_and_no_partners(spark):
    assert mine_hard_negatives(spark.createDataFrame([], SCHEMA)).collect() == []
    assert mine_hard_negatives(spark.createDataFrame([(100, [1.0], 1), (7, [1.0], None), (None, None, None)], SCHEMA)).collect() == []


def test_bounds_hold_and_candidates_lose_none():
    rng = np.random.default_rng(2)
    v, q = rng.integers(-90, 90, (500, 16)), rng.integers(-90, 90, (7, 16))
    low, high = ApproximationFile(v, 8).bounds(q, slice(0, 500))
    exact = q @ v.T
    assert (low <= exact).all() and (exact <= high).all()
    for i in range(7):
        for least, most in ((-10_000_000, 10_000_000), (0, 9000), (5, 4), (-3000, 100)):
            inside = [j for j in range(500) if least <= exact[i, j] <= most]
            best = sorted(inside, key=lambda j: -exact[i, j])[:10]
            ties = {j for j in inside if best and exact[i, j] >= exact[i, best[-1]]}
            assert ties <= set(candidates(low[i], high[i], least, most, 10).tolist())


def test_packed_rows_of_any_length():
    rows = [np.array([], np.int32), np.array([-1, 5], np.int32), np.array([1 << 23, -(1 << 23), 0], np.int32)]
    assert unpack([pack(r) for r in rows], 3).tolist() == [[0, 0, 0], [-1, 5, 0], [1 << 23, -(1 << 23), 0]]
