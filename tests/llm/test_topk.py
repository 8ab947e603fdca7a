import math
import random

import numpy as np
from pyspark.sql import Row

from sparkledger.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int, b int, rank string"


def brute(rows, k=10, every=100):
    q = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    seen = set()
    for i, v in q:
        if i % every or (i, tuple(v)) in seen:
            continue
        seen.add((i, tuple(v)))
        near = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in q if j != i and len(w) == len(v))[:k]
        out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(near)]
    return sorted(out)


def rows():
    rng = random.Random(4)
    hot = [rng.uniform(-0.4, 0.4) for _ in range(16)]
    out = []
    for i in range(-50, 900):
        v = hot if i % 3 == 0 else [rng.uniform(-0.7, 0.7) for _ in range(16)]
        out.append((i, v))
    out += [(1000, None), (1100, [None] * 16), (1200, [float("nan")] + hot[1:]), (1300, [float("inf")] + hot[1:]), (None, hot), (1400, [0.0] * 16), (1500, [1.5, -2.5]), (1501, [0.25, 0.5]), (301, hot), (301, hot), (1600, []), (1601, [])]
    return out


def test_against_brute_force(spark):
    data = rows()
    df = spark.createDataFrame([Row(vec_id=i, embedding=v, label=1, b=3, rank="x") for i, v in data], SCHEMA)
    for size in ({}, {"block_rows": 200, "block_queries": 4}):
        got = topk.exact_top_k(df, df.where("vec_id % 100 = 0"), **size).collect()
        assert sorted(map(tuple, got)) == brute(data)


def test_empty_and_few(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert topk.exact_top_k(none, none).count() == 0
    few = spark.createDataFrame([Row(vec_id=i, embedding=[float(i)], label=1, b=3, rank="x") for i in (0, 1, 2)], SCHEMA)
    assert sorted(map(tuple, topk.exact_top_k(few, few.where("vec_id = 0")).collect())) == [(0, 1, 1, 0), (0, 2, 2, 0)]
    alone = few.where("vec_id = 0")
    assert topk.exact_top_k(alone, alone).count() == 0


def test_candidates_hold_the_best():
    rng = np.random.default_rng(2)
    for _ in range(30):
        v = rng.integers(-700, 700, (rng.integers(11, 400), 8)) * int(rng.choice([1, 1, 0, 50]))
        q = rng.integers(-900, 900, 8)
        rows_ = topk.SlicedIndex(v).candidates(q, 10)
        scores = v @ q
        least = np.sort(scores)[::-1][9]
        assert set(np.flatnonzero(scores >= least)) <= set(rows_.tolist())


def test_sum_of_slices():
    rng = np.random.default_rng(3)
    v = rng.integers(0, 60, (100, 5))
    q = np.array([3, -7, 0, 11, -1])
    index = topk.SlicedIndex(v)
    slices = index.score_slices(q)
    got = sum((np.unpackbits(s.view(np.uint8), count=100, bitorder="little").astype(np.int64) << w for w, s in enumerate(slices) if s is not None), np.zeros(100, np.int64))
    want = ((v - v.min()) >> index.drop) @ q
    assert len(set((got - want).tolist())) == 1


def test_signed_digits():
    for x in range(-300, 300):
        assert sum(s << k if s > 0 else -(1 << k) for k, s in topk.signed_digits(x)) == x


def test_components_of_any_size(spark):
    """Beyond the slices' range scores are exact integers, and one beyond 64 bits is the nearest that fits; overflows when scaled take no part."""
    rows = [(0, [3.0e6, 1.0]), (1, [2.0e6, -5.0]), (2, [1.0, 1.0]), (3, [-4.0e9, 2.0]), (4, [9.0e15, 1.0]), (5, [1.7e306, 1.0]), (6, [None, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in topk.exact_top_k(df, df, k=3, block_rows=2).collect())
    whole = {i: [math.floor(x * 1024) for x in v] for i, v in rows[:5]}
    want = []
    for q, a in whole.items():
        scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in whole.items() if i != q)[:3]
        want += [(q, n + 1, i, min(max(-s, -(1 << 63)), (1 << 63) - 1)) for n, (s, i) in enumerate(scored)]
    assert got == sorted(want)


def test_vectors_are_shuffled_once(spark):
    """The rows that meet in tasks are each vector once, and each query once for each block."""
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = topk.exact_top_k(df, df.where("vec_id % 100 = 0"), block_rows=100)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 1 and out.count() == 90
