from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripline.llm import topk

SF = "/root/testdata/sf0.001"


def brute_rows(rows, k=20):
    ok = []
    for i, e in rows:
        if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e):
            ok.append((i, [math.floor(64 * x) for x in e]))
    out, done = [], []
    for q, v in ok:
        if q % 20 == 0 and (q, v) not in done:
            done.append((q, v))
            scores = sorted(((-sum(a * b for a, b in zip(v, w)), i) for i, w in ok if i != q))[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scores, 1)]
    return sorted(out)


def test_whole_table(spark, monkeypatch):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    want = brute_rows([(r.vec_id, r.embedding) for r in table.collect()])
    assert sorted(tuple(r) for r in topk.top_scores(table).collect()) == want
    monkeypatch.setattr(topk, "QUERY_BLOCK", 7)
    monkeypatch.setattr(topk, "SLICE", 60)
    assert sorted(tuple(r) for r in topk.top_scores(table).collect()) == want


@pytest.mark.parametrize("seed", range(2))
def test_odd_rows(spark, seed):
    rng = random.Random(seed)
    vec = lambda n: [rng.choice([-1.0, -0.5, 0.0, 0.25, 1.0, rng.uniform(-3, 3)]) for _ in range(n)]
    same = vec(8)
    rows = [(i, rng.choice([same, vec(8), vec(8)])) for i in range(300)]
    rows += [(20, None), (40, []), (60, [None, 1.0]), (80, [float("nan")]), (100, [float("inf"), 1.0]), (None, same), (41, []), (120, vec(5)), (43, [1e6] * 9), (20, same), (20, same), (7, same), (7, same)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit("x")).withColumn("kind", F.lit(1))
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    assert sorted(tuple(r) for r in topk.top_scores(table).collect()) == sorted(merged(rows))
    assert topk.top_scores(table.limit(0)).collect() == []
    assert len(topk.top_scores(table.where("vec_id = 140")).collect()) == 0


def merged(rows):
    """Rows that share an id are one query with the scores of all of them."""
    ids = {}
    for q, r, i, s in brute_rows(rows, 10**9):
        ids.setdefault(q, []).append((-s, i))
    return [(q, r, i, -s) for q, found in ids.items() for r, (s, i) in enumerate(sorted(found)[:20], 1)]


def test_bounds_hold():
    rng = np.random.default_rng(1)
    a, b = rng.integers(-60, 60, (50, 33)), rng.integers(-60, 60, (70, 33))
    exact = a @ b.T
    before = None
    for n in (1, 4, 16, 33):
        bound = topk.segment_statistics(a, n) @ topk.segment_statistics(b, n).T
        assert (bound >= exact - 1e-6).all()
        assert before is None or bound.mean() <= before
        before = bound.mean()
