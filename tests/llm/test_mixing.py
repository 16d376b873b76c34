from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import brute
import pytest
from pyspark.sql import functions as F

from tripline.llm import mixing

SF = "/root/testdata/sf0.01"


def brute_targets(sizes):
    """Shares by weight; what is above a cap is reshared until nothing is."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, list(order), 1.5 * sum(sizes.values())
    while free:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] >= 2 * sizes[s]]
        if not over:
            return target | {s: level * weight[s] for s in free}
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            free.remove(s)
    return target


def brute_rates(sizes, target):
    """Bisection on the tilt of one source."""
    total = sum(sizes)
    if target >= 2 * total * (1 - 1e-12):
        return {z: 2.0 for z in sizes}
    mean = total / len(sizes)
    rate = lambda t, z: min(2.0, math.exp(min(1.0, t * z / mean)))
    low, high = -1e6, 1e6
    for _ in range(200):
        t = (low + high) / 2
        low, high = (t, high) if sum(z * rate(t, z) for z in sizes) < target else (low, t)
    return {z: rate(low, z) for z in sizes}


def check(docs):
    rows = docs.collect()
    got = mixing.mix(docs).collect()
    size = lambda r: len(brute.words(r.text))
    assert Counter((r.doc_id, r.source, r.size) for r in got) == Counter((r.doc_id, r.source, size(r)) for r in rows)
    sizes, by = defaultdict(int), defaultdict(list)
    for r in rows:
        sizes[r.source] += size(r)
        by[r.source].append(size(r))
    want = brute_targets(sizes)
    for s in sizes:
        mine = [r for r in got if r.source == s]
        assert all(r.source_size == sizes[s] and r.target == pytest.approx(want[s], rel=1e-9, abs=1e-9) for r in mine)
        rates = brute_rates([z for z in by[s] if z], want[s]) if sizes[s] else {}
        for r in mine:
            assert r.rate == pytest.approx(rates.get(r.size, 1.0), abs=1e-6)
            assert 0 <= r.copies <= 2
            if r.size:
                assert abs(r.copies - r.rate) < 2
        off = abs(sum(r.copies * r.size for r in mine) - want[s])
        assert off <= max(by[s])
    return got


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = check(docs)
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    off = defaultdict(float)
    for r in got:
        off[r.source, r.target] += r.copies * r.size
    assert all(abs(v - t) <= 0.03 * t for (_, t), v in off.items())


@pytest.mark.parametrize("piece", [3, 20000])
def test_odd_rows(spark, monkeypatch, piece):
    monkeypatch.setattr(mixing, "PIECE", piece)
    rng = random.Random(1)
    rows = [(i, "w " * rng.randint(1, 40), rng.choice(["a", "b", "ä", "Z", None])) for i in range(120)]
    rows += [(5, "one two", "hot")] * 60 + [(None, None, "a"), (None, "", "empty"), (7, "x\x0by \n", ""), (8, "y " * 9000, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("sid", F.lit(1)).withColumn("size", F.lit("x"))
    check(docs)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(docs).collect() == []
    docs = spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string")
    assert sorted((r.doc_id, r.copies, r.target) for r in mixing.mix(docs).collect()) == [(1, 1, 0.0), (2, 1, 0.0)]
