from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripline.llm import sharding

SF = "/root/testdata/sf0.001"


def check(docs, shards=16):
    got = sharding.digest(sharding.place_rows(docs, shards)).collect()
    rows = docs.collect()
    raw = lambda t: (t or "").encode()
    want = Counter((r.doc_id, len(raw(r.text)) + 1, zlib.crc32(raw(r.text))) for r in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    n = Counter(r.shard for r in got)
    if got:
        per = [n[s] for s in range(shards)]
        assert max(per) - min(per) <= 1
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    return got


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = check(docs)
    again = sharding.digest(sharding.place_rows(docs.repartition(5), 16)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_odd_rows(spark):
    rows = [(i % 7 or None, None if i % 5 == 0 else "same" if i % 3 else f"t{i}" * (i * 40)) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_tick", F.lit(1)).withColumn("shard", F.lit("x"))
    check(docs)
    check(docs, 3)
    check(docs.limit(1))
    assert check(docs.limit(0)) == []


@pytest.mark.parametrize("seed", range(5))
def test_walk_against_one_key_at_a_time(seed):
    """The same rounds with single keys in place of counts."""
    rng = np.random.default_rng(seed)
    owner = sharding.ring(7, 20, 10)
    ticks = np.sort(np.append(rng.integers(0, 1024, 300), np.full(150, 77)))
    capacity = sharding.capacities(len(ticks), 7)
    room, waiting, placed = capacity.copy(), list(enumerate(ticks)), {}
    while waiting:
        asks = {}
        for key, t in waiting:
            at = next(x % 1024 for x in range(t, t + 1024) if owner[x % 1024] >= 0 and room[owner[x % 1024]] > 0)
            asks[key] = owner[at]
        rest = []
        for key, t in waiting:
            if room[asks[key]]:
                room[asks[key]] -= 1
                placed[key] = asks[key]
            else:
                rest.append((key, t))
        waiting = rest
    rank, counts = {}, Counter(ticks.tolist())
    seen = Counter()
    for key, t in enumerate(ticks.tolist()):
        rank[(t, seen[t])] = key
        seen[t] += 1
    got = {}
    for tick, begin, end, shard, _ in sharding.walk(dict(counts), owner, capacity):
        for r in range(begin, end):
            got[rank[(tick, r)]] = shard
    assert got == placed


def test_growth_moves_little():
    owner, grown = sharding.ring(16), sharding.ring(17)
    home = sharding._clockwise(owner, np.ones(16, dtype=bool))
    other = sharding._clockwise(grown, np.ones(17, dtype=bool))
    moved = home != other
    assert 0.03 < moved.mean() < 0.1 and (other[moved] == 16).mean() > 0.9
