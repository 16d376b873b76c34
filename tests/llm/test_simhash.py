from __future__ import annotations

import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from tripline.llm import simhash

SF = "/root/testdata/sf0.001"


def brute_rows(rows):
    fp = [(i, brute.fingerprint(t)) for i, t in rows]
    label = brute.components(sorted({f for _, f in fp}), lambda a, b: bin(a ^ b).count("1") <= 3)
    least = {}
    for i, f in fp:
        if i is not None:
            least[label[f]] = min(least.get(label[f], i), i)
    return sorted(((i, f"{f:016x}", least.get(label[f])) for i, f in fp), key=repr)


def test_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = sorted((tuple(r) for r in simhash.near_duplicates(docs).collect()), key=repr)
    assert got == brute_rows([(r.doc_id, r.text) for r in docs.collect()])


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(30000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "A b"), (5, "a\x0bB"), (5, "a\x0bB"), (None, "a b"), (None, "zz"), (7, long), (8, long + " x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit(1)).withColumn("key", F.lit("k"))
    got = sorted((tuple(r) for r in simhash.near_duplicates(docs).collect()), key=repr)
    assert got == brute_rows(rows)
    assert simhash.near_duplicates(docs.limit(0)).collect() == []


def test_hash_is_sparks_xxhash64(spark):
    import pyarrow as pa

    digests, first = simhash.shingle_digests(pa.array(["É  bà x\nC d"]))
    want = [r[0] % 2**64 for r in spark.sql("select xxhash64(s) from values ('É bà x'), ('bà x c'), ('x c d') as t(s)").collect()]
    assert digests.tolist() == want and first.tolist() == [0, 3]


@pytest.mark.parametrize("large", [2, 2048])
def test_links_by_pairs_by_finer_keys_and_by_flips(spark, monkeypatch, large):
    monkeypatch.setattr(simhash, "LARGE", large)
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    near = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(150)}
    fps = sorted(near | {rng.getrandbits(64) for _ in range(50)})
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    found = {}
    from tripline.llm.components import connected_components

    for node, label in connected_components(simhash.links(df)).collect():
        found[node % 2**64] = label % 2**64
    want = brute.components(fps, lambda a, b: bin(a ^ b).count("1") <= 3)
    groups = lambda of: sorted(sorted(f for f in fps if of(f) == g) for g in {of(f) for f in fps})
    assert groups(lambda f: found.get(f, f)) == groups(want.get)
