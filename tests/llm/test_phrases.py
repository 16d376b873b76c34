from __future__ import annotations

import random

import brute
import pytest
from pyspark.sql import functions as F

from tripline.llm import phrases

SF = "/root/testdata/sf0.001"


def brute_rows(rows):
    inf = float("inf")
    texts = [(inf if d is None else d, brute.words(t)) for d, t in rows]
    first = {}
    for d, w in texts:
        for i in range(len(w) - 12):
            k = tuple(w[i : i + 13])
            first[k] = min(first.get(k, inf), d)
    out = []
    for d, w in texts:
        gone = set()
        for i in range(len(w) - 12):
            if first[tuple(w[i : i + 13])] < d:
                gone.update(range(i, i + 13))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((None if d == inf else d, len(w), len(gone), brute.sha(kept)))
    return sorted(out, key=repr)


def check(docs):
    got = sorted((tuple(r) for r in phrases.remove_repeats(docs).collect()), key=repr)
    assert got == brute_rows([(r.doc_id, r.text) for r in docs.collect()])
    return got


def test_whole_table(spark):
    got = check(spark.read.parquet(f"{SF}/documents.parquet"))
    assert sum(r[2] for r in got) > 0


@pytest.mark.parametrize("hot,shard", [(2000, 20000), (3, 5)])
def test_shared_passages(spark, monkeypatch, hot, shard):
    monkeypatch.setattr(phrases, "HOT", hot)
    monkeypatch.setattr(phrases, "SHARD", shard)
    rng = random.Random(hot)
    vocabulary = [f"w{i}" for i in range(12)] + ["é", "漢字"]
    shared = [[rng.choice(vocabulary) for _ in range(rng.randint(10, 60))] for _ in range(6)]
    rows = []
    for d in range(120):
        w = []
        for _ in range(rng.randint(0, 4)):
            w += [rng.choice(vocabulary) for _ in range(rng.randint(0, 15))]
            part = rng.choice(shared)
            w += part[rng.randint(0, 5) : len(part) - rng.randint(0, 5)] * rng.randint(1, 2)
        rows.append((rng.choice([d, d, d, None, 7]), rng.choice([" ", "\t", " \n"]).join(w)))
    check(spark.createDataFrame(rows + rows[:3], "doc_id long, text string"))


def test_odd_rows(spark):
    long = " ".join(f"w{i % 5000}" for i in range(30000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "For " * 40), (5, "For " * 13), (5, "For " * 13), (None, "For " * 14), (6, long), (7, "x " + long), (8, long + "tail")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kid", F.lit(1)).withColumn("starts", F.lit("x"))
    check(docs)
    assert check(docs.limit(0)) == []


def test_many_rows_without_an_id(spark):
    """All rows without an id are one document: what they share among themselves stays."""
    rng = random.Random(9)
    shared = [f"s{i}" for i in range(60)]
    rows = [(None, " ".join([f"{d}x{i}" for i in range(40)] + shared[rng.randint(0, 9) :])) for d in range(400)]
    rows += [(3, "a " + " ".join(shared[20:50])), (4, " ".join(shared[:30]) + " b")]
    got = check(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sum(r[2] for r in got if r[0] is None) > 400 * 30


@pytest.mark.parametrize("shard", [20000, 5])
def test_automata_find_windows_of_earlier_documents(monkeypatch, shard):
    monkeypatch.setattr(phrases, "SHARD", shard)
    words = [f"w{i}" for i in range(30)]
    first, later, same = " ".join(words[:20]), " ".join(["x"] + words[5:20]), " ".join(words[3:16])
    assert phrases.locate([later, first, same], [7, 2, 2]) == [[1, 2, 3], [], []]
    assert phrases.locate([first, "a " * 12 + "a"], [1, 2]) == [[], []]
