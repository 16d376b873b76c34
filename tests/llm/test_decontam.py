from __future__ import annotations

import random
from collections import Counter

import brute
from pyspark.sql import functions as F

from tripline.llm import decontam

SF = "/root/testdata/sf0.01"


def grams(w):
    k = min(5, len(w))
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else Counter()


def want(text, items):
    w = brute.words(brute.lower(text))
    out = {}
    for i, item in items:
        if not item or not w:
            continue
        k = min(5, len(item))
        if len(w) < k:
            continue
        target = grams(item)
        for s in range(max(1, len(w) - len(item) + 1)):
            part = w[s : s + len(item)]
            have = Counter(tuple(part[j : j + k]) for j in range(len(part) - k + 1))
            n = sum((have & target).values())
            if n / (sum(have.values()) + sum(target.values()) - n) >= 0.8:
                out[i] = 1
    return sorted(out)


def test_against_brute_force(spark):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    items = [(r.item_id, brute.words(brute.lower(r.text))) for r in bench.collect()]
    known = {g for _, w in items for g in grams(w)}
    got = {r.doc_id: r.item_ids for r in decontam.contaminated(docs, bench).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        w = brute.words(brute.lower(r.text))
        # Without a shared shingle no window can match; this only spares time.
        maybe = any(tuple(w[i : i + 5]) in known for i in range(len(w) - 4))
        assert got[r.doc_id] == (want(r.text, items) if maybe else [])
    assert sum(map(bool, got.values())) > 5


def test_edited_passages(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    items = [(i, [word() for _ in range(rng.randint(6, 60))]) for i in range(60)] + [(99, ["a", "b"]), (98, ["q"]), (97, [])]
    docs = []
    for d in range(300):
        part = list(rng.choice(items)[1])
        for _ in range(rng.randint(0, 2)):
            if part:
                part[rng.choice([0, -1, rng.randrange(len(part))])] = word()
        docs.append((d, " ".join([word() for _ in range(rng.randint(0, 30))] + part + [word() for _ in range(rng.randint(0, 30))]).title()))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    got = {r.doc_id: r.item_ids for r in decontam.contaminated(df, bench).collect()}
    pairs = {(d, i) for d, t in docs for i in want(t, items)}
    mine = {(d, i) for d, ids in got.items() for i in ids}
    assert mine <= pairs and len(mine) >= 0.99 * len(pairs)


def test_odd_rows_and_parts(spark, monkeypatch):
    item = " ".join(f"w{i}" for i in range(20))
    bench = spark.createDataFrame([(1, item), (1, item), (2, None), (None, item), (3, ""), (4, "x y")], "item_id long, text string")
    rows = [(1, None), (1, ""), (None, item.upper()), (2, item[:-4]), (2, item[:-4]), (3, "b " * 30000 + item + " c" * 30000), (4, "a x  Y b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_ids", F.lit(1)).withColumn("id", F.lit("x"))
    expect = sorted([(1, []), (1, []), (None, [1]), (2, [1]), (2, [1]), (3, [1]), (4, [4])], key=repr)
    assert sorted(((r.doc_id, r.item_ids) for r in decontam.contaminated(docs, bench).collect()), key=repr) == expect
    assert decontam.contaminated(docs.limit(0), bench).collect() == []
    assert all(not r.item_ids for r in decontam.contaminated(docs, bench.limit(0)).collect())
    monkeypatch.setattr(decontam, "PART_WORDS", 15)
    parts = decontam.contaminated(docs, bench).collect()
    assert {(r.doc_id, tuple(r.item_ids)) for r in parts} == {(d, tuple(i)) for d, i in expect}
