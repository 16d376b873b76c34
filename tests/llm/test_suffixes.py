from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tripline.llm import suffixes

SF = "/root/testdata/sf0.001"


def brute_rows(rows):
    """``rows``: doc_id, text, hash of the text. All windows of all rows in one dictionary."""
    order = lambda r: (suffixes.LAST if r[0] is None else r[0], r[2])
    first = {}
    for r in sorted(rows, key=order):
        raw = (r[1] or "").encode()
        for i in range(len(raw) - 99):
            first.setdefault(raw[i : i + 100], (order(r), i))
    out = []
    for r in rows:
        raw = (r[1] or "").encode()
        gone = np.zeros(len(raw) + 1, dtype=bool)
        for i in range(len(raw) - 99):
            if first[raw[i : i + 100]] < (order(r), i):
                gone[i : i + 100] = True
        spans = int((gone[:-1] & ~np.append(False, gone[:-2])[: len(raw)]).sum()) if len(raw) else 0
        kept = bytes(np.frombuffer(raw, dtype=np.uint8)[~gone[:-1]])
        out.append((r[0], len(raw), int(gone[:-1].sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def check(docs):
    got = sorted((tuple(r) for r in suffixes.digest(docs).collect()), key=repr)
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()
    assert got == brute_rows([tuple(r) for r in rows])
    return got


def test_whole_table(spark):
    got = check(spark.read.parquet(f"{SF}/documents.parquet"))
    assert sum(r[2] for r in got) > 10_000


@pytest.mark.parametrize("hot", [500, 3, 1])
def test_shared_passages_in_many_contexts(spark, monkeypatch, hot):
    monkeypatch.setattr(suffixes, "HOT", hot)
    rng = random.Random(hot)
    word = lambda n: "".join(rng.choice("ab é漢") for _ in range(n))
    shared = [word(rng.randint(30, 250)) for _ in range(5)] + ["ab" * 90, "x" * 130]
    rows = []
    for d in range(150):
        text = ""
        for _ in range(rng.randint(0, 4)):
            part = rng.choice(shared)
            text += word(rng.randint(0, 40)) + part[rng.randint(0, 20) : len(part) - rng.randint(0, 20)] * rng.randint(1, 2)
        rows.append((rng.choice([d, d, d, None, 7]), text))
    check(spark.createDataFrame(rows + rows[:4], "doc_id long, text string").repartition(4))


def test_odd_rows(spark):
    long = "".join(chr(97 + i * i % 7) for i in range(300_000))
    rows = [(1, None), (2, ""), (3, "z" * 99), (4, "z" * 100), (5, "z" * 250), (5, "z" * 250), (5, "z" * 101), (None, "y" * 140), (None, "y" * 140), (6, long), (7, "é" + long)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs = docs.withColumn("kid", F.lit(1)).withColumn("key", F.lit("x")).withColumn("marks", F.lit(None).cast("int")).withColumn("at", F.lit(0))
    check(docs)
    assert check(docs.limit(0)) == []


@pytest.mark.parametrize("base", [suffixes.BASE, 1, 3])
def test_collisions_are_found_and_mended(monkeypatch, base):
    """With base 1 a hash is a sum of bytes, so that most comparisons are wrong."""
    monkeypatch.setattr(suffixes, "BASE", base)
    rng = random.Random(base)
    common = bytes(rng.choice(b"ab") for _ in range(32))
    rows = []
    for key in range(12):
        for kid in range(rng.randint(1, 9)):
            place = rng.choice([0, 10, 68])
            n = rng.randint(1, place + 1)
            ahead = bytes(rng.choice(b"ab") if rng.random() < 0.05 else 97 for _ in range(place))
            behind = bytes(rng.choice(b"ab") if rng.random() < 0.05 else 98 for _ in range(68))
            rows.append((key, kid, 0, 5, n * 128 + place, (ahead + common + behind)[: n + 99]))
    names = ["key", "kid", "text_hash", "at", "shape", "text"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    table = pa.table([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
    first, wanted = {}, set()
    for key, kid, _, at, shape, text in rows:
        for j in range(shape >> 7):
            if first.setdefault((key, (shape & 127) - j, text[j : j + 100]), kid) != kid:
                wanted.add((key, kid, at + j))
    got = set()
    for key in range(12):
        marks = suffixes.shard_marks(table.filter(pa.array([r[0] == key for r in rows])))
        got |= {(key, r["kid"], r["at"] + i) for r in marks.to_pylist() for i in range(r["n"])}
    assert got == wanted and wanted
    whole = sum(r["n"] for r in suffixes.shard_marks(table).to_pylist())
    monkeypatch.setattr(suffixes, "SHARD", 3)
    pieces = sum(r["n"] for b in suffixes._sorted_rows(iter(table.to_batches(max_chunksize=4))) for r in b.to_pylist())
    assert whole == pieces == len(wanted)


def test_order_is_that_of_the_suffixes():
    rng = random.Random(1)
    text = "".join(rng.choice("ab") for _ in range(60)) * 7
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    begins = np.arange(len(text) - 99)
    order, same = suffixes.sorted_suffixes(data, begins, np.zeros(len(begins), dtype=np.int64))
    assert order.tolist() == sorted(begins.tolist(), key=lambda i: text[i : i + 100])
    assert same.tolist() == [False] + [text[a : a + 100] == text[b : b + 100] for a, b in zip(order, order[1:])]
