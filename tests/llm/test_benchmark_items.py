from __future__ import annotations

from tripline.llm import decontam, stages


def items(n, first=0):
    return [" ".join(f"w{first + i}x{j}" for j in range(20)) for i in range(n)]


def test_items_without_an_id_count(spark):
    a, b, c = items(3)
    bench = spark.createDataFrame([(1, a), (None, b)], "item_id long, text string")
    docs = spark.createDataFrame([(1, a), (2, f"before {b} after"), (3, c)], "doc_id long, text string")
    got = {r.doc_id: (r.contaminated, r.item_ids) for r in decontam.digest(decontam.contaminated(docs, bench)).collect()}
    assert got == {1: (True, [1]), 2: (True, []), 3: (False, [])}
    assert [r.doc_id for r in stages.without_benchmark(docs, bench).collect()] == [3]


def test_copies_of_an_item_are_one(spark, monkeypatch):
    monkeypatch.setattr(decontam, "PART_WORDS", 50)
    bench = spark.createDataFrame([(1, items(1)[0])] * 40, "item_id long, text string")
    parts = list(decontam.benchmark_parts(bench))
    assert [sum(len(x) for _, x in p.sizes.values()) for p in parts] == [1]
