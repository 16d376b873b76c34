from __future__ import annotations

from collections import Counter, defaultdict

import brute
from pyspark.sql import functions as F
from test_similar import alike, grams

import corpus_pipeline
from tripline.llm import decontam, stages, toxicity

SF = "/root/testdata/sf0.001"


def key(r):
    return r.doc_id, r.text


def plain_components(rows):
    """Groups of rows by the similarity of their five-word sets, all pairs compared."""
    sets = {key(r): grams(r.text) for r in rows}
    keys = list(sets)
    label = brute.components(list(range(len(keys))), lambda i, j: alike(sets[keys[i]], sets[keys[j]]))
    groups = defaultdict(set)
    for i, g in label.items():
        groups[g].add(keys[i])
    return groups


def test_whole_run_stage_by_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    before = docs.collect()
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        df = stage(spark, docs, SF)
        if name != "sharding":
            assert df.schema == docs.schema
        out[name] = rows = df.collect()
        if name == "toxicity":
            bad = {r.doc_id for r in toxicity.score(docs, labels).collect() if r.score >= stages.REJECT}
            assert Counter(map(key, rows)) == Counter(key(r) for r in before if r.doc_id not in bad) and bad
        elif name == "simhash_near_dedup":
            assert Counter(map(key, rows)) == Counter(min(g, key=lambda k: k[0]) for g in plain_components(before).values())
            assert len(rows) < len(before)
        elif name == "benchmark_decontamination":
            dirty = {r.doc_id for r in decontam.contaminated(docs, bench).collect() if r.item_ids}
            assert Counter(map(key, rows)) == Counter(key(r) for r in before if r.doc_id not in dirty)
        elif name == "source_mixing":
            n = Counter(map(key, rows))
            assert set(n) <= set(map(key, before)) and max(n.values()) <= 2
            assert 1.3 < sum(len(brute.words(r.text)) for r in rows) / sum(len(brute.words(r.text)) for r in before) < 1.7
        else:
            assert Counter(map(key, rows)) == Counter(map(key, before))
            per = Counter(r.shard for r in rows)
            assert max(per.values()) - min(per.values()) <= 1
        docs = spark.createDataFrame(rows, df.schema)
        before = rows
    final = corpus_pipeline.run(spark, SF).collect()
    assert Counter((r.doc_id, r.shard, r.slot) for r in final) == Counter((r.doc_id, r.shard, r.slot) for r in out["sharding"])


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(20000))
    rows = [(1, None, "a"), (1, None, "a"), (2, "", None), (None, "a b c d", "b"), (None, "a b c d", "b"), (3, "a b c d", "b"), (4, long, "b"), (5, long + " x", None), (6, "one two three four five six", "a"), (6, "one two three four five six", "a"), (6, "other words here now", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("_key", F.lit(1)).withColumn("size", F.lit("x"))
    docs = docs.withColumnRenamed("_key", "component")
    got = Counter(map(key, stages.one_per_component(docs).collect()))
    groups = plain_components(docs.collect())
    assert got == Counter(min(g, key=lambda k: (k[0] is None, k[0])) for g in groups.values())
    bench = spark.createDataFrame([(1, "two three four five six")], "item_id long, text string")
    assert Counter(map(key, stages.without_benchmark(docs, bench).collect())) == Counter((d, t) for d, t, _ in rows if d != 6 or t.startswith("other"))
    taken = Counter(map(key, stages.mixed(docs).collect()))
    assert set(taken) <= {(d, t) for d, t, _ in rows}
    assert all(n <= 2 * sum((d, t) == k for d, t, _ in rows) for k, n in taken.items())
    assert stages.sharded(docs).count() == len(rows)
    none = docs.limit(0)
    for stage in (stages.one_per_component, stages.mixed, stages.sharded, lambda d: stages.without_benchmark(d, bench)):
        assert stage(none).collect() == []
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert stages.without_toxic(none, labels).collect() == []


def test_registered(spark):
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14))
