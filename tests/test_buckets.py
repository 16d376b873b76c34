"""Merges rewrite the buckets they touch, whatever happens around them."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tripline.sinks import buckets as b
from tripline.sinks.catalog import current_version

DDL = "track_id long, dedupe_key string, url string, taken_at timestamp, created_at timestamp, updated_at timestamp"


def rows(spark, keys, url="old"):
    df = spark.createDataFrame([(k % 3, f"k{k}", url) for k in keys], "track_id long, dedupe_key string, url string")
    day = F.lit("2020-01-01").cast("timestamp")
    return df.select("*", day.alias("taken_at"), day.alias("created_at"), day.alias("updated_at"))


def at(day):
    return F.lit(day).cast("timestamp")


def found(spark, root, version=None):
    return sorted((r.dedupe_key, r.url, str(r.created_at.date()), str(r.updated_at.date())) for r in b.read_catalog(spark, root, version).collect())


def files(root):
    return {p.relative_to(root) for p in root.rglob("*.parquet")}


def test_a_merge_writes_touched_buckets_only(spark, tmp_path):
    root = str(tmp_path)
    b.create_catalog(rows(spark, range(200)), root, buckets=16)
    before, first = b.load(spark, root), files(tmp_path)
    assert len(before.files) == 16
    changes = rows(spark, [3, 500], "new").drop("created_at", "updated_at")
    touched = {r[0] for r in changes.select(b.bucket_of(before.key, 16)).collect()}
    assert b.merge_catalog(changes, root, at("2020-02-02")) == 2
    after = b.load(spark, root)
    assert len(files(tmp_path) - first) == len(touched) and first <= files(tmp_path)
    assert {k for k in range(16) if before.files.get(k) != after.files.get(k)} == touched
    want = {f"k{i}": (f"k{i}", "old", "2020-01-01", "2020-01-01") for i in range(200)}
    want["k3"] = ("k3", "new", "2020-01-01", "2020-02-02")
    want["k500"] = ("k500", "new", "2020-02-02", "2020-02-02")
    assert found(spark, root) == sorted(want.values())
    assert len(found(spark, root, 1)) == 200


def test_empty_batches_and_empty_catalogs(spark, tmp_path):
    root = str(tmp_path)
    b.create_catalog(spark.createDataFrame([], DDL), root, buckets=4)
    assert found(spark, root) == [] and b.read_catalog(spark, root).columns == spark.createDataFrame([], DDL).columns
    assert b.merge_catalog(rows(spark, []), root) == 1 and current_version(spark, root) == 1
    assert b.merge_catalog(rows(spark, [1, 2]), root, at("2020-03-03")) == 2
    assert [r[0] for r in found(spark, root)] == ["k1", "k2"]


def test_a_writer_that_dies_leaves_the_version_as_it_was(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    b.create_catalog(rows(spark, range(20)), root, buckets=4)
    before = found(spark, root)
    with monkeypatch.context() as m:
        m.setattr(b, "commit", lambda *a: (_ for _ in ()).throw(OSError("died")))
        with pytest.raises(OSError):
            b.merge_catalog(rows(spark, [1], "lost"), root)
    # Died between creating the commit file and filling it.
    (tmp_path / "commits" / f"{2:020d}.json").write_text("")
    assert current_version(spark, root) == 1 and found(spark, root) == before
    assert b.merge_catalog(rows(spark, [1], "new"), root, at("2020-02-02")) == 2
    assert ("k1", "new", "2020-01-01", "2020-02-02") in found(spark, root)


def test_two_writers(spark, tmp_path):
    """Both start from version 1. Other buckets: both get through. The same: the second fails."""
    root = str(tmp_path)
    b.create_catalog(rows(spark, range(60)), root, buckets=8)
    base = b.load(spark, root)
    by_bucket = {}
    for r in rows(spark, range(60)).select("dedupe_key", b.bucket_of(base.key, 8).alias("b")).collect():
        by_bucket.setdefault(r.b, []).append(int(r.dedupe_key[1:]))
    (one, two), (other, *_) = sorted(by_bucket.values(), key=len)[-1][:2], sorted(by_bucket.values(), key=len)[0]
    assert b.merge_catalog(rows(spark, [one], "first"), root, base=base) == 2
    assert b.merge_catalog(rows(spark, [other], "second"), root, base=base) == 3
    now = {r[0]: r[1] for r in found(spark, root)}
    assert now[f"k{one}"] == "first" and now[f"k{other}"] == "second" and len(now) == 60
    with pytest.raises(b.WriteConflict):
        b.merge_catalog(rows(spark, [two], "third"), root, base=base)
    assert {r[0]: r[1] for r in found(spark, root)} == now and current_version(spark, root) == 3
    with pytest.raises(b.WriteConflict):
        b.create_catalog(rows(spark, [1]), root)
