"""Listings landing one after the other give the catalog of one run; a repeat adds nothing."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tripline.sinks.buckets import read_catalog
from tripline.sinks.catalog import current_version, read_snapshot
from tripline.streaming.incremental import ingest_stream

LISTING = "track_id long, path string, dir string, name string, size long, mtime timestamp"


def _listing(spark, d, names):
    rows = [(1, f"{d}/{n}", d, n, 10) for n in names]
    df = spark.createDataFrame(rows, "track_id long, path string, dir string, name string, size long")
    return df.withColumn("mtime", F.lit("2020-01-01").cast("timestamp"))


def test_ingest_stream(spark, tmp_path):
    docs = spark.createDataFrame(
        [
            (1, f"{d}/a.jpg.json", d, "a.jpg.json",
             json.dumps({"title": "a.jpg", "url": f"u-{d}", "photoTakenTime": {"timestamp": "1500000000"}}))
            for d in ("x", "y")
        ],
        "track_id long, path string, dir string, name string, json string",
    )
    exif = spark.createDataFrame(
        [], "track_id long, path string, datetime_text string, lat double, lng double, perceptual_hash string, "
        "meta map<string,string>",
    )
    zones = spark.createDataFrame([], "cell long, tz string")
    landing, root = str(tmp_path / "landing"), str(tmp_path / "catalog")

    def run():
        stream = spark.readStream.schema(LISTING).parquet(landing)
        ingest_stream(stream, docs, exif, zones, root, str(tmp_path / "cp")).awaitTermination()

    _listing(spark, "x", ["a.jpg", "a.jpg.json"]).coalesce(1).write.mode("append").parquet(landing)
    run()
    assert [r.url for r in read_catalog(spark, root).collect()] == ["u-x"]
    for _ in range(2):
        _listing(spark, "y", ["a.jpg", "a.jpg.json", "b.mp4"]).coalesce(1).write.mode(
            "append"
        ).parquet(landing)
        run()
        got = sorted((r.url or "", r.kind) for r in read_catalog(spark, root).collect())
        assert got == [("", "video"), ("u-x", "photo"), ("u-y", "photo")]
    # The empty catalog, the first batch, the second; the repeated one changed nothing.
    assert current_version(spark, root) == 3


def test_snapshots_survive_crashes_and_empty_tables(spark, tmp_path):
    from tripline.sinks.catalog import write_snapshot

    root = str(tmp_path / "catalog")
    empty = spark.createDataFrame([], "track_id long, taken_at timestamp, local_date date")
    assert write_snapshot(empty, root) == 1
    assert read_snapshot(spark, root).collect() == [] and read_snapshot(spark, root).columns == empty.columns
    # A writer that died: data without a commit, and a commit file that was never filled.
    (tmp_path / "catalog" / "v2-dead").mkdir()
    (tmp_path / "catalog" / "commits" / f"{2:020d}.json").write_text("")
    assert current_version(spark, root) == 1
    one = spark.sql("select 1L as track_id, timestamp'2020-01-01' as taken_at, date'2020-01-01' as local_date")
    assert write_snapshot(one, root) == 2
    assert read_snapshot(spark, root).count() == 1 and read_snapshot(spark, root, 1).count() == 0
