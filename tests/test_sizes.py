"""Steps whose cost must not grow faster than their input."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from tripline import sample_files
from tripline.functions.geo import cell_of, cell_parent
from tripline.operators import resolve
from tripline.operators.matching import match_sidecars
from tripline.sinks import export
from tripline.sources import files as source


def test_an_empty_catalog_is_met_without_an_exchange(spark):
    rows = spark.createDataFrame([(1, "k")], "track_id long, dedupe_key string")
    met = rows.join(resolve.load_previous(sample_files.empty_catalog(spark)), resolve.KEY, "left")
    assert [tuple(r) for r in met.collect()] == [(1, "k", None)]
    assert "Join" not in met._jdf.queryExecution().optimizedPlan().toString()


def test_pieces_of_a_task_are_bounded(spark):
    for key in ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.files.maxPartitionBytes"):
        assert spark.conf.get(key) == "16m"


def test_files_to_match_among_all_files(spark):
    """A cut name that starts two files of the folder names neither, though one alone is asked for."""
    ddl = "track_id long, dir string, name string, path string, kind string"
    names = ["long_name_of_one.jpg", "long_name_of_two.jpg", "other_name_there.jpg"]
    every = spark.createDataFrame([(1, "d", n, "d/" + n, "photo") for n in names], ddl)
    docs = spark.createDataFrame([(1, "d", n, "d/" + n, None) for n in ("long_name_of_.json", "other_name_th.json")], ddl.replace("kind", "raw_title"))
    some = every.where("name != 'long_name_of_two.jpg'")
    got = {r.path: r.sidecar for r in match_sidecars(some, docs, every).collect()}
    assert got == {"d/long_name_of_one.jpg": None, "d/other_name_there.jpg": "d/other_name_th.json"}
    whole = {r.path: r.sidecar for r in match_sidecars(every, docs).collect()}
    assert got == {p: v for p, v in whole.items() if p in got}


def test_a_small_cover_goes_to_the_items(spark, monkeypatch):
    points = [(f"p{i}", 1.0 + i / 7, 2.0 + i / 3) for i in range(60)] + [("none", None, None)]
    rows = spark.createDataFrame(points, "path string, latitude double, longitude double")
    at = cell_of(F.col("latitude"), F.col("longitude"))
    located = rows.where("latitude is not null")
    coarse = located.where("path like '%0' or path like '%5'").select(cell_parent(at, 5).alias("cell"), F.lit("UTC").alias("tz"))
    fine = located.where("path like '%1'").select(cell_parent(at, 12).alias("cell"), F.lit("Asia/Tokyo").alias("tz"))
    zones = coarse.unionByName(fine).unionByName(fine.withColumn("tz", F.lit("Zulu"))).unionByName(fine.limit(1).withColumn("cell", F.lit(None).cast("long")))
    zones = spark.createDataFrame(zones.collect(), zones.schema)
    sent = resolve.assign_timezone(rows, zones)
    assert "Exchange hashpartitioning" not in sent.select("path", "zone")._jdf.queryExecution().sparkPlan().toString()
    key = lambda df: sorted(((r.path, r.zone) for r in df.collect()), key=repr)
    got = key(sent)
    monkeypatch.setattr(resolve, "SENT_CELLS", 0)
    met = resolve.assign_timezone(rows, zones)
    assert got == key(met) and {z for _, z in got} == {None, "UTC", "Asia/Tokyo"} and len(got) == 61
    assert sent.columns == met.columns


def test_many_saved_documents_lie_in_few_folders(spark, tmp_path):
    path = str(tmp_path / "documents")
    ids = spark.range(300).select(F.col("id").alias("track_id"), F.lit(None).cast("long").alias("line_us"), F.lit(None).cast("string").alias("line_id"))
    head = F.concat(F.lit('{"id":"'), "track_id", F.lit('","title":"T","prompts":[],"generated_at":"g","stays":['))
    lines = ids.withColumns({"section": F.lit(0), "line": head}).unionByName(ids.withColumns({"section": F.lit(4), "line": F.lit("]}")}))
    export.write_timelines(lines, path, "track_id")
    assert len([d for d in os.listdir(path) if "=" in d]) <= export.CONTAINER_BUCKETS
    docs = source.read_document_lines(spark, path, "track_id").collect()
    assert sorted((r.id, r.title, r.stay_count) for r in docs) == sorted((str(i), "T", 0) for i in range(300))
