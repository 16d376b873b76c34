"""Documents are parsed once, however many steps of an ingest read them."""

import pytest
from pyspark.sql import functions as F

from tripline import sample_files
from tripline.operators import matching
from tripline.operators.matching import match_sidecars
from tripline.queries import ingest
from tripline.session import tune
from tripline.sources.files import list_files
from tripline.sources.sidecars import parse_sidecars


@pytest.fixture
def tables(spark, tmp_path):
    """Forty events of two users from the first to the last day of January."""
    rows = spark.range(40).select(
        F.col("id").alias("event_id"),
        (F.lit("2024-01-01").cast("timestamp") + F.make_interval(hours=F.col("id") * 18)).alias("ts"),
        (F.col("id") % 2).alias("user_id"),
        F.lit("view").alias("event_type"),
        (F.col("id") / 4.0).alias("value"),
        F.concat(F.lit('{"k": '), F.col("id"), F.lit("}")).alias("props"),
    )
    rows.write.parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path)


def test_matching_does_not_parse_for_each_tier(spark):
    files = spark.createDataFrame(
        [(1, "d", "IMG_1.jpg", "d/IMG_1.jpg", "photo"), (1, "d", "b.jpg", "d/b.jpg", "photo"),
         (1, "d", "holiday_beach_2.jpg", "d/holiday_beach_2.jpg", "photo")],
        "track_id long, dir string, name string, path string, kind string",
    )
    docs = spark.createDataFrame(
        [(1, "d", "IMG_1.jpg.json", "d/IMG_1.jpg.json", "{}"), (1, "d", "x.json", "d/x.json", '{"title":"b.jpg"}'),
         (1, "d", "holiday_be.json", "d/holiday_be.json", "{}")],
        "track_id long, dir string, name string, path string, json string",
    )
    matches = match_sidecars(files, parse_sidecars(docs))
    assert {(r.path, r.sidecar, r.tier) for r in matches.collect()} == {
        ("d/IMG_1.jpg", "d/IMG_1.jpg.json", "exact"),
        ("d/b.jpg", "d/x.json", "title"),
        ("d/holiday_beach_2.jpg", "d/holiday_be.json", "prefix"),
    }
    assert "parse_json" not in matches._jdf.queryExecution().optimizedPlan().toString()


def test_names_of_files_with_an_exact_hit_are_not_written_again(spark, monkeypatch):
    written = {}
    materialize = matching.materialize

    def seen(df, label="stage"):
        written[label] = materialize(df, label)
        return written[label]

    monkeypatch.setattr(matching, "materialize", seen)
    names = "track_id long, dir string, name string, path string"
    files = spark.createDataFrame([(1, "d", "a.jpg", "d/a.jpg", "photo"), (1, "d", "b.jpg", "d/b.jpg", "photo")], names + ", kind string")
    docs = spark.createDataFrame([(1, "d", "a.jpg.json", "d/a.jpg.json", "{}"), (1, "d", "x.json", "d/x.json", '{"title":"b.jpg"}')], names + ", json string")
    matches = match_sidecars(files, parse_sidecars(docs))
    assert {r.path: (r.name, r._core, r.sidecar) for r in written["exact"].collect()} == {
        "d/a.jpg": (None, None, "d/a.jpg.json"), "d/b.jpg": ("b.jpg", "b", None),
    }
    assert {(r.path, r.sidecar, r.tier) for r in matches.collect()} == {
        ("d/a.jpg", "d/a.jpg.json", "exact"), ("d/b.jpg", "d/x.json", "title"),
    }


def test_many_folders_are_listed_by_a_bounded_number_of_tasks(spark, tmp_path):
    for i in range(300):
        (tmp_path / f"f{i}").mkdir()
        (tmp_path / f"f{i}" / "a.txt").write_text("a")
    group = f"listing-{tmp_path}"
    spark.sparkContext.setJobGroup(group, "listing")
    try:
        assert list_files(tune(spark), str(tmp_path), "*.txt").count() == 300
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    stages = [i for j in tracker.getJobIdsForGroup(group) for i in tracker.getJobInfo(j).stageIds]
    assert max(tracker.getStageInfo(i).numTasks for i in stages) <= 200


@pytest.mark.parametrize("months", [None, ("2024-01", "2024-01")])
def test_an_ingest_parses_once_with_the_catalog_before_it(spark, tables, monkeypatch, months):
    calls = []

    def counted(docs):
        calls.append(1)
        return parse_sidecars(docs)

    monkeypatch.setattr(sample_files, "parse_sidecars", counted)
    rows = [tuple(r) for r in ingest._rows(spark, tables, months=months).select("path", "action").collect()]
    assert len(calls) == 1
    # The catalog is there now; the rows are those of a run that finds it.
    again = ingest._rows(spark, tables, months=months).select("path", "action")
    assert sorted(rows) == sorted(tuple(r) for r in again.collect())
    shared = sample_files.earlier_catalog(spark, tables)
    own = sample_files._earlier(spark, tables)
    columns = [c for c in own.columns if c != "exif"]
    assert own.count() > 0
    assert sorted(map(str, shared.select(columns).collect())) == sorted(map(str, own.select(columns).collect()))
