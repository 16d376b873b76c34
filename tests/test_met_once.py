"""Files meet their sidecars once for a job and the catalog before it, in steps the JVM compiles."""

import glob

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tripline import sample_files
from tripline.operators import matching, resolve
from tripline.operators.matching import match_sidecars
from tripline.queries import ingest
from tripline.session import materialize
from tripline.sinks import buckets
from tripline.sources.sidecars import parse_sidecars

NAMES = "track_id long, dir string, name string, path string"


@pytest.fixture
def tables(spark, tmp_path):
    """Thirty events of two users from the first to the last day of January."""
    rows = spark.range(30).select(
        F.col("id").alias("event_id"),
        (F.lit("2024-01-01").cast("timestamp") + F.make_interval(hours=F.col("id") * 24)).alias("ts"),
        (F.col("id") % 2).alias("user_id"),
        F.lit("view").alias("event_type"),
        (F.col("id") / 4.0).alias("value"),
        F.concat(F.lit('{"k": '), F.col("id"), F.lit("}")).alias("props"),
    )
    rows.write.parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path)


def test_months_match_all_files_once_with_the_catalog_before_them(spark, tables, monkeypatch):
    calls = []

    def counted(*frames):
        calls.append(1)
        return match_sidecars(*frames)

    monkeypatch.setattr(ingest, "match_sidecars", counted)
    monkeypatch.setattr(sample_files, "match_sidecars", counted)
    rows = [tuple(r) for r in ingest.ingest_classify_months(spark, tables).collect()]
    assert len(calls) == 1
    # Files of folders of other years are in no result, and the rows are those of a run that finds the catalog.
    assert rows and not [r for r in rows if any(f"Photos from {y}" in r[0] for y in (2020, 2021, 2022))]
    assert sorted(rows) == sorted(tuple(r) for r in ingest.ingest_classify_months(spark, tables).collect())


def test_plain_stages_hold_no_dictionaries(spark):
    stage = materialize(spark.range(9).select(F.concat(F.lit("IMG_"), "id").alias("name"), F.timestamp_seconds("id").alias("at")), "names")
    assert spark.conf.get("spark.sql.parquet.outputTimestampType") == "INT96"
    meta = [pq.ParquetFile(f).metadata for f in glob.glob(stage.stage_path.removeprefix("file:") + "/*.parquet")]
    columns = [m.row_group(i).column(c) for m in meta for i in range(m.num_row_groups) for c in range(2)]
    assert columns and not any(c.has_dictionary_page for c in columns)
    assert {c.physical_type for c in columns} == {"BYTE_ARRAY", "INT64"}
    assert stage.where("at = timestamp_seconds(8)").first().name == "IMG_8"


def test_large_methods_are_not_interpreted(spark):
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000
    docs = spark.createDataFrame([(1, "d", "a.json", "d/a.json", "{}")], NAMES + ", json string")
    parsed = parse_sidecars(docs)
    assert parsed.count() == 1
    codes = parsed._jdf.queryExecution().debug().codegenToSeq()
    sizes = [int(codes.apply(i)._3().maxMethodCodeSize()) for i in range(codes.length())]
    assert sizes and 0 < max(sizes) <= 8000


def test_any_column_of_a_parsed_document_can_be_taken_alone(spark):
    text = '{"title":"t","url":"u","description":"d","photoTakenTime":{"timestamp":"5"},"geoDataExif":{"latitude":1.5,"longitude":2.5}}'
    docs = spark.createDataFrame([(1, "d", "a.json", "d/a.json", text)], NAMES + ", json string")
    whole = parse_sidecars(docs).first().asDict()
    assert (whole["valid"], whole["title"], whole["epoch"], whole["lat"], whole["lng"]) == (True, "t", 5, 1.5, 2.5)
    for some in ([c] for c in whole):
        assert parse_sidecars(docs).select(*some).first().asDict() == {c: whole[c] for c in some}
    some = ["path", "valid", "lat", "lng"]
    assert parse_sidecars(docs).where("valid").select(*some).first().asDict() == {c: whole[c] for c in some}


def test_files_listed_twice_stay_two_rows(spark):
    """Rows are told apart by a number while tiers are matched; equal files get equal sidecars, in every tier."""
    names = ["IMG_1.jpg", "IMG_1.jpg", "b.jpg", "b.jpg", "holiday_beach_2.jpg", "none.jpg", "none.jpg"]
    files = spark.createDataFrame([(1, "d", n, "d/" + n, "photo") for n in names] + [(None, "d", "b.jpg", "d/b.jpg", "photo")], NAMES + ", kind string")
    docs = spark.createDataFrame(
        [(1, "d", n, "d/" + n, j) for n, j in (("IMG_1.jpg.json", "{}"), ("x.json", '{"title":"b.jpg"}'), ("holiday_be.json", "{}"))],
        NAMES + ", json string",
    )
    got = sorted(map(str, ((r.track_id, r.path, r.sidecar, r.tier) for r in match_sidecars(files, parse_sidecars(docs)).collect())))
    assert got == sorted(map(str, [
        *[(1, "d/IMG_1.jpg", "d/IMG_1.jpg.json", "exact")] * 2, *[(1, "d/b.jpg", "d/x.json", "title")] * 2,
        (1, "d/holiday_beach_2.jpg", "d/holiday_be.json", "prefix"), *[(1, "d/none.jpg", None, None)] * 2, (None, "d/b.jpg", None, None),
    ]))


def test_a_cut_name_is_joined_to_its_files_once(spark):
    """What a cut name starts is counted where names are cut, not by running the matches again for it."""
    media = spark.createDataFrame([(1, "d", "holiday_beach_2.jpg", "d/holiday_beach_2.jpg", "photo")], NAMES + ", kind string")
    docs = spark.createDataFrame([(1, "d", "holiday_be.json", "d/holiday_be.json", None)], NAMES + ", raw_title string")
    hits = matching.match_prefix(media, docs, media)
    assert [r.sidecar for r in hits.collect()] == ["d/holiday_be.json"]
    assert hits._jdf.queryExecution().optimizedPlan().toString().count("Join") <= 4


def test_image_times_are_read_once_per_row(spark):
    rows = spark.createDataFrame(
        [("p", None, "2024:01:02 03:04:05", None, "Asia/Tokyo")], "path string, epoch long, text string, mtime timestamp, zone string"
    ).select(
        "mtime", "zone", F.struct("epoch").alias("sc"), F.struct(F.col("text").alias("datetime_text")).alias("ex"),
        F.struct(F.lit(None).cast("timestamp").alias("taken_at"), F.lit(None).cast("string").alias("taken_at_source"), F.lit(None).cast("string").alias("timezone")).alias("prev"),
    )
    done = resolve.resolve_time(rows)
    row = done.first()
    assert (str(row.taken_at), row.taken_at_source, str(row.local_date)) == ("2024-01-01 18:04:05", "exif", "2024-01-02")
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" in plan


def test_a_merge_exchanges_either_side_once(spark, tmp_path, monkeypatch):
    ddl = "track_id long, dedupe_key string, url string, taken_at timestamp, created_at timestamp, updated_at timestamp"
    root, seen, write = str(tmp_path), [], buckets._write
    old = spark.createDataFrame([(k % 3, f"k{k}", "old", None, None, None) for k in range(50)], ddl)
    buckets.create_catalog(old, root, buckets=8)

    def watched(dealt, at):
        seen.append(dealt._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning"))
        return write(dealt, at)

    monkeypatch.setattr(buckets, "_write", watched)
    changes = spark.createDataFrame([(k % 3, f"k{k}", "new") for k in range(40, 60)], "track_id long, dedupe_key string, url string")
    buckets.merge_catalog(changes.withColumn("taken_at", F.lit(None).cast("timestamp")), root)
    assert seen == [2]
    got = sorted((int(r.dedupe_key[1:]), r.url) for r in buckets.read_catalog(spark, root).collect())
    assert got == [(k, "old" if k < 40 else "new") for k in range(60)]
    assert buckets.read_catalog(spark, root).columns == old.columns


def test_settled_files_are_left_out_of_a_merge_when_it_is_planned(spark, tables):
    ingest._rows(spark, tables)
    rows = ingest._rows(spark, tables, texts=True)
    assert {"skipped", "refreshed"} <= {r.action for r in rows.select("action").collect()}
    changes = resolve.catalog_rows(rows)
    assert "Union" not in changes._jdf.queryExecution().optimizedPlan().toString()
    assert changes.count() == rows.where(F.col("action").isin(*resolve.WRITTEN)).count() > 0
