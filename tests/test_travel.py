"""The whole chain on two tracks with equal paths and equal keys."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tripline.functions.geo import PLACE_LEVEL, cell_of, cell_parent
from tripline.operators import resolve
from tripline.plans.travel import ITEM, rebuild_documents, travel
from tripline.sinks.export import gpx_lines

DAY = 86400


def _inputs(spark):
    places = {"SG": (1.3, 103.8), "JP": (35.68, 139.69)}
    listing, docs = [], []
    for t in (1, 2):
        for i in range(12):
            name, (lat, lng) = f"IMG_{i}.jpg", places["SG" if i < 6 else "JP"]
            listing += [(t, f"P/{n}", "P", n, 10) for n in (name, f"{name}.json")]
            # One photo link is shared by both tracks.
            url = "shared" if i == 0 else f"u{t}-{i}"
            doc = {"title": name, "url": url, "photoTakenTime": {"timestamp": str(1_600_000_000 + i * DAY)}, "geoData": {"latitude": lat + t / 1000, "longitude": lng}}
            docs.append((t, f"P/{name}.json", "P", f"{name}.json", json.dumps(doc)))
    listing = spark.createDataFrame(listing, "track_id long, path string, dir string, name string, size long")
    docs = spark.createDataFrame(docs, "track_id long, path string, dir string, name string, json string")
    exif = spark.createDataFrame([], "track_id long, path string, datetime_text string, lat double, lng double, perceptual_hash string, meta map<string,string>")
    zones = spark.createDataFrame([], "cell long, tz string")
    place = spark.createDataFrame([], "cell_id long, center_lat double, center_lng double, city string, admin1 string, country_code string, formatted_address string, geocode_raw string, geocoded_at timestamp")
    spots = spark.createDataFrame([(c, lat + t / 1000, lng) for c, (lat, lng) in places.items() for t in (1, 2)], "cc string, lat double, lng double")
    answer = F.concat(F.lit('[{"formatted_address":"x","address_components":[{"types":["country"],"long_name":"c","short_name":"'), "cc", F.lit('"}]}]'))
    responses = spots.select(cell_parent(cell_of(F.col("lat"), F.col("lng")), PLACE_LEVEL).alias("cell_id"), answer.alias("response"))
    listing = listing.withColumn("mtime", F.lit("2021-01-01").cast("timestamp"))
    return listing, docs, exif, zones, spark.createDataFrame([], resolve.CATALOG_DDL), place, responses.unionByName(responses)


def test_files_to_stays_and_documents(spark):
    done = travel(*_inputs(spark))
    media = done.geocoded.media
    assert media.count() == media.select(*ITEM).distinct().count() == 24
    stays = done.stays.collect()
    assert sorted((r.track_id, r.label) for r in stays) == [(1, "JP"), (1, "SG"), (2, "JP"), (2, "SG")]
    tracks = gpx_lines(media.where("latitude is not null"))
    assert tracks.where("line like '%trkpt%'").count() == 24
    saved = spark.createDataFrame(
        [("a", "A", ["p"], 1, ("2020-09-01", "2020-10-01", "country", None, None, None)), ("b", "B", None, 2, (None, None, None, None, None, None)), ("c", "C", None, 2, ("2020-09-20", "2020-10-01", "country", ["jp"], None, 1.0))],
        "id string, title string, prompts array<string>, track_id long, build struct<start:string,end:string,level:string,region:array<string>,merge_km:double,min_hours:double>",
    )
    kept, stays, points = rebuild_documents(saved, media, done.geocoded.place)
    assert sorted((r.id, r.title, r.prompts) for r in kept.collect()) == [("a", "A", ["p"]), ("c", "C", None)]
    assert sorted((r.timeline_id, r.label) for r in stays.collect()) == [("a", "JP"), ("a", "SG"), ("c", "JP")]
    assert {r.timeline_id: r["count"] for r in points.groupBy("timeline_id").count().collect()} == {"a": 12, "c": 5}


def test_unchanged_files_leave_before_exif_and_zones(spark):
    """A second run over a catalog: only the files whose sidecar changed meet the EXIF table."""
    from tripline.operators.matching import match_sidecars
    from tripline.plans.ingest import media_side, resolve_files
    from tripline.session import materialize
    from tripline.sources.sidecars import parse_sidecars

    listing, docs, exif, zones, none, *_ = _inputs(spark)
    files, _ = media_side(listing)

    def rows(documents, previous, force=False):
        sidecars = materialize(parse_sidecars(documents), "sidecars")
        return resolve_files(files, match_sidecars(files, sidecars), sidecars, exif, zones, previous, force=force)

    at = F.lit("2021-02-02").cast("timestamp")
    first = resolve.resolve_duplicates(resolve.catalog_rows(rows(docs, none)))
    catalog = materialize(first.withColumns({"created_at": at, "updated_at": at}), "catalog")
    changed = docs.withColumn("json", F.when(F.col("path") == "P/IMG_3.jpg.json", F.replace("json", F.lit('"title"'), F.lit('"description": "new", "title"'))).otherwise(F.col("json")))
    again = rows(changed, catalog)
    assert {(r.action, r.n) for r in again.groupBy("action").agg(F.count("*").alias("n")).collect()} == {("skipped", 22), ("refreshed", 2)}
    # What went on carries an identity; what was settled has none, nor the document itself.
    assert again.where("dedupe_key is not null").count() == 2
    assert again.where("action = 'skipped' and (sc.json is not null or ex is not null)").count() == 0
    plan = again._jdf.queryExecution().optimizedPlan().toString()
    assert "isnull(settled" in plan and plan.index("LeftSemi") > 0
    assert {r.action for r in rows(changed, catalog, force=True).select("action").distinct().collect()} == {"refreshed", "updated"}
    # A catalog row without a time is not whole, so its file is read again.
    halved = catalog.withColumn("taken_at", F.when(F.col("track_id") == 2, F.col("taken_at")))
    assert rows(docs, halved).where("action = 'skipped'").count() == 12


def test_windows_meet_no_item_outside(spark):
    from tripline.plans.timeline import join_windows

    days = spark.range(0, 800).select((F.col("id") % 2).alias("track_id"), (F.lit("2020-01-01").cast("timestamp") + F.make_interval(days=F.col("id").cast("int"))).alias("taken_at"))
    rows = days.withColumn("_month", F.trunc("taken_at", "month"))
    given = [(0, "2020-01-31", "2020-02-01"), (0, "2020-02-10", "2021-03-02"), (1, "2019-01-01", "2030-01-01"), (1, "2020-05-05", "2020-05-05"), (5, "2020-01-01", "2021-01-01")]
    windows = spark.createDataFrame(given, "track_id long, s string, e string").select("track_id", F.col("s").cast("timestamp").alias("_start"), F.col("e").cast("timestamp").alias("_end"), F.monotonically_increasing_id().alias("w"))
    got = join_windows(rows, windows)
    want = days.join(windows, "track_id").where("taken_at >= _start and taken_at < _end")
    key = lambda df: sorted((r.track_id, r.taken_at, r.w) for r in df.collect())
    assert key(got) == key(want) and got.count() == got.distinct().count()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
