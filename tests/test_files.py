"""Sidecar matching, parsing and ingest over hand-made trees, and document round trips."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tripline.functions.times import month_bounds
from tripline.operators import resolve
from tripline.plans.ingest import ingest, media_side
from tripline.operators.matching import match_sidecars
from tripline.sources import files
from tripline.sources.sidecars import parse_sidecars

LONG = "this_is_a_really_long_photo_filename_2008_summer_trip.jpg"
# media files; sidecars {name: title}; media -> sidecar
CASES = [
    (["IMG_1234.JPG"], {"IMG_1234.JPG.json": "IMG_1234.JPG"}, {"IMG_1234.JPG": "IMG_1234.JPG.json"}),
    (["IMG_2.JPG"], {"IMG_2.JPG.supplemental-metadata.json": None},
     {"IMG_2.JPG": "IMG_2.JPG.supplemental-metadata.json"}),
    (["photo.jpg"], {"photo.JPG.json": None}, {"photo.jpg": "photo.JPG.json"}),
    (["IMG_9.JPG", "IMG_9-edited.JPG"], {"IMG_9.JPG.json": None},
     {"IMG_9.JPG": "IMG_9.JPG.json", "IMG_9-edited.JPG": "IMG_9.JPG.json"}),
    (["DSC-bearbeitet.JPG"], {"DSC.JPG.json": "DSC.JPG"}, {"DSC-bearbeitet.JPG": "DSC.JPG.json"}),
    (["写真-編集済み.jpg"], {"写真.jpg.json": None}, {"写真-編集済み.jpg": "写真.jpg.json"}),
    (["foo.jpg", "foo(1).jpg"], {"foo.jpg.json": "foo.jpg", "foo.jpg(1).json": "foo.jpg"},
     {"foo.jpg": "foo.jpg.json", "foo(1).jpg": "foo.jpg(1).json"}),
    (["bar(2).jpg"], {"bar.jpg.supplemental-metadata(2).json": "bar.jpg"},
     {"bar(2).jpg": "bar.jpg.supplemental-metadata(2).json"}),
    ([LONG], {LONG[:43] + ".json": LONG}, {LONG: LONG[:43] + ".json"}),
    (["vacation_beach_sunset_panorama_wide_2011_0042.jpg"],
     {"vacation_beach_sunset_panorama_wide_2011.json": None},
     {"vacation_beach_sunset_panorama_wide_2011_0042.jpg":
      "vacation_beach_sunset_panorama_wide_2011.json"}),
    (["orphan.JPG"], {}, {"orphan.JPG": None}),
    (["trip_2009_part_one_morning.jpg", "trip_2009_part_two_evening.jpg"],
     {"trip_2009_part.json": None},
     {"trip_2009_part_one_morning.jpg": None, "trip_2009_part_two_evening.jpg": None}),
    # Two sidecars of one cut name in different case are refused.
    (["panorama_of_the_bay_0042.jpg"], {"panorama_of_the_b.json": None, "PANORAMA_of_the_b.json": None},
     {"panorama_of_the_bay_0042.jpg": None}),
]


def test_matching_cases(spark):
    listing, docs, want = [], [], {}
    for i, (media, sidecars, expected) in enumerate(CASES):
        d = f"d{i}"
        listing += [(1, f"{d}/{n}", d, n) for n in [*media, *sidecars]]
        docs += [
            (1, f"{d}/{n}", d, n, json.dumps({} if t is None else {"title": t}))
            for n, t in sidecars.items()
        ]
        want |= {f"{d}/{m}": (f"{d}/{s}" if s else None) for m, s in expected.items()}
    files_, _ = media_side(spark.createDataFrame(listing, "track_id long, path string, dir string, name string"))
    parsed = parse_sidecars(
        spark.createDataFrame(docs, "track_id long, path string, dir string, name string, json string")
    )
    got = {r.path: r.sidecar for r in match_sidecars(files_, parsed).collect()}
    assert got == want


@pytest.mark.parametrize(
    ("doc", "valid", "epoch", "coords"),
    [
        ({"photoTakenTime": {"timestamp": "5"}, "geoData": {"latitude": 1.5, "longitude": 2}}, True, 5, (1.5, 2.0)),
        ({"creationTime": {"timestamp": 7}, "photoTakenTime": {"timestamp": "x"}}, True, 7, None),
        ({"geoData": {"latitude": 0.0, "longitude": 0.0}, "geoDataExif": {"latitude": "3.5"}}, True, None, (3.5, 0.0)),
        ({"title": 5}, False, None, None),
        ({"title": None, "url": None, "geoData": None, "extra": [1]}, True, None, None),
        ({"geoData": {"latitude": None}}, False, None, None),
        ({"geoData": {"latitude": "abc"}}, False, None, None),
        ({"geoData": [1]}, False, None, None),
        ({"photoTakenTime": {"timestamp": 1.5}}, False, None, None),
        ([1, 2], False, None, None),
        ("text", False, None, None),
    ],
)
def test_sidecar_fields(spark, doc, valid, epoch, coords):
    row = parse_sidecars(spark.createDataFrame([(json.dumps(doc),)], "json string")).first()
    assert (row.valid, row.epoch) == (valid, epoch)
    assert (None if row.lat is None else (row.lat, row.lng)) == coords


def test_broken_sidecar(spark):
    row = parse_sidecars(spark.createDataFrame([("{oops",)], "json string")).first()
    assert row.valid is False and row.fingerprint is None and row.raw_title is None


def _sidecar(url, epoch, lat, lng):
    return {
        "title": "t", "url": url, "photoTakenTime": {"timestamp": str(epoch)},
        "geoData": {"latitude": lat, "longitude": lng},
    }


@pytest.fixture
def tree(tmp_path):
    d = tmp_path / "export" / "Photos from 2019"
    d.mkdir(parents=True)
    for n in ("IMG_1.JPG", "IMG_2.JPG", "IMG_3.JPG"):
        (d / n).write_bytes(b"\xff\xd8\xff")
    (d / "IMG_1.JPG.json").write_text(json.dumps(_sidecar("AAA", 1564920000, 35.6895, 139.6917)))
    (d / "IMG_2.JPG.supplemental-metadata.json").write_text(
        json.dumps(_sidecar("BBB", 1564930000, 0.0, 0.0))
    )
    (d / "broken.JPG.json").write_text("{")
    return str(tmp_path / "export")


def _run(spark, root, catalog, **kw):
    exif = spark.createDataFrame(
        [], "track_id long, path string, datetime_text string, lat double, lng double, perceptual_hash string, "
        "meta map<string,string>",
    )
    zones = spark.createDataFrame([], "cell long, tz string")
    listing = files.list_files(spark, root).withColumn("track_id", F.lit(1).cast("long"))
    docs = files.read_sidecar_documents(spark, root).withColumn("track_id", F.lit(1).cast("long"))
    return ingest(listing, docs, exif, zones, catalog, **kw)


def test_ingest_tree(spark, tree):
    none = spark.createDataFrame([], resolve.CATALOG_DDL)
    first = _run(spark, tree, none)
    stats = first.stats.first()
    assert (stats.total, stats.created, stats.with_sidecar, stats.with_location) == (3, 3, 2, 1)
    rows = {r.file_name: r for r in first.catalog.collect()}
    assert rows["IMG_1.JPG"].url == "AAA" and not rows["IMG_1.JPG"].needs_review
    assert rows["IMG_2.JPG"].needs_review and rows["IMG_2.JPG"].taken_at_source == "sidecar"
    assert rows["IMG_3.JPG"].taken_at_source == "file_mtime"

    catalog = spark.createDataFrame(first.catalog.collect(), first.catalog.schema)
    assert _run(spark, tree, catalog).stats.first().skipped == 3
    assert _run(spark, tree, catalog, force=True).stats.first().updated == 3
    august = _run(spark, tree, none, month_filter="2019-08").stats.first()
    assert (august.created, august.filtered) == (2, 1)
    assert _run(spark, tree, none, month_filter="2022-06").stats.first().filtered == 3
    assert _run(spark, tree, none, month_filter="2020-01,2019-12").stats.first().filtered == 3


def test_month_bounds():
    assert month_bounds("2019-08") == ("2019-08", "2019-08")
    assert month_bounds("2020-01, 2019-02") == ("2019-02", "2020-01")
    with pytest.raises(ValueError):
        month_bounds("2019")


def test_source_uri():
    assert files.source_uri("s3://b/p") == "s3a://b/p"
    assert files.source_uri("gs://b/p") == "gs://b/p"
    assert files.source_uri("/x/y") == "/x/y"


def test_saved_documents(spark, tmp_path):
    build = {"start": "2019-01-01", "end": "2020-01-01", "level": "city", "merge_km": 20}
    docs = {
        "a.json": {"id": "a", "title": "A", "generated_at": "2020", "stays": [{}, {}], "build": build},
        "b.json": {"generated_at": "2021"},
    }
    for name, doc in docs.items():
        (tmp_path / name).write_text(json.dumps(doc, indent=2))
    (tmp_path / "c.json").write_text("{nope")
    found = files.read_documents(spark, str(tmp_path))
    listed = [tuple(r) for r in files.scan_timelines(found).collect()]
    assert listed == [("b", "b", "2021", 0), ("a", "A", "2020", 2)]
    knobs = files.load_knobs(found).collect()
    assert [(k.id, k.level, k.merge_km, k.min_hours) for k in knobs] == [("a", "city", 20.0, None)]


def test_equal_trees_of_two_tracks_do_not_mix(spark):
    """Paths are relative to each track's root, so both tracks hold P/IMG_1.jpg."""
    from pyspark.sql import functions as F

    from tripline.operators import resolve
    from tripline.plans.ingest import ingest

    names = ["IMG_1.jpg", "IMG_1.jpg.json", "holiday_at_the_long_beach.jpg", "holiday_at_the_long.json"]
    listing = spark.createDataFrame(
        [(t, f"P/{n}", "P", n, 10) for t in (1, 2) for n in names],
        "track_id long, path string, dir string, name string, size long",
    ).withColumn("mtime", F.lit("2021-05-06").cast("timestamp"))
    docs = spark.createDataFrame(
        [
            (t, f"P/{n}", "P", n, json.dumps({"title": n[:-5], "url": f"u{t}{n}", "photoTakenTime": {"timestamp": "1600000000"},
              "geoData": {"latitude": 10.0 * t, "longitude": 20.0}}))
            for t in (1, 2) for n in names if n.endswith("json")
        ],
        "track_id long, path string, dir string, name string, json string",
    )
    exif = spark.createDataFrame(
        [(t, "P/IMG_1.jpg", None, None, None, h, None) for t in (1, 2) for h in ("h", "g")],
        "track_id long, path string, datetime_text string, lat double, lng double, perceptual_hash string, meta map<string,string>",
    )
    zones = spark.createDataFrame([(1, "Asia/Tokyo"), (1, "UTC")], "cell long, tz string")
    none = spark.createDataFrame([], resolve.CATALOG_DDL)
    got = sorted((r.track_id, r.file_name, r.url, r.latitude) for r in ingest(listing, docs, exif, zones, none).catalog.collect())
    assert got == sorted((t, n, f"u{t}{s}", 10.0 * t) for t in (1, 2) for n, s in ((names[0], names[1]), (names[2], names[3])))


def test_a_border_cell_has_one_zone(spark):
    from tripline.functions.geo import cell_of, cell_parent
    from tripline.operators.resolve import TZ_LEVEL, assign_timezone
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("a", 1.0, 2.0), ("b", None, None)], "path string, latitude double, longitude double")
    cell = rows.select(cell_parent(cell_of(F.col("latitude"), F.col("longitude")), TZ_LEVEL).alias("cell")).where("cell is not null")
    zones = cell.crossJoin(spark.createDataFrame([("UTC",), ("Asia/Tokyo",)], "tz string"))
    assert sorted((r.path, r.zone) for r in assign_timezone(rows, zones).collect()) == [("a", "Asia/Tokyo"), ("b", None)]


@pytest.mark.parametrize(
    ("value", "text"),
    [(0.0005, "0.0005"), (-0.000123, "-0.000123"), (1e-7, "0.0000001"), (51.5, "51.5"), (-0.0, "-0.0"), (12345678.25, "12345678.25"), (9.5e-5, "0.000095")],
)
def test_decimal_text(spark, value, text):
    from pyspark.sql import functions as F

    from tripline.sinks.export import decimal_text

    assert spark.range(1).select(decimal_text(F.lit(value))).first()[0] == text


def test_strip_takes_every_kind_of_blank(spark):
    from pyspark.sql import functions as F

    from tripline.functions.text import strip

    assert spark.range(1).select(strip(F.lit("　  Tokyo  "))).first()[0] == "Tokyo"


def test_listing_loses_nothing(spark, tmp_path):
    """A root with a blank, names that begin with ``_`` or ``.``, and hidden folders."""
    root = tmp_path / "Take out" / "Google Photos"
    want = {}
    for i, p in enumerate(["a b/IMG 1.jpg", "a b/_DSC0001.JPG", "a b/.x.jpg", "_album/deep/IMG_2.jpg", "_album/_n.jpg", "top+%41.jpg", "c/d/_e/f.jpg"]):
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_bytes(b"x" * (i + 1))
        want[p] = (p.rpartition("/")[0], p.rpartition("/")[2], i + 1)
    (root / "a b/IMG 1.jpg.json").write_text("{}")
    got = {r.path: (r.dir, r.name, r.size) for r in files.list_files(spark, str(root), "*.[jJ][pP][gG]").collect()}
    assert got == want
    assert [(r.path, r.dir) for r in files.read_sidecar_documents(spark, str(root)).collect()] == [("a b/IMG 1.jpg.json", "a b")]
    table = spark.createDataFrame([(f"{root}/{p}", n) for p, (_, _, n) in want.items()], "path string, size long").selectExpr("*", "timestamp'2020-01-01' as mtime")
    assert {r.path: (r.dir, r.name, r.size) for r in files.list_inventory(table, str(root)).collect()} == want


def test_packed_sidecars_keep_their_paths(spark, tmp_path):
    docs = spark.createDataFrame([("P/_DSC1.JPG.json", '{"title":"a\\nb"}'), ("Q r/x.json", "{bad")], "path string, json string")
    files.pack_sidecars(docs).write.text(str(tmp_path / "packs"))
    got = files.read_sidecar_documents(spark, str(tmp_path / "packs"), packed=True).collect()
    assert sorted((r.path, r.dir, r.name, r.json) for r in got) == [("P/_DSC1.JPG.json", "P", "_DSC1.JPG.json", '{"title":"a\\nb"}'), ("Q r/x.json", "Q r", "x.json", "{bad")]
