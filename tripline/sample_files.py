"""File listings, sidecars, EXIF rows and an earlier catalog, derived from ``events``.

The naming and content rules are plain SQL shared with the SQL twins; both sides read a
relation ``ev`` with x (event_id), u (user_id), sec (epoch), lat and lng.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripline import sample
from tripline.functions.geo import cell_parent
from tripline.functions.names import media_kind
from tripline.functions.steps import once
from tripline.operators.resolve import TZ_LEVEL
from tripline.plans.ingest import media_side, resolve_met, with_sidecars
from tripline.operators import resolve
from tripline.operators.matching import match_sidecars
from tripline.operators.upsert import upsert_media
from tripline.session import materialize, scratch_path, tune
from tripline.sinks.buckets import create_catalog
from tripline.sources.exif import exif_columns
from tripline.sources.sidecars import parse_sidecars

# Nine ways a media file and its sidecar are named, by x % 9.
MEDIA_NAME = """CASE x % 9
  WHEN 0 THEN 'IMG_' || x || '.jpg' WHEN 1 THEN 'IMG_' || x || '.JPG'
  WHEN 2 THEN 'IMG_' || x || '(1).jpg'
  WHEN 3 THEN 'holiday_panorama_wide_view_of_the_bay_' || x || '_original.jpg'
  WHEN 4 THEN 'vacation_' || x || '_beach_sunset_panorama_0042.jpg'
  WHEN 5 THEN 'IMG_' || x || '-edited.jpg'
  WHEN 6 THEN CASE WHEN x % 4 = 2 THEN 'CLIP_' || x || '.mov' ELSE 'ORPHAN_' || x || '.heic' END
  WHEN 7 THEN 'trip_' || x || '_part_one_morning.jpg'
  ELSE 'dup_' || x || '(3).jpg' END"""
SECOND_MEDIA_NAME = "'trip_' || x || '_part_two_evening.jpg'"
SIDECAR_NAME = """CASE x % 9
  WHEN 0 THEN 'IMG_' || x || '.jpg.json' WHEN 1 THEN 'IMG_' || x || '.jpg.supplemental-metadata.json'
  WHEN 2 THEN 'IMG_' || x || '.jpg.supplemental-metadata(1).json'
  WHEN 3 THEN 'holiday_panorama_wide_view_of_the_bay_' || x || '_ori.json'
  WHEN 4 THEN 'vacation_' || x || '_beach_sunset_pano.json'
  WHEN 5 THEN 'IMG_' || x || '.jpg.json'
  WHEN 7 THEN 'trip_' || x || '_part.json'
  ELSE 'b_' || x || '.json' END"""
SECOND_SIDECAR_NAME = "'a_' || x || '(1).json'"
DIR = """'export/' || u || CASE WHEN x % 6 = 0 THEN '/Album' ELSE '/Photos from ' || (2020 + x % 5) END"""

# The sidecar's fields, by the divisors of x.
TITLE = """CASE WHEN x % 9 IN (4, 7) THEN NULL WHEN x % 9 = 3
  THEN 'holiday_panorama_wide_view_of_the_bay_' || x || '_original.jpg'
  WHEN x % 9 = 8 THEN 'dup_' || x || '.jpg' ELSE 'IMG_' || x || '.jpg' END"""
URL = "CASE WHEN x % 19 <> 0 AND x % 53 <> 0 THEN 'https://photos.google.com/photo/P' || x END"
DESCRIPTION = "' Note ' || (x % 50)"
LAT = "CAST(CAST(lat AS DECIMAL(10, 4)) AS STRING)"
LNG = "CAST(CAST(lng AS DECIMAL(10, 4)) AS STRING)"
_PLACE = f"""CASE
  WHEN x % 41 = 0 THEN '"geoData":{{"latitude":null,"longitude":1.0}}'
  WHEN x % 43 = 0 THEN '"geoData":{{"latitude":"12.5","longitude":"100.25"}}'
  WHEN lat IS NULL OR x % 23 = 0 THEN '"geoData":{{"latitude":0.0,"longitude":0.0,"altitude":0.0}}'
  WHEN x % 11 = 0 THEN '"geoData":{{"latitude":0.0,"longitude":0.0}},"geoDataExif":{{"latitude":' || {LAT} || ',"longitude":' || {LNG} || '}}'
  ELSE '"geoData":{{"latitude":' || {LAT} || ',"longitude":' || {LNG} || ',"altitude":3.5}}' END"""
_TIME = """CASE WHEN x % 53 = 0 THEN '"favorited":true'
  WHEN x % 13 = 0 THEN '"photoTakenTime":{"timestamp":' || sec || '}'
  WHEN x % 17 = 0 THEN '"photoTakenTime":{"timestamp":"n/a"},"creationTime":{"timestamp":"' || (sec + 60) || '"}'
  ELSE '"photoTakenTime":{"timestamp":"' || sec || '","formatted":"day"}' END"""
_TITLE_PART = f"""CASE WHEN x % 37 = 0 THEN '"title":5,' WHEN {TITLE} IS NULL THEN ''
  ELSE '"title":"' || {TITLE} || '",' END"""
JSON = f"""CASE WHEN x % 31 = 0 THEN '{{bad json' WHEN x % 29 = 0 THEN '[1,2]'
  ELSE '{{' || {_TITLE_PART} || '"description":"' || {DESCRIPTION} || '",'
    || CASE WHEN {URL} IS NULL THEN '' ELSE '"url":"' || {URL} || '",' END
    || {_PLACE} || ',' || {_TIME} || ',"imageViews":"3"}}' END"""


def _sql(spark: SparkSession, text: str, **frames: DataFrame) -> DataFrame:
    for name, df in frames.items():
        df.createOrReplaceTempView(f"tripline_{name}")
        text = text.replace(f"{{{name}}}", f"tripline_{name}")
    return spark.sql(text)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample.media(spark, sf_dir).select(
        F.col("media_id").alias("x"),
        F.col("track_id").alias("u"),
        F.unix_seconds("taken_at").alias("sec"),
        F.col("latitude").alias("lat"),
        F.col("longitude").alias("lng"),
    )


# Copies of some files in a second folder of the same track.
COPY_DIR = "'export/' || u || '/Copies'"
COPIED = "x % 18 = 0"

LISTING_SQL = f"""SELECT x, u, sec, dir, name, dir || '/' || name AS path, 1000 + x % 977 AS size,
  CASE WHEN x % 97 = 0 THEN 'unreadable object' END AS error FROM (
  SELECT x, u, sec, {DIR} AS dir, {MEDIA_NAME} AS name FROM {{ev}}
  UNION ALL SELECT x, u, sec, {DIR}, {SECOND_MEDIA_NAME} FROM {{ev}} WHERE x % 9 = 7
  UNION ALL SELECT x, u, sec, {DIR}, {SIDECAR_NAME} FROM {{ev}} WHERE x % 9 <> 6
  UNION ALL SELECT x, u, sec, {DIR}, {SECOND_SIDECAR_NAME} FROM {{ev}} WHERE x % 9 = 8
  UNION ALL SELECT x, u, sec, {COPY_DIR}, {MEDIA_NAME} FROM {{ev}} WHERE {COPIED}
  UNION ALL SELECT x, u, sec, {COPY_DIR}, {SIDECAR_NAME} FROM {{ev}} WHERE {COPIED}) f"""

DOCS_SQL = f"""SELECT x, u AS track_id, dir, name, dir || '/' || name AS path, json FROM (
  SELECT x, u, {DIR} AS dir, {SIDECAR_NAME} AS name, {JSON} AS json FROM {{ev}} WHERE x % 9 <> 6
  UNION ALL SELECT x, u, {DIR}, {SECOND_SIDECAR_NAME}, {JSON} FROM {{ev}} WHERE x % 9 = 8
  UNION ALL SELECT x, u, {COPY_DIR}, {SIDECAR_NAME}, {JSON} FROM {{ev}} WHERE {COPIED}) f"""


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample.stored(spark, sf_dir, "listing", lambda: _listing(spark, sf_dir))


def _listing(spark, sf_dir):
    rows = _sql(spark, LISTING_SQL, ev=events(spark, sf_dir))
    return rows.select(
        F.col("u").alias("track_id"),
        "path", "dir", "name", "error",
        F.col("size").cast("long").alias("size"),
        F.timestamp_seconds(F.col("sec") + 86400).alias("mtime"),
    ).repartition("dir", "name")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sidecar texts: dir, name, path, json."""
    return sample.stored(
        spark, sf_dir, "documents",
        lambda: _sql(spark, DOCS_SQL, ev=events(spark, sf_dir)).drop("x").repartition("dir", "name"),
    )


def sidecars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_sidecars(documents(spark, sf_dir))


# EXIF rows of the media files.
EXIF_SQL = """SELECT u AS track_id, path,
  CASE WHEN x % 5 = 0 THEN ' ' WHEN x % 7 = 0 THEN '0000:00:00 00:00:00' WHEN x % 8 = 3 THEN NULL
    ELSE {text} END AS date_time_original,
  CASE WHEN x % 10 = 0 THEN {text} END AS date_time,
  CASE WHEN x % 3 <> 0 AND x % 2 = 0 THEN abs(elat) END AS lat_decimal,
  CASE WHEN x % 3 <> 0 AND x % 2 = 0 THEN abs(elng) END AS lng_decimal,
  CASE WHEN x % 4 = 0 THEN 'S' ELSE 'N' END AS lat_ref,
  CASE WHEN x % 8 = 0 THEN 'W' ELSE 'E' END AS lng_ref,
  x % 3 <> 0 AND x % 2 <> 0 AS has_dms,
  substr(md5(CAST(x % 5000 AS STRING)), 1, 16) AS perceptual_hash
FROM {files}"""


def exif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exif_columns(sample.stored(spark, sf_dir, "raw_exif", lambda: _exif(spark, sf_dir)))


def _exif(spark, sf_dir):
    ev = events(spark, sf_dir)
    files = _sql(spark, LISTING_SQL, ev=ev).select("x", "u", "path", "sec", "name")
    files = once(files, media_kind(F.col("name")), "kind").where("kind = 'photo'")
    text = F.date_format(F.timestamp_seconds("sec"), "yyyy:MM:dd HH:mm:ss")
    files = files.withColumns(
        {
            "t": text,
            "elat": F.lit(35.5) + (F.col("x") % 100) / F.lit(1000.0),
            "elng": F.lit(139.5) + (F.col("x") % 100) / F.lit(1000.0),
        }
    )
    raw = _sql(spark, EXIF_SQL.replace("{text}", "t"), files=files)
    dms = F.when(F.col("has_dms"), F.array(*map(F.lit, (35.0, 30.0, 36.0))))
    return raw.repartition("path").withColumns(
        {
            "lat_dms": dms,
            "lng_dms": F.when(F.col("has_dms"), F.array(*map(F.lit, (139.0, 45.0, 18.0)))),
            "meta": F.create_map(F.lit("DateTimeOriginal"), "date_time_original"),
        }
    )


def tz_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zones of the coarse cells the catalog knows a zone for."""
    rows = sample.media(spark, sf_dir).where("timezone is not null and base_cell is not null")
    return rows.select(
        cell_parent(F.col("base_cell"), TZ_LEVEL).alias("cell"), F.col("timezone").alias("tz")
    ).distinct()


# The earlier catalog: files up to this day, with some sidecars and cells changed since, and
# some rows edited by hand.
EARLIER_UNTIL = "2024-01-21"
NOW = "2024-02-02 00:00:00"


def empty_catalog(spark: SparkSession) -> DataFrame:
    """No rows, and known to the optimizer as such: nothing is exchanged to meet them."""
    tune(spark)
    return spark.createDataFrame([], resolve.CATALOG_DDL).limit(0)


def earlier_catalog(spark: SparkSession, sf_dir: str, met: DataFrame | None = None) -> DataFrame:
    """``met``: all files with their sidecars, a stage of a step that has them anyway."""
    return sample.stored(spark, sf_dir, "earlier", lambda: _earlier(spark, sf_dir, met))


_ROOTS: dict[tuple[str, str], str] = {}


def earlier_buckets(spark: SparkSession, sf_dir: str) -> str:
    """Where the earlier catalog is kept in buckets."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _ROOTS:
        root = scratch_path(spark, "earlier-buckets")
        create_catalog(earlier_catalog(spark, sf_dir), root, buckets=32)
        _ROOTS[key] = root
    return _ROOTS[key]


def parsed_sidecars(spark: SparkSession, sf_dir: str, texts: bool = True) -> DataFrame:
    """The typed sidecars, written once for the steps that read them. Without ``texts`` the
    documents themselves, which only rows of the catalog hold, stay behind."""
    rows = sidecars(spark, sf_dir)
    return materialize(rows if texts else rows.withColumn("json", F.lit(None).cast("string")), "sidecars")


def _earlier(spark, sf_dir, met=None):
    early = F.col("mtime") < F.lit(EARLIER_UNTIL).cast("timestamp")
    none = empty_catalog(spark)
    if met is None:
        every, _ = media_side(listing(spark, sf_dir))
        files, docs = every.where(early), parsed_sidecars(spark, sf_dir)
        met = materialize(with_sidecars(files, match_sidecars(files, docs, every), docs), "met")
    rows = resolve_met(met.where(early), exif(spark, sf_dir), tz_cells(spark, sf_dir), none, written=True)
    first = resolve.resolve_duplicates(resolve.catalog_rows(rows))
    at = F.lit("2024-01-22").cast("timestamp")
    size = F.length("file_name") + F.unix_seconds("taken_at")
    moved = size % 8 == 3
    return upsert_media(none, first, at).withColumns(
        {
            "sidecar_fingerprint": F.when(size % 5 == 1, "old").otherwise(
                F.col("sidecar_fingerprint")
            ),
            "geo_cell": cell_parent(F.col("base_cell"), 17),
            "location_source": F.when(moved, "manual").otherwise(F.col("location_source")),
            "taken_at_source": F.when(size % 10 == 7, "manual").otherwise(F.col("taken_at_source")),
            "base_cell": F.when((size % 5 == 1) & ~moved, F.col("base_cell") - 1).otherwise(
                F.col("base_cell")
            ),
        }
    )
