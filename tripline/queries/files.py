"""Readers and writers: each query writes to the shared folder and reads back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripline import sample, sample_files as s
from tripline.operators import catalog
from tripline.operators.upsert import upsert
from tripline.queries import base_sql as b
from tripline.queries import files_sql as q
from tripline.queries import timeline as t
from tripline.session import scratch_path
from tripline.sinks import buckets, export
from tripline.sinks import catalog as snapshots
from tripline.sources import exif as exif_source
from tripline.sources import files

QUERIES, SQL = {}, {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _packed(spark, sf_dir):
    """Sidecar texts, one per line, in one file per track folder."""
    path = scratch_path(spark, "packed")
    docs = s.documents(spark, sf_dir).select(
        F.regexp_extract("dir", r"^export/(\d+)", 1).alias("track"), "json"
    )
    docs.repartition("track").write.partitionBy("track").text(path)
    return path


@_query
def scan_listing(spark, sf_dir):
    listed = files.list_files(spark, _packed(spark, sf_dir), "*.txt")
    return listed.groupBy("dir").agg(
        F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"),
        F.count("mtime").alias("dated"),
    )


SQL["scan_listing"] = f"""WITH {q.EV} SELECT 'track=' || regexp_extract(dir, '^export/(\\d+)', 1) AS dir, CAST(1 AS BIGINT) AS files,
  CAST(sum(strlen(json) + 1) AS BIGINT) AS bytes, CAST(1 AS BIGINT) AS dated FROM docs GROUP BY 1"""


@_query
def read_sidecars(spark, sf_dir):
    path = scratch_path(spark, "packs")
    files.pack_sidecars(s.documents(spark, sf_dir)).write.text(path)
    return files.read_sidecars(spark, path, packed=True).select(
        "path", "dir", "valid", "title", "url", F.col("epoch").cast("string").alias("epoch"), "lat", "lng"
    )


SQL["read_sidecars"] = f"""WITH {q.EV}, {q.FIELDS} SELECT path, dir, valid, title, url,
  CAST(epoch AS VARCHAR) AS epoch, slat AS lat, slng AS lng FROM sc"""


@_query
def scan_exif_csv(spark, sf_dir):
    path = scratch_path(spark, "csv")
    sample.media(spark, sf_dir).select(
        F.concat(F.lit("./"), "file_name").alias("SourceFile"),
        F.col("file_name").alias("FileName"),
        F.lit("./").alias("Directory"),
        F.date_format("taken_at", "yyyy:MM:dd HH:mm:ss").alias("DateTimeOriginal"),
        F.col("latitude").alias("GPSLatitude"),
        F.col("longitude").alias("GPSLongitude"),
        F.lit(None).cast("double").alias("GPSAltitude"),
    ).write.option("header", "true").csv(path)
    return exif_source.read_exif_csv(spark, path).select("path", "datetime_text", "lat", "lng")


SQL["scan_exif_csv"] = f"""WITH {b.MEDIA} SELECT file_name AS path, strftime(taken_at, '%Y:%m:%d %H:%M:%S') AS datetime_text,
  latitude AS lat, longitude AS lng FROM media"""


def _written_documents(spark, sf_dir):
    path = scratch_path(spark, "timelines")
    lines = t.document_lines(spark, sf_dir, with_points=False)
    export.write_timelines(lines, path, "track_id")
    return path


@_query
def scan_timelines(spark, sf_dir):
    docs = files.read_document_lines(spark, _written_documents(spark, sf_dir), "track_id")
    return files.scan_timelines(docs)


SQL["scan_timelines"] = f"""{t.COUNTRY_SMOOTH}
SELECT CAST(track_id AS VARCHAR) AS id, 'Trips of ' || track_id AS title, '2024-02-01T00:00:00+00:00' AS generated_at,
  count(key) AS stay_count FROM (SELECT DISTINCT track_id FROM points) LEFT JOIN smooth USING (track_id) GROUP BY track_id"""


@_query
def load_knobs(spark, sf_dir):
    docs = files.read_document_lines(spark, _written_documents(spark, sf_dir), "track_id")
    return files.load_knobs(docs).select("id", "title", "start", "end", "level")


SQL["load_knobs"] = f"""WITH {t.POINTS} SELECT DISTINCT CAST(track_id AS VARCHAR) AS id, 'Trips of ' || track_id AS title,
  '{t.START}' AS start, '{t.END}' AS "end", 'country' AS level FROM points"""


@_query
def write_timeline(spark, sf_dir):
    """Document texts, put together from the container."""
    lines = export.read_container(spark, _written_documents(spark, sf_dir))
    return lines.select("track_id", "line")


SQL["write_timeline"] = f"""{t.DOCUMENT_SQL} SELECT CAST(track_id AS INTEGER) AS track_id, line FROM lines WHERE section IN (0, 1, 4)"""


def _read_lines(spark, lines):
    """Written to a container and read back, one row per line of text."""
    path = scratch_path(spark, "lines")
    export.write_container(lines, path)
    rows = export.read_container(spark, path)
    return rows.select("track_id", F.explode(F.split("line", "\n")).alias("line"))


@_query
def export_gpx(spark, sf_dir):
    items = catalog.located_items(sample.media(spark, sf_dir))
    return _read_lines(spark, export.gpx_lines(items))


SQL["export_gpx"] = f"""WITH {b.MEDIA}, items AS (SELECT * FROM media WHERE latitude IS NOT NULL)
SELECT track_id, '    <trkpt lat="' || latitude || '" lon="' || longitude || '"><time>' || strftime(taken_at, '%Y-%m-%dT%H:%M:%SZ') || '</time></trkpt>' AS line FROM items
UNION ALL SELECT DISTINCT track_id, unnest({[*export.GPX_HEAD.split(chr(10)), *export.GPX_FOOT.split(chr(10))]}) FROM items"""

_FEATURE = """'{"type":"Feature","geometry":{"type":"Point","coordinates":[' || longitude || ',' || latitude
  || ']},"properties":{"time":"' || strftime(taken_at, '%Y-%m-%dT%H:%M:%SZ') || '","id":' || media_id || ',"name":"' || file_name || '"}}'"""


@_query
def export_geojson(spark, sf_dir):
    items = catalog.located_items(sample.media(spark, sf_dir))
    return _read_lines(spark, export.geojson_lines(items))


SQL["export_geojson"] = f"""WITH {b.MEDIA}, items AS (SELECT *,
  row_number() OVER (PARTITION BY track_id ORDER BY taken_at, media_id) AS rn FROM media WHERE latitude IS NOT NULL)
SELECT track_id, CASE WHEN rn = 1 THEN '' ELSE ',' END || {_FEATURE} AS line FROM items
UNION ALL SELECT DISTINCT track_id, unnest(['{{"type":"FeatureCollection","features":[', ']}}']) FROM items"""


@_query
def export_geojson_features(spark, sf_dir):
    items = catalog.located_items(sample.media(spark, sf_dir))
    return export.geojson_features(items)


SQL["export_geojson_features"] = f"""WITH {b.MEDIA} SELECT track_id, media_id, {_FEATURE} AS feature FROM media WHERE latitude IS NOT NULL"""


@_query
def write_catalog(spark, sf_dir):
    """The located items, and a merge that adds the others and writes some once more."""
    root = scratch_path(spark, "catalog")
    media, located = sample.media(spark, sf_dir), F.col("latitude").isNotNull()
    moved = media.withColumn("latitude", F.col("latitude") + F.lit(1.0))
    first = moved.where(located & (F.col("media_id") % 50 == 0)).unionByName(media.where(located & (F.col("media_id") % 50 != 0)))
    buckets.create_catalog(first, root, ["track_id", "media_id"], 32)
    changes = media.where(~located | (F.col("media_id") % 50 == 0))
    buckets.merge_catalog(changes, root, apply=lambda old, new, now, key: upsert(old, new, key))
    return buckets.read_catalog(spark, root).select(
        "media_id", "track_id", F.col("local_date").cast("string").alias("local_date"), "latitude"
    )


SQL["write_catalog"] = f"""WITH {b.MEDIA} SELECT media_id, track_id, CAST(local_date AS VARCHAR) AS local_date, latitude FROM media"""


@_query
def write_snapshot(spark, sf_dir):
    """Two versions of a whole table; the second is current."""
    root = scratch_path(spark, "snapshots")
    media = sample.media(spark, sf_dir)
    snapshots.write_snapshot(media.where(F.col("latitude").isNotNull()), root)
    snapshots.write_snapshot(media, root)
    return snapshots.read_snapshot(spark, root).select("media_id", "track_id", "latitude")


SQL["write_snapshot"] = f"WITH {b.MEDIA} SELECT media_id, track_id, latitude FROM media"


@_query
def route_source(spark, sf_dir):
    """Where every listed file is read from; a third each in two stores and in a local folder."""
    start = F.when(F.col("size") % 3 == 0, "s3://photos/").when(F.col("size") % 3 == 1, "gs://photos/").otherwise("/data/")
    return s.listing(spark, sf_dir).select("track_id", "path", files.routed(F.concat(start, "path")).alias("uri"))


SQL["route_source"] = f"""WITH {q.EV} SELECT u AS track_id, path,
  CASE size % 3 WHEN 0 THEN 's3a://photos/' WHEN 1 THEN 'gs://photos/' ELSE '/data/' END || path AS uri FROM listing"""
