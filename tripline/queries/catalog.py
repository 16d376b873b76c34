"""Catalog queries and their SQL twins."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from tripline import sample, sample_files
from tripline.operators import catalog
from tripline.queries import base_sql as b
from tripline.queries import files_sql

QUERIES, SQL = {}, {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _media_columns(df):
    return df.select(
        "media_id", "track_id", "file_name",
        F.date_format("taken_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("taken_at"),
        "timezone", F.col("local_date").cast("string").alias("local_date"),
        "latitude", "longitude", F.col("base_cell").cast("string").alias("base_cell"),
        "geo_cell", "url",
    )


MEDIA_COLUMNS = """media_id, track_id, file_name,
  strftime(taken_at, '%Y-%m-%d %H:%M:%S.%f') AS taken_at, timezone,
  CAST(local_date AS VARCHAR) AS local_date, latitude, longitude,
  CAST(base_cell AS VARCHAR) AS base_cell, geo_cell, url"""


@_query
def scan_media(spark, sf_dir):
    return _media_columns(sample.media(spark, sf_dir))


SQL["scan_media"] = f"WITH {b.MEDIA} SELECT {MEDIA_COLUMNS} FROM media"


@_query
def scan_place(spark, sf_dir):
    return sample.place(spark, sf_dir)


SQL["scan_place"] = f"WITH {b.PLACE} SELECT * FROM place"


#: The photo that is looked up by the key of its address.
LOOKED_UP = "https://photos.google.com/photo/P10"


@_query
def media_by_key(spark, sf_dir):
    key = hashlib.sha1(f"url\x1f{LOOKED_UP}".encode()).hexdigest()
    found = catalog.media_by_key(sample_files.earlier_catalog(spark, sf_dir), key)
    return found.select("track_id", "dedupe_key", "url", "file_name", "source_path", "latitude", "longitude", "location_source")


SQL["media_by_key"] = f"""WITH {files_sql.RESOLVE} SELECT track_id, dedupe_key, url, file_name, source_path, latitude, longitude, location_source
FROM earlier WHERE url = '{LOOKED_UP}'"""


@_query
def place_by_cell(spark, sf_dir):
    return catalog.place_by_cell(sample.place(spark, sf_dir), "cell_4")


SQL["place_by_cell"] = f"WITH {b.PLACE} SELECT * FROM place WHERE cell_id = 'cell_4'"


@_query
def located_items(spark, sf_dir):
    return _media_columns(catalog.in_time_order(catalog.located_items(sample.media(spark, sf_dir))))


SQL["located_items"] = f"""WITH {b.MEDIA} SELECT {MEDIA_COLUMNS} FROM media
WHERE latitude IS NOT NULL AND taken_at IS NOT NULL ORDER BY media.taken_at, media_id"""


@_query
def located_items_of_year(spark, sf_dir):
    """Every second day is moved back by twenty days, some of them into the year before."""
    moved = F.when(F.col("media_id") % 2 == 0, F.date_sub("local_date", 20)).otherwise(F.col("local_date"))
    return _media_columns(catalog.located_items(sample.media(spark, sf_dir).withColumn("local_date", moved), year=2024))


SQL["located_items_of_year"] = f"""WITH {b.MEDIA}, moved AS (SELECT * REPLACE (CASE WHEN media_id % 2 = 0 THEN local_date - 20 ELSE local_date END AS local_date) FROM media)
SELECT {MEDIA_COLUMNS} FROM moved WHERE latitude IS NOT NULL AND year(local_date) = 2024"""


@_query
def located_with_place(spark, sf_dir):
    rows = catalog.located_with_place(sample.media(spark, sf_dir), sample.place(spark, sf_dir))
    return rows.select("media_id", "track_id", "latitude", "longitude", "timezone", "url",
                       "geo_cell", "country_code", "city", "admin1")


SQL["located_with_place"] = f"""WITH {b.MEDIA}, {b.PLACE}
SELECT media_id, track_id, latitude, longitude, timezone, url, geo_cell, country_code, city, admin1
FROM media LEFT JOIN place ON geo_cell = cell_id WHERE latitude IS NOT NULL"""


@_query
def count_media(spark, sf_dir):
    media = sample.media(spark, sf_dir)
    return catalog.count_media(media).select(F.lit("all").alias("what"), "n").unionByName(
        catalog.count_media(media, located_only=True).select(F.lit("located").alias("what"), "n")
    )


SQL["count_media"] = f"""WITH {b.MEDIA} SELECT 'all' AS what, count(*) AS n FROM media
UNION ALL SELECT 'located', count(latitude) FROM media"""


@_query
def catalog_range(spark, sf_dir):
    spans = catalog.catalog_range(sample.media(spark, sf_dir), sample.place(spark, sf_dir))
    return spans.select(
        "track_id", F.col("min").cast("string").alias("min"), F.col("max").cast("string").alias("max"),
        F.array_join("countries", ",").alias("countries"),
    )


SQL["catalog_range"] = f"""WITH {b.points_sql()}
SELECT track_id, CAST(CAST(min(t) AS DATE) AS VARCHAR) AS min, CAST(CAST(max(t) AS DATE) AS VARCHAR) AS max,
  coalesce(string_agg(DISTINCT cc, ',' ORDER BY cc), '') AS countries FROM points GROUP BY track_id"""


@_query
def fk_check(spark, sf_dir):
    rows = catalog.dangling_links(sample.media(spark, sf_dir), sample.place(spark, sf_dir))
    return rows.select("media_id", "geo_cell")


SQL["fk_check"] = f"""WITH {b.MEDIA}, {b.PLACE} SELECT media_id, geo_cell FROM media
WHERE geo_cell NOT IN (SELECT cell_id FROM place)"""
