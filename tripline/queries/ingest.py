"""Resolution and incremental ingest queries and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripline import sample, sample_files as s
from tripline.functions import names, times
from tripline.functions.geo import cell_parent
from tripline.operators import resolve
from tripline.operators.matching import match_sidecars
from tripline.plans.ingest import media_side, resolve_met, with_sidecars
from tripline.queries import base_sql as b
from tripline.queries import files_sql as q
from tripline.session import materialize
from tripline.sinks import buckets

QUERIES, SQL = {}, {}
MONTHS = ("2024-01", "2024-01")


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _at(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


def _text(c: str):
    return F.col(c).cast("string").alias(c)


def _ts(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {c}"


def _rows(spark, sf_dir, previous=None, months=None, force=False, texts=False):
    """``texts``: the rows are written to a catalog, which holds the documents, too. Where the
    earlier catalog is yet to be made, all files meet their sidecars here, once for both."""
    listing = s.listing(spark, sf_dir)
    every, _ = media_side(listing)
    files, _ = media_side(listing, months)
    first = previous is None and not sample.is_stored(spark, sf_dir, "earlier")
    docs = s.parsed_sidecars(spark, sf_dir, texts or first)
    if first:
        rows = materialize(with_sidecars(every, match_sidecars(every, docs), docs), "met")
        s.earlier_catalog(spark, sf_dir, rows)
        if months:
            rows = rows.where(names.in_folder_years(F.col("dir"), *months))
    else:
        rows = with_sidecars(files, match_sidecars(files, docs, every), docs)
    if not texts:
        none = F.lit(None).cast("string")
        rows = rows.withColumn("sc", F.when(F.col("sc").isNotNull(), F.col("sc").withField("json", none)))
    if previous is None:
        previous = s.earlier_catalog(spark, sf_dir)
    return resolve_met(rows, s.exif(spark, sf_dir), s.tz_cells(spark, sf_dir), previous, months, force)


def _fresh(spark, sf_dir):
    return _rows(spark, sf_dir, s.empty_catalog(spark))


@_query
def dedupe_key(spark, sf_dir):
    return _fresh(spark, sf_dir).select("path", "dedupe_key")


SQL["dedupe_key"] = f"WITH {q.RESOLVE_FRESH} SELECT path, key AS dedupe_key FROM rs"


@_query
def exif_gps(spark, sf_dir):
    return s.exif(spark, sf_dir).select("path", "lat", "lng")


SQL["exif_gps"] = f"WITH {q.EV}, {q.EXIF} SELECT path, elat AS lat, elng AS lng FROM ex"


@_query
def exif_datetime_text(spark, sf_dir):
    return s.exif(spark, sf_dir).select("path", "datetime_text")


SQL["exif_datetime_text"] = f"WITH {q.EV}, {q.EXIF} SELECT path, dtext AS datetime_text FROM ex"


@_query
def resolve_location(spark, sf_dir):
    return _fresh(spark, sf_dir).select("path", "latitude", "longitude", "location_source", "needs_review")


SQL["resolve_location"] = f"""WITH {q.RESOLVE_FRESH}
SELECT path, latitude, longitude, location_source, needs_review FROM rs"""


@_query
def assign_timezone(spark, sf_dir):
    return _fresh(spark, sf_dir).select("path", "timezone")


SQL["assign_timezone"] = f"WITH {q.RESOLVE_FRESH} SELECT path, timezone FROM rs"


@_query
def assign_timezone_mixed(spark, sf_dir):
    """A cover of two levels: every third small cell has a zone of its own within its coarse cell."""
    media = sample.media(spark, sf_dir).withColumn("path", F.col("media_id").cast("string"))
    small = media.where("base_cell is not null").select(cell_parent(F.col("base_cell"), 14).alias("cell")).distinct()
    fine = small.where("cell % 3 = 0").select("cell", F.when(F.col("cell") % 2 == 0, "Japan").otherwise("Asia/Jakarta").alias("tz"))
    rows = resolve.assign_timezone(media.drop("timezone"), s.tz_cells(spark, sf_dir).unionByName(fine))
    day = times.local_date(F.col("taken_at"), F.col("zone"))
    return rows.select("media_id", "zone", day.cast("string").alias("local_date"))


SQL["assign_timezone_mixed"] = f"""WITH {q.EV}, {q.EXIF}, mz AS (SELECT media_id, taken_at, {b.parent_sql("base_cell", 14)} AS c14,
  {b.parent_sql("base_cell", 8)} AS c8 FROM media),
zoned AS (SELECT media_id, taken_at, CASE WHEN c14 % 3 = 0 AND c14 % 2 = 0 THEN 'Japan' WHEN c14 % 3 = 0 THEN 'Asia/Jakarta'
  ELSE tz END AS zone FROM mz LEFT JOIN (SELECT cell, min(tz) AS tz FROM tzc GROUP BY cell) ON cell = c8)
SELECT media_id, zone, CAST(CAST(taken_at + to_hours(CASE WHEN zone IN ('Japan', 'Asia/Tokyo') THEN 9 WHEN zone = 'Asia/Singapore' THEN 8
  WHEN zone IS NULL THEN 0 ELSE 7 END) AS DATE) AS VARCHAR) AS local_date FROM zoned"""


@_query
def resolve_taken_at(spark, sf_dir):
    return _fresh(spark, sf_dir).select("path", _at("taken_at"), "taken_at_source")


SQL["resolve_taken_at"] = f"WITH {q.RESOLVE_FRESH} SELECT path, {_ts('taken_at')}, taken_at_source FROM rs"


@_query
def local_date(spark, sf_dir):
    """Every third zone is unknown: the UTC day counts then. Some names have no area."""
    known = F.when(F.col("timezone") == "Asia/Tokyo", "Japan").when(F.col("timezone") == "Asia/Singapore", "Singapore")
    tz = F.when(F.col("media_id") % 3 == 0, "No/Where").otherwise(F.coalesce(known, "timezone"))
    day = times.local_date(F.col("taken_at"), tz)
    return sample.media(spark, sf_dir).select("media_id", day.cast("string").alias("local_date"))


SQL["local_date"] = f"""WITH {b.MEDIA} SELECT media_id,
  CAST(CAST(taken_at + to_hours(CASE WHEN media_id % 3 = 0 THEN 0 ELSE
    CASE timezone WHEN 'Asia/Singapore' THEN 8 WHEN 'Asia/Tokyo' THEN 9 WHEN 'Asia/Bangkok' THEN 7 ELSE 0 END END) AS DATE) AS VARCHAR)
  AS local_date FROM media"""


@_query
def set_location(spark, sf_dir):
    """Items are moved by hand; those without a location are cleared."""
    moved = resolve.set_location(
        F.col("latitude") + F.lit(0.5), F.col("longitude"), resolve.LOCATION_MANUAL
    )
    gone = resolve.clear_location()
    located = F.col("latitude").isNotNull()
    columns = {k: F.when(located, v).otherwise(gone[k]) for k, v in moved.items()}
    return sample.media(spark, sf_dir).withColumns(columns).select(
        "media_id", "latitude", "longitude", _text("base_cell"), "location_source"
    )


SQL["set_location"] = f"""WITH {b.MEDIA}, m2 AS (SELECT media_id, latitude + 0.5e0 AS latitude, longitude FROM media)
SELECT *, CAST(CASE WHEN latitude IS NOT NULL THEN {b.cell_sql("latitude", "longitude")} END AS VARCHAR) AS base_cell,
  CASE WHEN latitude IS NULL THEN 'none' ELSE 'manual' END AS location_source FROM m2"""


@_query
def dir_year(spark, sf_dir):
    return s.listing(spark, sf_dir).select(
        "path", names.folder_year(F.col("dir")).cast("string").alias("year")
    )


SQL["dir_year"] = f"""WITH {q.EV} SELECT path, nullif(regexp_extract(dir, 'Photos from (\\d{{4}})$', 1), '') AS year FROM listing"""


@_query
def prefilter_year_dirs(spark, sf_dir):
    kept, _ = media_side(s.listing(spark, sf_dir), MONTHS)
    return kept.where("kind is not null").select("path", "kind")


SQL["prefilter_year_dirs"] = f"""WITH {q.EV}, {q.NAMES} SELECT path, kind FROM files
WHERE kind IS NOT NULL AND coalesce(try_cast(regexp_extract(dir, 'Photos from (\\d{{4}})$', 1) AS INTEGER) BETWEEN 2023 AND 2025, true)"""


@_query
def month_filter(spark, sf_dir):
    """Bounds may come in any order."""
    lo, hi = times.month_bounds("2024-02,2024-01")
    return sample.media(spark, sf_dir).select(
        "media_id", times.in_months(F.col("taken_at") + F.expr("interval 10 days"), lo, lo).alias("january"),
        times.in_months(F.col("taken_at"), lo, hi).alias("either"),
    )


SQL["month_filter"] = f"""WITH {b.MEDIA} SELECT media_id, strftime(taken_at + INTERVAL 10 DAY, '%Y-%m') = '2024-01' AS january,
  strftime(taken_at, '%Y-%m') BETWEEN '2024-01' AND '2024-02' AS either FROM media"""


@_query
def load_prev(spark, sf_dir):
    previous = resolve.load_previous(s.earlier_catalog(spark, sf_dir))
    return previous.select(
        "track_id", "dedupe_key", F.date_format("prev.taken_at", "yyyy-MM-dd HH:mm:ss").alias("taken_at"),
        "prev.taken_at_source", "prev.timezone", "prev.latitude", "prev.longitude",
        F.col("prev.base_cell").cast("string").alias("base_cell"), F.col("prev.geo_cell").cast("string").alias("geo_cell"),
        "prev.location_source", "prev.needs_review", F.date_format("prev.created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"),
        "prev.sidecar_fingerprint",
    )


SQL["load_prev"] = f"""WITH {q.RESOLVE} SELECT track_id, dedupe_key, {_ts("taken_at")}, taken_at_source, timezone, latitude, longitude,
  CAST(base_cell AS VARCHAR) AS base_cell, CAST(geo_cell AS VARCHAR) AS geo_cell, location_source, needs_review,
  {_ts("created_at")}, sidecar_fingerprint FROM earlier"""


@_query
def ingest_classify(spark, sf_dir):
    return _rows(spark, sf_dir).select("path", "action")


SQL["ingest_classify"] = f"WITH {q.RESOLVE} SELECT path, action FROM rs"


@_query
def ingest_classify_force(spark, sf_dir):
    return _rows(spark, sf_dir, force=True).select("path", "action")


SQL["ingest_classify_force"] = f"""WITH {q.RESOLVE} SELECT path, CASE WHEN action = 'skipped' THEN 'updated' ELSE action END AS action FROM rs"""


@_query
def ingest_classify_months(spark, sf_dir):
    rows = _rows(spark, sf_dir, months=MONTHS)
    return rows.select("path", "action")


SQL["ingest_classify_months"] = f"""WITH {q.RESOLVE} SELECT path, CASE WHEN action = 'error' THEN action
  WHEN epoch IS NOT NULL AND strftime(make_timestamp(epoch * 1000000), '%Y-%m') <> '2024-01' THEN 'filtered'
  WHEN action = 'skipped' THEN action
  WHEN epoch IS NULL AND strftime(taken_at, '%Y-%m') <> '2024-01' THEN 'filtered' ELSE action END AS action FROM rs
JOIN (SELECT path, dir FROM listing) USING (path)
WHERE coalesce(try_cast(regexp_extract(dir, 'Photos from (\\d{{4}})$', 1) AS INTEGER) BETWEEN 2023 AND 2025, true)"""


@_query
def preserve_manual(spark, sf_dir):
    rows = _rows(spark, sf_dir, force=True)
    return rows.where("action = 'refreshed' or action = 'updated'").select(
        "path", _at("taken_at"), "taken_at_source", "timezone", _text("local_date"), "latitude",
        "longitude", _text("base_cell"), "location_source", "needs_review",
    )


SQL["preserve_manual"] = f"""WITH {q.RESOLVE} SELECT path, {_ts("taken_at")}, taken_at_source, timezone,
  CAST(local_date AS VARCHAR) AS local_date, latitude, longitude, CAST(base_cell AS VARCHAR) AS base_cell, location_source, needs_review
FROM rs WHERE action IN ('skipped', 'refreshed', 'updated')"""


@_query
def invalidate_moved(spark, sf_dir):
    rows = _rows(spark, sf_dir).where("action = 'refreshed'")
    return rows.select("path", _text("geo_cell"))


SQL["invalidate_moved"] = f"""WITH {q.RESOLVE} SELECT path, CAST(geo_cell AS VARCHAR) AS geo_cell FROM rs WHERE action = 'refreshed'"""


@_query
def resolve_duplicates(spark, sf_dir):
    rows = resolve.resolve_duplicates(resolve.catalog_rows(_rows(spark, sf_dir)))
    return rows.select("track_id", "dedupe_key", "source_path")


SQL["resolve_duplicates"] = f"WITH {q.RESOLVE} SELECT u AS track_id, key AS dedupe_key, path AS source_path FROM rs_w"


@_query
def upsert_media(spark, sf_dir):
    """A merge into the stored catalog. Run again it writes the same rows over themselves."""
    changes = resolve.resolve_duplicates(resolve.catalog_rows(_rows(spark, sf_dir, texts=True)))
    root = s.earlier_buckets(spark, sf_dir)
    buckets.merge_catalog(changes, root, F.lit(s.NOW).cast("timestamp"))
    return buckets.read_catalog(spark, root).select(
        "track_id", "dedupe_key", "url", "file_name", "kind", "source_path", _at("taken_at"),
        "taken_at_source", "timezone", _text("local_date"), "latitude", "longitude",
        _text("base_cell"), _text("geo_cell"), "location_source", "sidecar_fingerprint",
        "needs_review", _at("created_at"), _at("updated_at"),
    )


SQL["upsert_media"] = f"""WITH {q.RESOLVE},
both_ AS (
  SELECT u AS track_id, key AS dedupe_key, url, name AS file_name, kind, path AS source_path, taken_at, taken_at_source, timezone, local_date,
    latitude, longitude, base_cell, geo_cell, location_source, fp AS sidecar_fingerprint, needs_review,
    coalesce(p_created, TIMESTAMP '{s.NOW}') AS created_at, TIMESTAMP '{s.NOW}' AS updated_at FROM rs_w
  UNION ALL SELECT track_id, dedupe_key, url, file_name, kind, source_path, taken_at, taken_at_source, timezone, local_date, latitude, longitude,
    base_cell, geo_cell, location_source, sidecar_fingerprint, needs_review, created_at, updated_at FROM earlier
  WHERE (track_id, dedupe_key) NOT IN (SELECT (u, key) FROM rs_w))
SELECT * REPLACE (strftime(taken_at, '%Y-%m-%d %H:%M:%S') AS taken_at, CAST(local_date AS VARCHAR) AS local_date,
  CAST(base_cell AS VARCHAR) AS base_cell, CAST(geo_cell AS VARCHAR) AS geo_cell,
  strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at, strftime(updated_at, '%Y-%m-%d %H:%M:%S') AS updated_at) FROM both_"""


@_query
def ingest_stats(spark, sf_dir):
    return resolve.ingest_stats(_rows(spark, sf_dir))


SQL["ingest_stats"] = f"""WITH {q.RESOLVE} SELECT count(*) AS total,
  count(*) FILTER (WHERE action = 'created') AS created, count(*) FILTER (WHERE action = 'updated') AS updated,
  count(*) FILTER (WHERE action = 'refreshed') AS refreshed, count(*) FILTER (WHERE action = 'skipped') AS skipped,
  CAST(0 AS BIGINT) AS filtered, count(*) FILTER (WHERE action = 'error') AS errors,
  count(*) FILTER (WHERE action IN ('created', 'refreshed', 'updated') AND latitude IS NOT NULL) AS with_location,
  count(*) FILTER (WHERE action IN ('created', 'refreshed', 'updated') AND latitude IS NULL) AS without_location,
  count(*) FILTER (WHERE has_sc AND action <> 'error') AS with_sidecar FROM rs"""


@_query
def quarantine(spark, sf_dir):
    return resolve.quarantine(_rows(spark, sf_dir))


SQL["quarantine"] = f"WITH {q.RESOLVE} SELECT path, error FROM rs WHERE action = 'error'"
