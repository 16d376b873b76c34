"""Cell and place queries and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripline import sample
from tripline.functions.geo import cell_center_lat, cell_center_lng, cell_of, cell_parent
from tripline.functions.labels import component, place_area, place_city, place_country
from tripline.operators import places
from tripline.operators.upsert import link_cells, upsert_place
from tripline.plans.geocode import geocode
from tripline.queries import base_sql as b

QUERIES, SQL = {}, {}
LEVELS = (6, 9, 12, 17, 21)
CAP = 10


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _named(name):
    def register(fn):
        QUERIES[name] = fn
        return fn

    return register


def _text(c):
    return F.col(c).cast("string").alias(c)


GEO = f"""{b.MEDIA},
gm AS (SELECT * EXCLUDE (geo_cell), {b.parent_sql("base_cell", 17)} AS cell,
  CASE WHEN taken_at < '{sample.GEOCODED_UNTIL}' THEN {b.parent_sql("base_cell", 17)} END AS geo_cell FROM media),
gp AS (SELECT DISTINCT geo_cell AS cell_id FROM gm WHERE geo_cell IS NOT NULL),
pend AS (SELECT * FROM gm WHERE latitude IS NOT NULL AND geo_cell IS NULL),
cells AS (SELECT cell AS cell_id, min(taken_at) AS first_at, count(*) AS items,
  cell NOT IN (SELECT cell_id FROM gp) OR cell % 5 = 0 AS needs FROM pend GROUP BY cell),
rc AS (SELECT DISTINCT cell AS cell_id FROM gm WHERE cell IS NOT NULL AND cell % 13 <> 0),
good AS (SELECT cell_id FROM rc WHERE cell_id % 11 <> 0 AND cell_id % 17 <> 0)"""

# What the six component shapes should yield, stated directly.
CITY = """CASE cell_id % 6 WHEN 0 THEN 'Town ' || (cell_id % 97) WHEN 1 THEN 'Post ' || (cell_id % 97)
  WHEN 2 THEN 'Ward ' || (cell_id % 97) WHEN 3 THEN 'Commune ' || (cell_id % 97)
  WHEN 4 THEN 'District ' || (cell_id % 97) END"""
AREA = "CASE WHEN cell_id % 6 < 3 THEN 'Area ' || (cell_id % 97) END"
COUNTRY = """CASE WHEN cell_id % 6 < 5 THEN
  CASE cell_id % 3 WHEN 0 THEN 'SG' WHEN 1 THEN 'JP' ELSE 'TH' END END"""
# Cell centres from the packed id of a level-17 cell.
CENTER_LAT = "((cell_id % 2097152) + 0.5e0) / 131072e0 * 180e0 - 90e0"
CENTER_LNG = "(((cell_id // 2097152) % 2097152) + 0.5e0) / 131072e0 * 360e0 - 180e0"


@_named("cell_of")
def cell_of_points(spark, sf_dir):
    cell = cell_of(F.col("latitude"), F.col("longitude"))
    return sample.media(spark, sf_dir).select("media_id", cell.cast("string").alias("cell"))


SQL["cell_of"] = f"WITH {b.MEDIA} SELECT media_id, CAST(base_cell AS VARCHAR) AS cell FROM media"


@_named("cell_parent")
def cell_parents(spark, sf_dir):
    cells = [
        cell_parent(F.col("base_cell"), level).cast("string").alias(f"level_{level}")
        for level in LEVELS
    ]
    return sample.media(spark, sf_dir).select("media_id", *cells)


SQL["cell_parent"] = f"""WITH {b.MEDIA} SELECT media_id, {
    ", ".join(f"CAST({b.parent_sql('base_cell', n)} AS VARCHAR) AS level_{n}" for n in LEVELS)
} FROM media"""


@_named("cell_center")
def cell_centers(spark, sf_dir):
    cell = F.col("geo_cell")
    return sample.geo_media(spark, sf_dir).where(cell.isNotNull()).select(
        "media_id", cell_center_lat(cell).alias("lat"), cell_center_lng(cell).alias("lng")
    )


SQL["cell_center"] = f"""WITH {GEO} SELECT media_id, {CENTER_LAT} AS lat, {CENTER_LNG} AS lng
FROM (SELECT media_id, geo_cell AS cell_id FROM gm WHERE geo_cell IS NOT NULL)"""


@_query
def pending_geocode(spark, sf_dir):
    return places.pending_geocode(sample.geo_media(spark, sf_dir)).select(
        "media_id", "track_id", "latitude", "longitude"
    )


SQL["pending_geocode"] = f"WITH {GEO} SELECT media_id, track_id, latitude, longitude FROM pend"


@_query
def estimate_cells(spark, sf_dir):
    return places.estimate_cells(sample.geo_media(spark, sf_dir), LEVELS, recalculate=True)


SQL["estimate_cells"] = f"WITH {GEO} " + " UNION ALL ".join(
    f"""SELECT {n} AS level, CAST(count(*) AS BIGINT) AS pending, count(DISTINCT {b.parent_sql("base_cell", n)}) AS cells,
    count(DISTINCT {b.parent_sql("base_cell", n)}) <= 10000 AS within_budget FROM gm WHERE latitude IS NOT NULL"""
    for n in LEVELS
)


def _work(spark, sf_dir, cap=None):
    media, place = sample.geo_media(spark, sf_dir), sample.geo_place(spark, sf_dir)
    pending = places.pending_geocode(media)
    cells = places.pending_cells(pending, place)
    return pending, place, cells, places.geocode_worklist(cells, cap)


def _worklist(work):
    return work.select(
        _text("cell_id"), F.date_format("first_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("first_at"), "items"
    )


@_query
def geocode_worklist(spark, sf_dir):
    return _worklist(_work(spark, sf_dir)[3])


WORK_COLUMNS = "CAST(cell_id AS VARCHAR) AS cell_id, strftime(first_at, '%Y-%m-%d %H:%M:%S.%f') AS first_at, items"
SQL["geocode_worklist"] = f"WITH {GEO} SELECT {WORK_COLUMNS} FROM cells WHERE needs"


@_query
def geocode_worklist_capped(spark, sf_dir):
    """A lookup budget is a top-k by first time seen."""
    return _worklist(_work(spark, sf_dir, CAP)[3])


SQL["geocode_worklist_capped"] = f"""WITH {GEO}, work AS (SELECT * FROM cells WHERE needs ORDER BY first_at, cell_id LIMIT {CAP})
SELECT {WORK_COLUMNS} FROM work"""


def _place_columns(df):
    return df.select(
        _text("cell_id"), "center_lat", "center_lng", "city", "admin1", "country_code",
        "formatted_address",
    )


FOUND = f"""SELECT CAST(cell_id AS VARCHAR) AS cell_id, {CENTER_LAT} AS center_lat, {CENTER_LNG} AS center_lng,
  {CITY} AS city, {AREA} AS admin1, {COUNTRY} AS country_code,
  'Address of ' || cell_id || repeat(' x', 150) AS formatted_address"""


@_query
def enrich_places(spark, sf_dir):
    work = _work(spark, sf_dir)[3]
    return _place_columns(places.enrich_places(work, sample.responses(spark, sf_dir)))


SQL["enrich_places"] = f"WITH {GEO} {FOUND} FROM cells JOIN good USING (cell_id) WHERE needs"


@_query
def link_media(spark, sf_dir):
    pending, _, cells, work = _work(spark, sf_dir)
    found = places.enrich_places(work, sample.responses(spark, sf_dir))
    return places.link_media(pending, cells, found).select("media_id", _text("geo_cell"))


SQL["link_media"] = f"""WITH {GEO} SELECT media_id, CAST(cell AS VARCHAR) AS geo_cell FROM pend
JOIN cells ON cell = cell_id WHERE NOT needs OR cell_id IN (SELECT cell_id FROM good)"""


@_query
def bulk_link(spark, sf_dir):
    pending, _, cells, work = _work(spark, sf_dir)
    found = places.enrich_places(work, sample.responses(spark, sf_dir))
    links = places.link_media(pending, cells, found)
    return link_cells(sample.geo_media(spark, sf_dir), links).select("media_id", _text("geo_cell"))


SQL["bulk_link"] = f"""WITH {GEO} SELECT media_id, CAST(CASE WHEN geo_cell IS NOT NULL THEN geo_cell
  WHEN latitude IS NOT NULL AND (NOT needs OR cell IN (SELECT cell_id FROM good)) THEN cell END AS VARCHAR) AS geo_cell
FROM gm LEFT JOIN cells ON cell = cell_id"""


@_query
def component_pick(spark, sf_dir):
    parts = F.col("address_components")
    results = sample.responses(spark, sf_dir).select(
        _text("cell_id"), F.inline(F.from_json("response", places.RESPONSE_DDL))
    )
    return results.where(parts.isNotNull()).select(
        "cell_id",
        component(parts, "locality").alias("locality"),
        component(parts, "country").alias("country"),
        place_country(parts).alias("country_code"),
    )


SQL["component_pick"] = f"""WITH {GEO} SELECT CAST(cell_id AS VARCHAR) AS cell_id,
  CASE cell_id % 6 WHEN 0 THEN 'Town ' || (cell_id % 97) WHEN 4 THEN '' END AS locality,
  CASE WHEN cell_id % 6 < 5 THEN 'Country ' || (cell_id % 97) END AS country, {COUNTRY} AS country_code
FROM good"""


@_query
def derive_place(spark, sf_dir):
    parts = F.col("address_components")
    results = sample.responses(spark, sf_dir).select(
        _text("cell_id"), F.inline(F.from_json("response", places.RESPONSE_DDL))
    )
    return results.where(parts.isNotNull()).select(
        "cell_id", place_city(parts).alias("city"), place_area(parts).alias("admin1")
    )


SQL["derive_place"] = f"""WITH {GEO} SELECT CAST(cell_id AS VARCHAR) AS cell_id, {CITY} AS city,
  {AREA} AS admin1 FROM good"""


def _derived(spark, sf_dir, redo):
    return places.derive_all(sample.geo_place(spark, sf_dir), redo).select(
        _text("cell_id"), "city", "admin1"
    )


@_query
def derive_pending(spark, sf_dir):
    return _derived(spark, sf_dir, redo=False)


@_query
def derive_all(spark, sf_dir):
    return _derived(spark, sf_dir, redo=True)


DERIVED = f"""SELECT CAST(cell_id AS VARCHAR) AS cell_id, CASE WHEN cell_id % 7 <> 1 THEN {CITY} END AS city,
  CASE WHEN cell_id % 7 <> 1 THEN {AREA} END AS admin1 FROM gp WHERE cell_id % 5 <> 0"""
SQL["derive_all"] = f"WITH {GEO} {DERIVED}"
SQL["derive_pending"] = f"WITH {GEO} {DERIVED} AND cell_id % 4 = 0"


@_query
def geocode_stats(spark, sf_dir):
    return geocode(
        sample.geo_media(spark, sf_dir), sample.geo_place(spark, sf_dir),
        sample.responses(spark, sf_dir), max_lookups=CAP,
    ).stats


SQL["geocode_stats"] = f"""WITH {GEO}, work AS (SELECT * FROM cells WHERE needs ORDER BY first_at, cell_id LIMIT {CAP}),
st AS (SELECT c.*, c.cell_id IN (SELECT cell_id FROM work) AS asked,
  c.cell_id IN (SELECT cell_id FROM good) AS has FROM cells c)
SELECT CAST(sum(items) AS BIGINT) AS total_items,
  CAST(coalesce(sum(items) FILTER (WHERE NOT needs OR (asked AND has)), 0) AS BIGINT) AS processed,
  CAST(coalesce(sum(items) FILTER (WHERE asked AND NOT has), 0) AS BIGINT) AS skipped,
  count(*) FILTER (WHERE asked) AS api_calls, CAST(0 AS BIGINT) AS errors FROM st"""


@_named("upsert_place")
def upsert_places(spark, sf_dir):
    work = _work(spark, sf_dir)[3]
    found = places.enrich_places(work, sample.responses(spark, sf_dir))
    return _place_columns(upsert_place(sample.geo_place(spark, sf_dir), found))


SQL["upsert_place"] = f"""WITH {GEO}, found AS (SELECT cell_id FROM cells JOIN good USING (cell_id) WHERE needs)
{FOUND} FROM found UNION ALL
SELECT CAST(cell_id AS VARCHAR), {CENTER_LAT}, {CENTER_LNG}, CASE WHEN cell_id % 4 <> 0 THEN 'Old city' END,
  'Old area', 'XX', 'Old address' FROM gp WHERE cell_id NOT IN (SELECT cell_id FROM found)"""
