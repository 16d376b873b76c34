"""SQL twins of the file samples: matching and resolution, stated on their own terms."""

from __future__ import annotations

from tripline import sample_files as s
from tripline.functions.names import EDITED_MARKERS
from tripline.queries import base_sql as b

EV = f"""{b.MEDIA},
evx AS (SELECT media_id AS x, track_id AS u, epoch_us(taken_at) // 1000000 AS sec,
  latitude AS lat, longitude AS lng FROM media),
listing AS ({s.LISTING_SQL.replace("{ev}", "evx")}),
docs AS ({s.DOCS_SQL.replace("{ev}", "evx")})"""

_MARKERS = "|".join(EDITED_MARKERS)
_COUNTER = r"'^(.*?)(?:\((\d+)\))?$'"
_EXT = r"'(\.[^.]*)$'"

KIND = """CASE WHEN lower(regexp_extract(name, '(\\.[^.]*)$', 1)) IN ('.jpg', '.heic') THEN 'photo'
  WHEN lower(regexp_extract(name, '(\\.[^.]*)$', 1)) = '.mov' THEN 'video' END"""

NAMES = f"""
files AS (SELECT *, {KIND} AS kind FROM listing WHERE NOT lower(name) LIKE '%.json'),
n1 AS (SELECT *, regexp_extract(name, {_EXT}, 1) AS ext,
  substr(name, 1, length(name) - length(regexp_extract(name, {_EXT}, 1))) AS stem FROM files),
n2 AS (SELECT *, regexp_extract(stem, {_COUNTER}, 1) AS core,
  nullif(regexp_extract(stem, {_COUNTER}, 2), '') AS ctr,
  CASE WHEN regexp_matches(lower(stem), '({_MARKERS})$') THEN regexp_replace(stem, '(?i)({_MARKERS})$', '') END AS estem
  FROM n1),
mn AS (SELECT *, estem || ext AS ename, regexp_extract(estem, {_COUNTER}, 1) AS ecore,
  nullif(regexp_extract(estem, {_COUNTER}, 2), '') AS ectr FROM n2)"""


def _candidates(name: str, core: str, ctr: str) -> str:
    return (
        f"[{core} || ext || '.supplemental-metadata(' || {ctr} || ').json', {core} || ext || '(' || {ctr} || ').json', "
        f"{name} || '.supplemental-metadata.json', {name} || '.json', "
        f"{core} || ext || '.supplemental-metadata.json', {core} || ext || '.json']"
    )


CANDIDATES = f"""
ca AS (SELECT path, dir, unnest({_candidates("name", "core", "ctr")}) AS cand,
    unnest([0, 1, 2, 3, 4, 5]) AS pos FROM mn WHERE kind IS NOT NULL
  UNION ALL SELECT path, dir, unnest({_candidates("ename", "ecore", "ectr")}), unnest([6, 7, 8, 9, 10, 11])
  FROM mn WHERE kind IS NOT NULL AND estem IS NOT NULL)"""

EXACT = f"""{NAMES}, {CANDIDATES},
ma AS (SELECT ca.path, arg_min(d.path, pos) AS sidecar FROM ca JOIN docs d
  ON d.dir = ca.dir AND lower(d.name) = lower(cand) GROUP BY ca.path)"""

# The sidecar documents, parsed by other means.
TITLES = f"""
dt AS (SELECT *, CASE WHEN json_valid(json) THEN CASE WHEN json_type(json) = 'OBJECT' THEN
  CASE WHEN json_type(json, '$.title') = 'VARCHAR' THEN json_extract_string(json, '$.title') END END END AS title,
  coalesce(nullif(regexp_extract(regexp_replace(substr(name, 1, length(name) - 5), {_EXT}, ''), {_COUNTER}, 2), ''), '0') AS jctr
  FROM docs),
entries AS (SELECT dir, path, jctr, lower(title) AS tkey FROM dt WHERE title <> ''
  UNION SELECT dir, path, jctr, lower(regexp_replace(title, {_EXT}, '')) FROM dt WHERE title <> ''),
bases AS (SELECT path, dir, ctr, unnest([lower(core || ext), lower(core)]) AS tkey, unnest([0, 1]) AS pos
    FROM mn WHERE kind IS NOT NULL
  UNION ALL SELECT path, dir, ctr, unnest([lower(ecore || ext), lower(ecore)]), unnest([2, 3])
    FROM mn WHERE kind IS NOT NULL AND estem IS NOT NULL),
picks AS (SELECT bs.path, pos, coalesce(min(e.path) FILTER (WHERE e.jctr = bs.ctr),
    CASE WHEN count(*) = 1 THEN min(e.path) END, min(e.path) FILTER (WHERE e.jctr = '0')) AS sidecar
  FROM bases bs JOIN entries e USING (dir, tkey) GROUP BY bs.path, pos),
mb AS (SELECT path, arg_min(sidecar, pos) AS sidecar FROM picks WHERE sidecar IS NOT NULL GROUP BY path)"""

PREFIX = f"""
im AS (SELECT dir, path, regexp_replace(lower(regexp_extract(substr(name, 1, length(name) - 5), {_COUNTER}, 1)),
  '\\.supplemental.*$', '') AS ikey FROM docs),
tg AS (SELECT path, dir, lower(coalesce(ename, name)) AS target FROM mn WHERE kind IS NOT NULL),
pc AS (SELECT tg.path, im.path AS sidecar, length(ikey) AS len FROM tg JOIN im
  ON im.dir = tg.dir AND starts_with(target, ikey) AND length(ikey) >= greatest(6, length(target) // 2)
  WHERE (SELECT count(*) FROM files f WHERE f.dir = tg.dir AND starts_with(lower(f.name), ikey)) = 1),
mc AS (SELECT path, CASE WHEN count(*) = 1 THEN min(sidecar) END AS sidecar
  FROM (SELECT *, rank() OVER (PARTITION BY path ORDER BY len DESC) AS r FROM pc) WHERE r = 1 GROUP BY path)"""

MATCH = f"""{EXACT}, {TITLES}, {PREFIX},
matches AS (SELECT mn.path, coalesce(ma.sidecar, mb.sidecar, mc.sidecar) AS sidecar,
  CASE WHEN ma.sidecar IS NOT NULL THEN 'exact' WHEN mb.sidecar IS NOT NULL THEN 'title'
    WHEN mc.sidecar IS NOT NULL THEN 'prefix' END AS tier
  FROM mn LEFT JOIN ma USING (path) LEFT JOIN mb USING (path) LEFT JOIN mc USING (path) WHERE kind IS NOT NULL)"""

# What the generated documents should yield, from the rules that generated them.
FIELDS = f"""
fd1 AS (SELECT docs.x, docs.path, docs.name, docs.dir, docs.json, evx.sec, evx.lat, evx.lng,
  docs.x % 31 <> 0 AND docs.x % 29 <> 0 AND docs.x % 37 <> 0 AND docs.x % 41 <> 0 AS valid FROM docs JOIN evx USING (x)),
fields AS (SELECT x, path, name, dir, json, valid,
  CASE WHEN valid THEN {s.TITLE} END AS title,
  CASE WHEN valid THEN {s.DESCRIPTION} END AS description,
  CASE WHEN valid THEN {s.URL} END AS url,
  CASE WHEN valid THEN CASE WHEN x % 53 = 0 THEN NULL WHEN x % 13 = 0 THEN sec WHEN x % 17 = 0 THEN sec + 60 ELSE sec END END AS epoch,
  CASE WHEN valid THEN CASE WHEN x % 43 = 0 THEN 12.5e0 WHEN x % 23 = 0 THEN NULL ELSE CAST(CAST(lat AS DECIMAL(10, 4)) AS DOUBLE) END END AS slat,
  CASE WHEN valid THEN CASE WHEN x % 43 = 0 THEN 100.25e0 WHEN x % 23 = 0 THEN NULL ELSE CAST(CAST(lng AS DECIMAL(10, 4)) AS DOUBLE) END END AS slng
  FROM fd1),
sc AS (SELECT *, CASE WHEN valid THEN sha1('sidecar' || chr(31) || lower(trim(coalesce(title, ''))) || chr(31)
  || lower(trim(description)) || chr(31) || CASE WHEN slat IS NULL THEN '' ELSE printf('%.6f,%.6f', slat, slng) END) END AS fp
  FROM fields)"""

EXIF = f"""
ex AS (SELECT path, nullif(CASE WHEN x % 5 = 0 OR (x % 7 <> 0 AND x % 8 = 3) THEN CASE WHEN x % 10 = 0 THEN wall ELSE '' END
    WHEN x % 7 = 0 THEN '0000:00:00 00:00:00' ELSE wall END, '') AS dtext,
  CASE WHEN x % 3 = 0 THEN NULL WHEN x % 2 = 0 THEN CASE WHEN x % 4 = 0 THEN -1 ELSE 1 END * (35.5e0 + (x % 100) / 1000.0e0)
    ELSE 35e0 + 30e0 / 60 + 36e0 / 3600 END AS elat,
  CASE WHEN x % 3 = 0 THEN NULL WHEN x % 2 = 0 THEN CASE WHEN x % 8 = 0 THEN -1 ELSE 1 END * (139.5e0 + (x % 100) / 1000.0e0)
    ELSE 139e0 + 45e0 / 60 + 18e0 / 3600 END AS elng,
  substr(md5(CAST(x % 5000 AS VARCHAR)), 1, 16) AS phash
  FROM (SELECT *, strftime(make_timestamp(sec * 1000000), '%Y:%m:%d %H:%M:%S') AS wall FROM listing) WHERE {KIND} = 'photo'),
tzc AS (SELECT DISTINCT {b.parent_sql("base_cell", 8)} AS cell, timezone AS tz FROM media
  WHERE timezone IS NOT NULL AND base_cell IS NOT NULL)"""

_OFFSET = "CASE {z} WHEN 'Asia/Singapore' THEN 8 WHEN 'Asia/Tokyo' THEN 9 WHEN 'Asia/Bangkok' THEN 7 ELSE 0 END"


def resolve_sql(out: str, where: str = "TRUE", prev: str | None = None) -> str:
    """Resolved media files with their action, against the catalog ``prev``."""
    old = (
        f"LEFT JOIN {prev} p ON p.track_id = b3.u AND p.dedupe_key = b3.key"
        if prev
        else """LEFT JOIN (SELECT 1 AS track_id, '' AS dedupe_key, NULL::TIMESTAMP AS taken_at, '' AS taken_at_source,
      '' AS timezone, 0e0 AS latitude, 0e0 AS longitude, 0::BIGINT AS base_cell, 0::BIGINT AS geo_cell,
      '' AS location_source, false AS needs_review, NULL::TIMESTAMP AS created_at, '' AS sidecar_fingerprint) p ON false"""
    )
    cell = b.cell_sql("lat", "lng")
    return f"""
{out}_1 AS (SELECT f.u, f.path, f.name, f.kind, f.size, f.sec, f.error, s.x IS NOT NULL AS has_sc, s.title, s.url, s.epoch, s.slat, s.slng, s.fp, s.json,
  coalesce(s.url <> '', false) OR (coalesce(s.title <> '', false) AND s.epoch IS NOT NULL) AS cheap
  FROM files f LEFT JOIN matches m USING (path) LEFT JOIN sc s ON s.path = m.sidecar AND s.valid
  WHERE f.kind IS NOT NULL AND {where}),
{out}_2 AS (SELECT a.*, kind = 'photo' AND (slat IS NULL OR epoch IS NULL OR NOT cheap) AS need, e.dtext AS dtext0, e.elat AS elat0, e.elng AS elng0, e.phash AS phash0
  FROM {out}_1 a LEFT JOIN ex e USING (path)),
{out}_3 AS (SELECT *, CASE WHEN need THEN dtext0 END AS dtext, CASE WHEN need THEN elat0 END AS elat,
  CASE WHEN need THEN elng0 END AS elng, CASE WHEN need AND NOT cheap THEN phash0 END AS phash FROM {out}_2),
{out}_4 AS (SELECT *, CASE WHEN url <> '' THEN sha1('url' || chr(31) || trim(url))
  WHEN title <> '' AND epoch IS NOT NULL THEN sha1('title-time' || chr(31) || lower(title) || chr(31) || epoch)
  WHEN dtext <> '' AND phash <> '' THEN sha1('exif-hash' || chr(31) || dtext || chr(31) || phash)
  ELSE sha1('file' || chr(31) || lower(name) || chr(31) || size) END AS key FROM {out}_3),
{out}_5 AS (SELECT b3.*, p.dedupe_key IS NOT NULL AS has_prev, p.taken_at AS p_at, p.taken_at_source AS p_ats, p.timezone AS p_tz, p.latitude AS p_lat, p.longitude AS p_lng,
  p.base_cell AS p_base, p.geo_cell AS p_geo, p.location_source AS p_src, p.needs_review AS p_rev, p.created_at AS p_created, p.sidecar_fingerprint AS p_fp,
  coalesce(p.location_source = 'manual', false) AS man_loc, coalesce(p.taken_at_source = 'manual', false) AS man_time,
  coalesce(slat, elat) AS lat, coalesce(slng, elng) AS lng FROM {out}_4 b3 {old}),
{out}_6 AS (SELECT *, CASE WHEN lat IS NOT NULL THEN {cell} END AS base FROM {out}_5),
{out}_7 AS (SELECT *, CASE WHEN man_loc THEN p_lat ELSE lat END AS latitude, CASE WHEN man_loc THEN p_lng ELSE lng END AS longitude,
  CASE WHEN man_loc THEN p_base ELSE base END AS base_cell, CASE WHEN man_loc OR p_base = base THEN p_geo END AS geo_cell,
  CASE WHEN man_loc THEN 'manual' WHEN slat IS NOT NULL THEN 'takeout_geodata' WHEN elat IS NOT NULL THEN 'exif_gps' ELSE 'none' END AS location_source,
  CASE WHEN man_loc THEN p_rev ELSE lat IS NULL END AS needs_review FROM {out}_6),
{out}_8 AS (SELECT a.*, z.tz AS zone FROM (SELECT *, {b.parent_sql("(" + b.cell_sql("latitude", "longitude") + ")", 8)} AS zcell FROM {out}_7) a
  LEFT JOIN tzc z ON z.cell = a.zcell),
{out}_9 AS (SELECT *, try_strptime(dtext, '%Y:%m:%d %H:%M:%S') - to_hours({_OFFSET.format(z="zone")}) AS exif_at FROM {out}_8),
{out}_10 AS (SELECT *, CASE WHEN man_time THEN p_at WHEN epoch IS NOT NULL THEN make_timestamp(epoch * 1000000)
    WHEN exif_at IS NOT NULL THEN exif_at ELSE make_timestamp((sec + 86400) * 1000000) END AS taken_at,
  CASE WHEN man_time THEN 'manual' WHEN epoch IS NOT NULL THEN 'sidecar' WHEN exif_at IS NOT NULL THEN 'exif' ELSE 'file_mtime' END AS taken_at_source,
  CASE WHEN man_time THEN p_tz ELSE zone END AS timezone FROM {out}_9),
{out} AS (SELECT *, CAST(taken_at + to_hours({_OFFSET.format(z="timezone")}) AS DATE) AS local_date,
  CASE WHEN error IS NOT NULL THEN 'error' WHEN has_prev AND p_at IS NOT NULL AND p_fp IS NOT DISTINCT FROM fp THEN 'skipped'
    WHEN NOT has_prev THEN 'created' WHEN p_fp IS DISTINCT FROM fp THEN 'refreshed' ELSE 'updated' END AS action FROM {out}_10),
{out}_w AS (SELECT * FROM {out} WHERE action IN ('created', 'refreshed', 'updated')
  QUALIFY row_number() OVER (PARTITION BY u, key ORDER BY path, name) = 1)"""


EARLIER = f"""{resolve_sql("er", f"make_timestamp((f.sec + 86400) * 1000000) < TIMESTAMP '{s.EARLIER_UNTIL}'")},
er_s AS (SELECT *, length(name) + epoch_us(taken_at) // 1000000 AS k FROM er_w),
earlier AS (SELECT u AS track_id, key AS dedupe_key, url, name AS file_name, kind, path AS source_path, taken_at,
  CASE WHEN k % 10 = 7 THEN 'manual' ELSE taken_at_source END AS taken_at_source, timezone, local_date, latitude, longitude,
  CASE WHEN k % 5 = 1 AND k % 8 <> 3 THEN base_cell - 1 ELSE base_cell END AS base_cell,
  {b.parent_sql("base_cell", 17)} AS geo_cell,
  CASE WHEN k % 8 = 3 THEN 'manual' ELSE location_source END AS location_source,
  CASE WHEN k % 5 = 1 THEN 'old' ELSE fp END AS sidecar_fingerprint, needs_review, TIMESTAMP '2024-01-22' AS created_at,
  TIMESTAMP '2024-01-22' AS updated_at FROM er_s)"""

RESOLVE_FRESH = f"{EV}, {MATCH}, {FIELDS}, {EXIF}, {resolve_sql('rs')}"
RESOLVE = f"{EV}, {MATCH}, {FIELDS}, {EXIF}, {EARLIER}, {resolve_sql('rs', prev='earlier')}"
