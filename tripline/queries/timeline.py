"""Timeline queries and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripline import sample
from tripline import sample_files as files
from tripline.functions.geo import haversine_km
from tripline.functions.labels import city_label, photo_id
from tripline.operators import catalog, documents, explore
from tripline.operators.clusters import cluster_runs, leader_clusters
from tripline.operators.runs import segment_runs, smooth_runs, stays
from tripline.plans import timeline as plan
from tripline.plans import travel
from tripline.queries import base_sql as b
from tripline.queries import files_sql

START, END = "2024-01-03", "2024-01-28"
QUERIES, SQL = {}, {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _named(name):
    def register(fn):
        QUERIES[name] = fn
        return fn

    return register


def _text(c: str):
    return F.col(c).cast("string").alias(c)


def _points(spark: SparkSession, sf_dir: str, start=None, end=None, region=None) -> DataFrame:
    """All points; only what is about a time window gives one."""
    return catalog.load_points(
        sample.media(spark, sf_dir), sample.place(spark, sf_dir), start, end, region
    )


def _stay_columns(df: DataFrame, *by: str) -> DataFrame:
    return df.select(
        *(by or ("track_id",)), "label", _text("from"), _text("to"),
        "lat", "lng", "photo_count", "sample_url",
    )


POINTS = b.points_sql()
LABELLED = f"labelled AS (SELECT *, {b.LABEL} AS label FROM points WHERE {b.LABEL} IS NOT NULL)"
COUNTRY = "located AS (SELECT * FROM points WHERE cc <> '')"
COUNTRY_SMOOTH = (
    f"WITH RECURSIVE {POINTS}, {COUNTRY}, {b.runs_sql('located', 'cc')}, {b.smooth_sql('runs')}"
)
CITY_SMOOTH = (
    f"WITH RECURSIVE {POINTS}, {LABELLED}, {b.leader_sql('labelled')}, {b.modal_sql('clus')}, "
    "named AS (SELECT c.*, m.label AS modal FROM clus c JOIN modal m USING (track_id, cid)), "
    f"named2 AS (SELECT * EXCLUDE (rn) FROM named), {b.runs_sql('named2', 'modal')}, "
    f"{b.smooth_sql('runs')}"
)


@_query
def load_points(spark, sf_dir):
    return _points(spark, sf_dir, START, END, region=["sg", "jp"]).select(
        "track_id", "media_id", F.date_format("t", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("t"),
        _text("local_date"), "lat", "lng", "cc", "city", "admin1", "url",
    )


SQL["load_points"] = f"""WITH {b.points_sql(START, END, "AND country_code IN ('SG', 'JP')")}
SELECT track_id, media_id, strftime(t, '%Y-%m-%d %H:%M:%S.%f') AS t,
  CAST(local_date AS VARCHAR) AS local_date, lat, lng, cc, city, admin1, url FROM points"""


@_named("city_label")
def city_label_of_points(spark, sf_dir):
    label = city_label(F.col("cc"), F.col("city"), F.col("admin1"))
    return _points(spark, sf_dir).select("media_id", label.alias("label"))


SQL["city_label"] = f"WITH {POINTS} SELECT media_id, {b.LABEL} AS label FROM points"


@_named("segment_runs")
def segment_runs_by_country(spark, sf_dir):
    runs = segment_runs(_points(spark, sf_dir).where("cc <> ''"), F.col("cc"))
    return runs.select("track_id", "run_key", "first_id", "last_id", "n")


SQL["segment_runs"] = f"""WITH {POINTS}, {COUNTRY}, {b.runs_sql("located", "cc")}
SELECT track_id, key AS run_key, fi AS first_id, li AS last_id, n FROM runs"""


@_query
def segment_runs_by_city(spark, sf_dir):
    """Any column can be the key of a run."""
    label = city_label(F.col("cc"), F.col("city"), F.col("admin1"))
    runs = segment_runs(_points(spark, sf_dir).where(label.isNotNull()), label)
    return runs.select("track_id", "run_key", "first_id", "last_id", "n")


SQL["segment_runs_by_city"] = f"""WITH {POINTS}, {LABELLED}, {b.runs_sql("labelled", "label")}
SELECT track_id, key AS run_key, fi AS first_id, li AS last_id, n FROM runs"""


@_named("smooth_runs")
def smooth_runs_24h(spark, sf_dir):
    runs = segment_runs(_points(spark, sf_dir).where("cc <> ''"), F.col("cc"))
    return smooth_runs(runs, 24).select("track_id", "run_key", "first_id", "last_id", "n")


SQL["smooth_runs"] = (
    COUNTRY_SMOOTH
    + """ SELECT track_id, key AS run_key, fi AS first_id, li AS last_id,
  CAST(n AS BIGINT) AS n FROM smooth"""
)


@_query
def country_stays(spark, sf_dir):
    return _stay_columns(plan.country_stays(_points(spark, sf_dir)))


SQL["country_stays"] = f"{COUNTRY_SMOOTH} {b.stays_select('smooth')}"


def _clustered(spark, sf_dir):
    label = plan.point_label()
    return leader_clusters(_points(spark, sf_dir).where(label.isNotNull()), 50.0), label


@_named("leader_clusters")
def leader_clusters_50km(spark, sf_dir):
    return _clustered(spark, sf_dir)[0].select("track_id", "media_id", "cluster_id")


SQL["leader_clusters"] = f"""WITH RECURSIVE {POINTS}, {LABELLED}, {b.leader_sql("labelled")}
SELECT track_id, media_id, cid AS cluster_id FROM clus"""


@_named("stays")
def stays_of_runs(spark, sf_dir):
    runs = segment_runs(_points(spark, sf_dir).where("cc <> ''"), F.col("cc"))
    return _stay_columns(stays(runs))


SQL["stays"] = (
    f"WITH {POINTS}, {COUNTRY}, {b.runs_sql('located', 'cc')} {b.stays_select('runs')}"
)


@_query
def modal_label(spark, sf_dir):
    clustered, label = _clustered(spark, sf_dir)
    return cluster_runs(clustered, label).select(
        "track_id", "cluster_id", F.col("run_key").alias("label"), F.col("n").alias("photos")
    )


SQL["modal_label"] = f"""WITH RECURSIVE {POINTS}, {LABELLED}, {b.leader_sql("labelled")},
{b.modal_sql("clus")}
SELECT track_id, cid AS cluster_id, m.label, count(*) AS photos
FROM clus JOIN modal m USING (track_id, cid) GROUP BY ALL"""


@_query
def city_stays(spark, sf_dir):
    return _stay_columns(plan.city_stays(_points(spark, sf_dir)))


SQL["city_stays"] = f"{CITY_SMOOTH} {b.stays_select('smooth')}"


@_named("haversine_km")
def haversine_from_origin(spark, sf_dir):
    km = haversine_km(F.lit(1.3), F.lit(103.8), F.col("latitude"), F.col("longitude"))
    return catalog.located_items(sample.media(spark, sf_dir)).select(
        "media_id", F.round(km, 3).alias("km")
    )


SQL["haversine_km"] = f"""WITH {b.MEDIA} SELECT media_id, round(2 * 6371.0e0 * asin(sqrt(
  pow(sin(radians(latitude - 1.3e0) / 2), 2) + cos(radians(1.3e0)) * cos(radians(latitude))
  * pow(sin(radians(longitude - 103.8e0) / 2), 2))), 3) AS km FROM media WHERE latitude IS NOT NULL"""


@_named("build_stays")
def build_stays_city(spark, sf_dir):
    """City level with a region, a smaller radius and a shorter blip threshold."""
    return _stay_columns(
        plan.build_stays(
            sample.media(spark, sf_dir), sample.place(spark, sf_dir), START, END,
            level="city", region=["SG", "TH"], merge_km=20.0, min_hours=6,
        )
    )


SQL["build_stays"] = f"""WITH RECURSIVE {b.points_sql(START, END, "AND country_code IN ('SG', 'TH')")},
{LABELLED}, {b.leader_sql("labelled", "20")}, {b.modal_sql("clus")},
named AS (SELECT c.* EXCLUDE (rn), m.label AS modal FROM clus c JOIN modal m USING (track_id, cid)),
{b.runs_sql("named", "modal")}, {b.smooth_sql("runs", "6")} {b.stays_select("smooth")}"""


@_query
def points_payload(spark, sf_dir):
    return documents.points_payload(_points(spark, sf_dir)).select(
        "track_id", *documents.POINT_FIELDS
    )


ID_SQL = """CASE WHEN starts_with(url, 'https://photos.google.com/photo/') THEN substr(url, 33)
  ELSE nullif(url, '') END"""
SQL["points_payload"] = f"""WITH {POINTS} SELECT track_id, strftime(t, '%Y-%m-%dT%H:%M') AS t,
  round(lat, 5) AS lat, round(lng, 5) AS lng, cc, {b.LABEL} AS city, {ID_SQL} AS photo_id FROM points"""


@_named("photo_id")
def photo_ids(spark, sf_dir):
    return sample.media(spark, sf_dir).select("media_id", photo_id(F.col("url")).alias("photo_id"))


SQL["photo_id"] = f"WITH {b.MEDIA} SELECT media_id, {ID_SQL} AS photo_id FROM media"


def document_lines(spark, sf_dir, with_points=True):
    """One document per track, at country level."""
    points = _points(spark, sf_dir)
    headers = points.select("track_id").distinct().select(
        "track_id",
        F.concat(F.lit("Trips of "), "track_id").alias("title"),
        F.array(F.lit("made by query")).alias("prompts"),
        F.lit("2024-02-01T00:00:00+00:00").alias("generated_at"),
        F.struct(
            F.lit(START).alias("start"), F.lit(END).alias("end"), F.lit("country").alias("level")
        ).alias("build"),
    )
    return documents.timeline_lines(
        headers, plan.country_stays(points), points if with_points else None, ["track_id"]
    )


@_query
def timeline_document(spark, sf_dir):
    return document_lines(spark, sf_dir).select("track_id", "section", "line_id", "line")


def _q(text: str) -> str:
    return f"CASE WHEN {text} IS NULL THEN 'null' ELSE '\"' || {text} || '\"' END"


DOCUMENT_SQL = f"""{COUNTRY_SMOOTH},
heads AS (SELECT DISTINCT track_id FROM points),
lines AS (
SELECT track_id, 0 AS section, CAST(NULL AS BIGINT) AS us, CAST(NULL AS VARCHAR) AS line_id,
  '{{"id":"' || track_id || '","title":"Trips of ' || track_id || '","prompts":["made by query"],'
  || '"generated_at":"2024-02-01T00:00:00+00:00","build":{{"start":"{START}","end":"{END}","level":"country"}},"stays":['
  AS line FROM heads
UNION ALL
SELECT track_id, 1, f, fi, CASE WHEN row_number() OVER (PARTITION BY track_id ORDER BY f, fi) = 1 THEN '' ELSE ',' END
  || '{{"label":"' || key || '","from":"' || fd || '","to":"' || ld || '","lat":' || {b.mean_sql("slat")}
  || ',"lng":' || {b.mean_sql("slng")} || ',"photo_count":' || CAST(n AS BIGINT) || ',"sample_url":' || {_q("u")} || '}}'
  FROM smooth
UNION ALL
SELECT track_id, 2, NULL, NULL, '],"photo_url_prefix":"https://photos.google.com/photo/",'
  || '"point_fields":["t","lat","lng","cc","city","photo_id"],"points":[' FROM heads
UNION ALL
SELECT track_id, 3, us, CAST(media_id AS VARCHAR), CASE WHEN seq = 1 THEN '' ELSE ',' END
  || '["' || strftime(t, '%Y-%m-%dT%H:%M') || '",' || round(lat, 5) || ',' || round(lng, 5) || ','
  || {_q("cc")} || ',' || {_q(f"({b.LABEL})")} || ',' || {_q(f"({ID_SQL})")} || ']' FROM points
UNION ALL SELECT track_id, 4, NULL, NULL, ']}}' FROM heads)"""
SQL["timeline_document"] = f"{DOCUMENT_SQL} SELECT track_id, section, line_id, line FROM lines"


@_query
def stay_listing(spark, sf_dir):
    listing = documents.stay_listing(plan.country_stays(_points(spark, sf_dir)))
    return listing.select("track_id", "position", "days", "label", "photo_count", "line")


SQL["stay_listing"] = f"""{COUNTRY_SMOOTH},
listed AS (SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY f, fi) AS position,
  CASE WHEN fd = ld THEN CAST(fd AS VARCHAR) ELSE fd || '..' || ld END AS days, key AS label,
  CAST(n AS BIGINT) AS photo_count FROM smooth)
SELECT *, printf('{documents.STAY_LINE}', position, days, label, photo_count) AS line FROM listed"""


@_query
def timeline_summary(spark, sf_dir):
    return documents.timeline_summary(plan.country_stays(_points(spark, sf_dir)))


SQL["timeline_summary"] = f"""{COUNTRY_SMOOTH}
SELECT track_id, count(*) AS stays, CAST(sum(n) AS BIGINT) AS photos, count(DISTINCT key) AS places,
  date_diff('day', arg_min(fd, (f, fi)), arg_max(ld, (f, fi))) + 1 AS days FROM smooth GROUP BY track_id"""


def knobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four saved timelines per track; the third has no stored knobs."""

    def row(name, start, end, level, region, km, hours):
        return F.struct(
            F.lit(name).alias("name"),
            F.lit(start).cast("timestamp").alias("start"),
            F.lit(end).cast("timestamp").alias("end"),
            F.lit(level).cast("string").alias("level"),
            (F.array(*map(F.lit, region)) if region is not None else F.lit(None))
            .cast("array<string>").alias("region"),
            F.lit(km).cast("double").alias("merge_km"),
            F.lit(hours).cast("double").alias("min_hours"),
        )

    variants = F.array(
        row("a", "2024-01-01", "2024-01-16", None, None, None, None),
        row("b", "2024-01-05", "2024-01-25", "city", ["sg", "TH"], 20.0, 6.0),
        row("c", None, None, None, None, None, None),
        row("d", "2024-01-01", "2024-02-01", "country", [], None, 0.0),
    )
    tracks = sample.events(spark, sf_dir).select(F.col("user_id").alias("track_id")).distinct()
    return (
        tracks.withColumn("v", F.explode(variants))
        .select("track_id", "v.*")
        .withColumn("timeline_id", F.concat(F.lit("t"), "track_id", F.lit("-"), "name"))
        .drop("name")
    )


@_query
def rebuild_timelines(spark, sf_dir):
    rebuilt, _ = plan.rebuild_timelines(
        knobs(spark, sf_dir), sample.media(spark, sf_dir), sample.place(spark, sf_dir)
    )
    return _stay_columns(rebuilt, "timeline_id")


KNOBS_SQL = f"""{b.points_sql()},
chosen AS (SELECT DISTINCT 't' || user_id || '-' || v.name AS timeline_id, user_id AS track_id, v.* FROM events,
  (VALUES ('a', TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-16', 'country', false, 50, 24),
          ('b', TIMESTAMP '2024-01-05', TIMESTAMP '2024-01-25', 'city', true, 20, 6),
          ('d', TIMESTAMP '2024-01-01', TIMESTAMP '2024-02-01', 'country', false, 50, 0)) v(name, s, e, level, reg, km, hours)),
mine AS (SELECT timeline_id, p.*, level, km, hours FROM points p JOIN chosen USING (track_id)
  WHERE t >= s AND t < e AND (NOT reg OR cc IN ('SG', 'TH'))),
c_items AS (SELECT * FROM mine WHERE level = 'country' AND cc <> ''),
y_items AS (SELECT *, {b.LABEL} AS label FROM mine WHERE level = 'city' AND {b.LABEL} IS NOT NULL)"""
SQL["rebuild_timelines"] = f"""WITH RECURSIVE {KNOBS_SQL},
{b.runs_sql("c_items", "cc", "timeline_id, hours", "cr")},
{b.smooth_sql("cr", "hours", "timeline_id, hours", "cs").replace(" < hours *", " < r.hours *")},
{b.leader_sql("y_items", "20", "timeline_id", "yc")}, {b.modal_sql("yc", "timeline_id", "ym")},
y_named AS (SELECT c.* EXCLUDE (rn), m.label AS modal FROM yc c JOIN ym m USING (timeline_id, cid)),
{b.runs_sql("y_named", "modal", "timeline_id", "yr")}, {b.smooth_sql("yr", "6", "timeline_id", "ys")}
{b.stays_select("cs", "timeline_id")} UNION ALL {b.stays_select("ys", "timeline_id")}"""


@_query
def rebuild_dry_run(spark, sf_dir):
    rebuilt, points = plan.rebuild_timelines(
        knobs(spark, sf_dir), sample.media(spark, sf_dir), sample.place(spark, sf_dir)
    )
    n_stays = rebuilt.groupBy("timeline_id").agg(F.count(F.lit(1)).alias("stays"))
    n_points = points.groupBy("timeline_id").agg(F.count(F.lit(1)).alias("points"))
    return n_points.join(n_stays, "timeline_id", "left").select(
        "timeline_id", F.coalesce("stays", F.lit(0)).alias("stays"), "points"
    )


SQL["rebuild_dry_run"] = (
    SQL["rebuild_timelines"].replace(
        b.stays_select("cs", "timeline_id"), ", all_stays AS (" + b.stays_select("cs", "timeline_id")
    )
    + """), ns AS (SELECT timeline_id, count(*) AS stays FROM all_stays GROUP BY 1),
np AS (SELECT timeline_id, count(*) AS points FROM mine GROUP BY 1)
SELECT timeline_id, coalesce(stays, 0) AS stays, points FROM np LEFT JOIN ns USING (timeline_id)"""
)


@_query
def photo_density(spark, sf_dir):
    return explore.photo_density(_points(spark, sf_dir), "1 day").select(
        "track_id", F.date_format("bin_start", "yyyy-MM-dd HH:mm").alias("bin_start"), "photos"
    )


SQL["photo_density"] = f"""WITH {POINTS} SELECT track_id,
  strftime(date_trunc('day', t), '%Y-%m-%d %H:%M') AS bin_start, count(*) AS photos FROM points GROUP BY 1, 2"""


@_query
def poi_rollup(spark, sf_dir):
    return explore.poi_rollup(_points(spark, sf_dir), 12).select(
        "track_id", "level", "cc", "city", F.col("cell").cast("string").alias("cell"),
        "photos", "lat", "lng",
    )


SQL["poi_rollup"] = f"""WITH {POINTS}, located AS (SELECT track_id, cc, {b.LABEL} AS city,
  {b.parent_sql("(" + b.cell_sql("lat", "lng") + ")", 12)} AS cell, lat, lng FROM points WHERE cc <> ''),
g AS (SELECT track_id, cc, city, cell, grouping(city) + grouping(cell) AS g, count(*) AS n, sum(lat) AS slat, sum(lng) AS slng
  FROM located GROUP BY GROUPING SETS ((track_id, cc), (track_id, cc, city), (track_id, cc, city, cell)))
SELECT track_id, CASE g WHEN 2 THEN 'country' WHEN 1 THEN 'city' ELSE 'area' END AS level, cc, city,
  CAST(cell AS VARCHAR) AS cell, n AS photos, {b.mean_sql("slat")} AS lat, {b.mean_sql("slng")} AS lng
FROM g WHERE g = 2 OR city IS NOT NULL"""


@_query
def rebuild_documents(spark, sf_dir):
    """Saved documents with their knobs as they are stored, over today's catalog."""
    text = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    build = F.struct(text("start"), text("end"), "level", "region", "merge_km", "min_hours")
    saved = knobs(spark, sf_dir).select(
        F.col("timeline_id").alias("id"), F.concat(F.lit("Trips "), "timeline_id").alias("title"),
        F.array(F.lit("made by query")).alias("prompts"), "track_id", build.alias("build"),
    )
    kept, rebuilt, points = travel.rebuild_documents(saved, sample.media(spark, sf_dir), sample.place(spark, sf_dir))
    n = points.groupBy("timeline_id").agg(F.count("*").alias("points"))
    heads = kept.join(n.withColumnRenamed("timeline_id", "id"), "id", "left").select(
        F.col("id").alias("timeline_id"), "title", F.coalesce("points", F.lit(0)).alias("points")
    )
    return _stay_columns(rebuilt.join(heads, "timeline_id"), "timeline_id", "title", "points")


SQL["rebuild_documents"] = f"""SELECT r.*, 'Trips ' || timeline_id AS title, n.points FROM ({SQL["rebuild_timelines"]}) r
JOIN (WITH {KNOBS_SQL} SELECT timeline_id, count(*) AS points FROM mine GROUP BY timeline_id) n USING (timeline_id)"""


@_query
def pipeline_stays(spark, sf_dir):
    """From files, documents and lookups to stays, in one chain over an empty catalog."""
    none = files.empty_catalog(spark)
    done = travel.travel(
        files.listing(spark, sf_dir), files.documents(spark, sf_dir), files.exif(spark, sf_dir), files.tz_cells(spark, sf_dir),
        none, sample.geo_place(spark, sf_dir).limit(0), sample.responses(spark, sf_dir),
    )
    return _stay_columns(done.stays)


_CELL = b.parent_sql("base_cell", 17)
SQL["pipeline_stays"] = f"""WITH RECURSIVE {files_sql.RESOLVE_FRESH},
answered AS (SELECT DISTINCT {_CELL} AS cell_id FROM media WHERE base_cell IS NOT NULL),
named AS (SELECT cell_id, CASE cell_id % 3 WHEN 0 THEN 'SG' WHEN 1 THEN 'JP' ELSE 'TH' END AS cc FROM answered
  WHERE cell_id % 13 <> 0 AND cell_id % 11 <> 0 AND cell_id % 17 <> 0 AND cell_id % 6 < 5),
t_items AS (SELECT u AS track_id, key AS media_id, epoch_us(taken_at) AS us, local_date, latitude AS lat, longitude AS lng, url, cc
  FROM rs_w JOIN named ON {_CELL} = cell_id WHERE latitude IS NOT NULL),
{b.runs_sql("t_items", "cc")}, {b.smooth_sql("runs")} {b.stays_select("smooth")}"""
