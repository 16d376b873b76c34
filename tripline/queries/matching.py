"""Sidecar parsing and matching queries and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripline import sample_files as s
from tripline.functions import names
from tripline.functions.text import directory_of, extension_of, name_of, stem_of
from tripline.operators import matching
from tripline.plans.ingest import media_side
from tripline.queries import files_sql as q

QUERIES, SQL = {}, {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _media(spark, sf_dir):
    return media_side(s.listing(spark, sf_dir))[0].where("kind is not null")


@_query
def split_path(spark, sf_dir):
    path, name = F.col("path"), name_of(F.col("path"))
    return s.listing(spark, sf_dir).select(
        "path", directory_of(path).alias("dir"), name.alias("name"), stem_of(name).alias("stem"),
        F.lower(extension_of(name)).alias("ext"),
    )


SQL["split_path"] = f"""WITH {q.EV} SELECT path, dir, name, regexp_replace(name, '\\.[^.]*$', '') AS stem,
  lower(regexp_extract(name, '(\\.[^.]*)$', 1)) AS ext FROM listing"""


@_query
def classify_kind(spark, sf_dir):
    return _media(spark, sf_dir).select("path", "kind")


SQL["classify_kind"] = f"WITH {q.EV}, {q.NAMES} SELECT path, kind FROM files WHERE kind IS NOT NULL"


@_query
def sidecar_validate(spark, sf_dir):
    return s.sidecars(spark, sf_dir).select("path", "valid", "title", "description", "url")


SQL["sidecar_validate"] = f"WITH {q.EV}, {q.FIELDS} SELECT path, valid, title, description, url FROM sc"


@_query
def sidecar_coords(spark, sf_dir):
    return s.sidecars(spark, sf_dir).select("path", "lat", "lng")


SQL["sidecar_coords"] = f"WITH {q.EV}, {q.FIELDS} SELECT path, slat AS lat, slng AS lng FROM sc"


@_query
def sidecar_epoch(spark, sf_dir):
    return s.sidecars(spark, sf_dir).select("path", F.col("epoch").cast("string").alias("epoch"))


SQL["sidecar_epoch"] = f"WITH {q.EV}, {q.FIELDS} SELECT path, CAST(epoch AS VARCHAR) AS epoch FROM sc"


@_query
def sidecar_fingerprint(spark, sf_dir):
    return s.sidecars(spark, sf_dir).select("path", "fingerprint")


SQL["sidecar_fingerprint"] = f"WITH {q.EV}, {q.FIELDS} SELECT path, fp AS fingerprint FROM sc"


@_query
def split_counter(spark, sf_dir):
    stem = stem_of(F.col("name"))
    return _media(spark, sf_dir).select(
        "path", names.counter_core(stem).alias("core"), names.counter(stem).alias("counter")
    )


SQL["split_counter"] = f"WITH {q.EV}, {q.NAMES} SELECT path, core, ctr AS counter FROM mn WHERE kind IS NOT NULL"


@_query
def strip_edited(spark, sf_dir):
    return _media(spark, sf_dir).select("path", names.strip_edited(F.col("name")).alias("original"))


SQL["strip_edited"] = f"WITH {q.EV}, {q.NAMES} SELECT path, ename AS original FROM mn WHERE kind IS NOT NULL"


@_query
def sidecar_candidates(spark, sf_dir):
    return _media(spark, sf_dir).select(
        "path", F.posexplode(names.sidecar_candidates(F.col("name"))).alias("rank", "candidate")
    )


SQL["sidecar_candidates"] = f"""WITH {q.EV}, {q.NAMES}, {q.CANDIDATES},
firsts AS (SELECT path, cand, min(pos) AS pos FROM ca WHERE pos < 6 AND cand IS NOT NULL GROUP BY path, cand)
SELECT path, CAST(row_number() OVER (PARTITION BY path ORDER BY pos) - 1 AS INTEGER) AS rank, cand AS candidate FROM firsts"""


@_query
def match_exact(spark, sf_dir):
    return matching.match_exact(_media(spark, sf_dir), s.sidecars(spark, sf_dir)).drop("track_id")


SQL["match_exact"] = f"WITH {q.EV}, {q.EXACT} SELECT path, sidecar FROM ma"


@_query
def match_title(spark, sf_dir):
    return matching.match_title(_media(spark, sf_dir), s.sidecars(spark, sf_dir)).drop("track_id")


SQL["match_title"] = f"WITH {q.EV}, {q.NAMES}, {q.TITLES} SELECT path, sidecar FROM mb"


@_query
def match_prefix(spark, sf_dir):
    files, _ = media_side(s.listing(spark, sf_dir))
    return matching.match_prefix(_media(spark, sf_dir), s.sidecars(spark, sf_dir), files).drop("track_id")


SQL["match_prefix"] = f"WITH {q.EV}, {q.NAMES}, {q.PREFIX} SELECT path, sidecar FROM mc WHERE sidecar IS NOT NULL"


@_query
def match_sidecars(spark, sf_dir):
    files, _ = media_side(s.listing(spark, sf_dir))
    return matching.match_sidecars(files, s.sidecars(spark, sf_dir)).drop("track_id")


SQL["match_sidecars"] = f"WITH {q.EV}, {q.MATCH} SELECT path, sidecar, tier FROM matches"
