"""Stays of every track, at country or city level."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripline.functions.labels import METRO_AREAS, city_label
from tripline.operators.catalog import as_points, load_points, located_with_place
from tripline.operators.clusters import cluster_runs, leader_clusters
from tripline.operators.runs import TRACK, coalesce_runs, segment_runs, smooth_runs, stays

DEFAULT_MERGE_KM = 50.0
DEFAULT_MIN_HOURS = 24


def point_label(metros: tuple = METRO_AREAS) -> Column:
    return city_label(F.col("cc"), F.col("city"), F.col("admin1"), metros)


def country_stays(
    points: DataFrame,
    min_hours: Column | float = DEFAULT_MIN_HOURS,
    by: Sequence[str] = TRACK,
) -> DataFrame:
    labelled = points.where(F.col("cc") != "")
    return stays(smooth_runs(segment_runs(labelled, F.col("cc"), by), min_hours, by), by)


def city_stays(
    points: DataFrame,
    merge_km: Column | float = DEFAULT_MERGE_KM,
    min_hours: Column | float = DEFAULT_MIN_HOURS,
    by: Sequence[str] = TRACK,
    metros: tuple = METRO_AREAS,
) -> DataFrame:
    label = point_label(metros)
    clustered = leader_clusters(points.where(label.isNotNull()), merge_km, by)
    runs = coalesce_runs(cluster_runs(clustered, label, by).drop("cluster_id"), by)
    return stays(smooth_runs(runs, min_hours, by), by)


def build_stays(
    media: DataFrame | None = None,
    place: DataFrame | None = None,
    start: str | None = None,
    end: str | None = None,
    *,
    level: str = "country",
    region: Sequence[str] | None = None,
    merge_km: float | None = None,
    min_hours: float | None = None,
    points: DataFrame | None = None,
    by: Sequence[str] = TRACK,
) -> DataFrame:
    """Load (unless ``points`` are given) and fold into stays. A knob of None is its default."""
    if points is None:
        points = load_points(media, place, start, end, region, by)
    km = DEFAULT_MERGE_KM if merge_km is None else merge_km
    hours = DEFAULT_MIN_HOURS if min_hours is None else min_hours
    if level == "city":
        return city_stays(points, km, hours, by)
    return country_stays(points, hours, by)


def join_windows(rows: DataFrame, windows: DataFrame) -> DataFrame:
    """``rows`` (track_id, taken_at, _month) with each of ``windows`` (track_id, _start, _end) that they
    lie in. An item has one month, so it meets a window once."""
    last = F.col("_end") - F.expr("interval 1 microsecond")
    months = F.sequence(F.trunc("_start", "month"), F.trunc(last, "month"), F.expr("interval 1 month"))
    cut = windows.where("_start < _end").withColumn("_month", F.explode(months))
    r, w = rows.alias("r"), cut.alias("w")
    same = (F.col("r.track_id") == F.col("w.track_id")) & (F.col("r._month") == F.col("w._month"))
    within = (F.col("r.taken_at") >= F.col("w._start")) & (F.col("r.taken_at") < F.col("w._end"))
    more = [c for c in windows.columns if c != "track_id"]
    return r.join(w, same & within).select("r.*", *[f"w.{c}" for c in more]).drop("_month")


def rebuild_timelines(
    knobs: DataFrame, media: DataFrame, place: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """All saved timelines in one job: (stays, points), each with ``timeline_id``.

    ``knobs`` has timeline_id, track_id, start, end (timestamps) and the optional level,
    region (array), merge_km, min_hours; a NULL knob takes its default, a row without start
    and end has no stored knobs and is skipped. Windows are taken apart into their months, and
    items meet the windows of their track and month only; the earliest start and the latest
    end are a filter on the scan of the items. Timelines then run side by side as groups.
    """
    chosen = knobs.where(F.col("start").isNotNull() & F.col("end").isNotNull()).select(
        "timeline_id",
        "track_id",
        F.col("start").alias("_start"),
        F.col("end").alias("_end"),
        F.coalesce("level", F.lit("country")).alias("level"),
        F.transform("region", F.upper).alias("_region"),
        F.coalesce("merge_km", F.lit(DEFAULT_MERGE_KM)).cast("double").alias("merge_km"),
        F.coalesce("min_hours", F.lit(DEFAULT_MIN_HOURS)).cast("double").alias("min_hours"),
    )
    bounds = chosen.agg(F.min("_start"), F.max("_end")).first()
    inside = media.where(F.col("taken_at").between(*map(F.lit, bounds))) if bounds[0] else media.limit(0)
    rows = located_with_place(inside, place).withColumn("_month", F.trunc("taken_at", "month"))
    joined = join_windows(rows, chosen)
    in_region = (F.size("_region") <= 0) | F.array_contains("_region", F.upper("country_code"))
    joined = joined.where(F.col("_region").isNull() | in_region)
    by = ("timeline_id", "track_id", "level", "merge_km", "min_hours")
    points = as_points(joined, by)
    is_city = F.col("level") == "city"
    stays_all = country_stays(points.where(~is_city), F.col("min_hours"), by).unionByName(
        city_stays(points.where(is_city), F.col("merge_km"), F.col("min_hours"), by)
    )
    return stays_all, points
