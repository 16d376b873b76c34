"""The whole chain over many tracks: ingest, geocode, stays, and the saved documents anew."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripline.operators import resolve
from tripline.plans.geocode import Geocoded, geocode
from tripline.plans.ingest import Ingested, ingest
from tripline.plans.timeline import build_stays, rebuild_timelines
from tripline.session import materialize

#: What identifies an item of a catalog with several tracks.
ITEM = ["track_id", "media_id"]


@dataclass
class Travel:
    ingested: Ingested
    geocoded: Geocoded
    stays: DataFrame


def as_media(catalog: DataFrame) -> DataFrame:
    """A catalog as the input of geocoding, timelines and exports: an item's id is its key."""
    return catalog.withColumn("media_id", F.col("dedupe_key"))


def travel(
    listing: DataFrame,
    documents: DataFrame,
    exif: DataFrame,
    tz_cells: DataFrame,
    catalog: DataFrame,
    place: DataFrame,
    responses: DataFrame,
    *,
    start: str | None = None,
    end: str | None = None,
    level: str = "country",
    now: Column | None = None,
    **options,
) -> Travel:
    """From files to stays. The catalog between ingest and geocoding is written once."""
    done = ingest(listing, documents, exif, tz_cells, catalog, now=now, **options)
    media = materialize(as_media(done.catalog), "catalog")
    named = geocode(media, place, responses, now=now, key=ITEM)
    stays = build_stays(named.media, named.place, start, end, level=level)
    return Travel(done, named, stays)


def knobs_of(documents: DataFrame) -> DataFrame:
    """Stored documents (id, title, prompts, track_id, build with text bounds) as the knobs of
    ``rebuild_timelines``; documents without stored bounds are left out."""
    bound = lambda c: F.col(f"build.{c}").try_cast("timestamp")
    return documents.where(F.col("build").isNotNull()).select(
        F.col("id").alias("timeline_id"), "track_id", bound("start").alias("start"), bound("end").alias("end"),
        "build.level", "build.region", "build.merge_km", "build.min_hours",
    ).where("start is not null and end is not null")


def rebuild_documents(documents: DataFrame, media: DataFrame, place: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, stays, points): every stored document over today's catalog. Id, title,
    prompts and build are kept; documents that cannot be rebuilt are not returned."""
    knobs = materialize(knobs_of(documents), "knobs")
    stays, points = rebuild_timelines(knobs, media, place)
    kept = documents.join(knobs.select(F.col("timeline_id").alias("id")), "id", "left_semi")
    return kept, stays, points
